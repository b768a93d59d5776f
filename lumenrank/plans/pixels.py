"""Picture metrics on rasters, and composition on boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrank.functions import geometry as geo
from lumenrank.functions import rasters as ras
from lumenrank.operators.detections import subjects
from lumenrank.plans import adapters as ad

METRICS = ["lap_energy", "sharpness", "background_sep", "composition", "lighting", "colorfulness", "hue_contrast", "color_harmony", "visual_clutter", "aesthetic", "composite"]


def _rounded(*names):
    return lambda spark, d: ad.metrics(spark, d).select("vec_id", *(F.round(n, 6).alias(n) for n in names))


def _rounded_sql(*names):
    return f"WITH {ad.METRIC_SQL} SELECT vec_id, {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM metrics"


def vector_histogram(spark, d):
    """Colour bins, eight a channel, of each raster."""
    df = ad.rasters(spark, d)
    bins = F.transform(F.arrays_zip("r", "g", "b"), lambda p: (F.floor(p["r"] / 32) * 64 + F.floor(p["g"] / 32) * 8 + F.floor(p["b"] / 32)).cast("int"))
    return df.select("vec_id", F.explode(bins).alias("bin")).groupBy("vec_id", "bin").agg(F.count("*").alias("n"))


def composition_placement(spark, d):
    s = subjects(ad.detections(spark, d), "image", ["img_w", "img_h"])
    cx, cy = (F.col("s_x") + F.col("s_w") / 2) / F.col("img_w"), (F.col("s_y") + F.col("s_h") / 2) / F.col("img_h")
    return s.select("image", F.round(geo.placement(cx, cy), 6).alias("placement"), F.round(geo.lead_room(1 - cx), 6).alias("lead_right"), F.round(geo.lead_room(cx), 6).alias("lead_left"))


def tilt_score(spark, d):
    """Order lines as line segments, orders as pictures."""
    li = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_quantity") - 25).alias("dx"), ((F.col("l_partkey") % 21 - 10) / 4).alias("dy"))
    lines = li.select("image", geo.tilt_angle(F.col("dx"), F.col("dy")).alias("angle"))
    per = lines.groupBy("image").agg(F.percentile("angle", 0.5).alias("m"), F.count("angle").alias("lines"))
    return per.select("image", "lines", F.round("m", 6).alias("median_angle"), F.round(geo.tilt_score(F.col("m")), 6).alias("tilt"))


def facing_guess(spark, d):
    """Where the subject looks, by the edges of the outer thirds and the gradient's sign."""
    df = ad.rasters(spark, d).withColumns({"grad": ras.gradient(F.col("gray"), 8, 8), "across": ras.horizontal(F.col("gray"), 8, 8)})
    edge = F.transform("grad", lambda v: F.when(v > ad.EDGE, 255.0).otherwise(0.0))
    sides = df.select("vec_id", ras.column_energy(edge, 8, 0, 1).alias("lft"), ras.column_energy(edge, 8, 6, 7).alias("rgt"), (ras.total(F.transform("across", lambda v: F.greatest(v, F.lit(0.0)))) / 64).alias("rise"), (ras.total(F.transform("across", lambda v: F.greatest(-v, F.lit(0.0)))) / 64).alias("fall"))
    return sides.select("vec_id", ras.facing(F.col("lft"), F.col("rgt"), F.col("rise"), F.col("fall")).alias("facing"), F.round("lft", 6).alias("edge_left"), F.round("rgt", 6).alias("edge_right"))


QUERIES = {
    "vector_histogram": vector_histogram,
    "laplacian_sharpness": _rounded("lap_energy", "sharpness"),
    "background_separation": _rounded("background_sep"),
    "composition_placement": composition_placement,
    "tilt_score": tilt_score,
    "lighting_quality": _rounded("lighting"),
    "colorfulness": _rounded("colorfulness"),
    "hue_contrast": _rounded("hue_contrast", "color_harmony"),
    "edge_clutter": _rounded("visual_clutter"),
    "aesthetic_proxy": _rounded("aesthetic"),
    "technical_composite": _rounded(*METRICS),
    "facing_guess": facing_guess,
}

SQL = {
    "vector_histogram": f"WITH {ad.RASTER_SQL} SELECT vec_id, (floor(g0 / 32) * 64 + floor(g1 / 32) * 8 + floor(g2 / 32))::INT AS bin, count(*) AS n FROM px GROUP BY ALL",
    "laplacian_sharpness": _rounded_sql("lap_energy", "sharpness"),
    "background_separation": _rounded_sql("background_sep"),
    "composition_placement": f"""WITH {ad.SUBJECT_SQL}, c AS (SELECT image, (s_x + s_w / 2.0::DOUBLE) / img_w AS cx, (s_y + s_h / 2.0::DOUBLE) / img_h AS cy FROM subjects)
      SELECT image, round({ad.placement_sql("cx", "cy")}, 6) AS placement, ({ad.band_sql("(1 - cx)", *geo.LEAD)})::DOUBLE AS lead_right, ({ad.band_sql("cx", *geo.LEAD)})::DOUBLE AS lead_left FROM c""",
    "tilt_score": """WITH s AS (SELECT l_orderkey AS image, abs(degrees(atan2((l_partkey % 21 - 10) / 4.0::DOUBLE, l_quantity - 25))) AS a FROM lineitem),
      t AS (SELECT image, CASE WHEN a < 15 OR a > 165 THEN least(a, 180 - a) END AS angle FROM s), m AS (SELECT image, count(angle) AS lines, quantile_cont(angle, 0.5) AS m FROM t GROUP BY image)
      SELECT image, lines, round(m, 6) AS median_angle, round(CASE WHEN m IS NULL THEN 0.8 WHEN m <= 2 THEN 1.0 ELSE greatest(0.0, 1 - (m - 2) / 10) END, 6) AS tilt FROM m""",
    "lighting_quality": _rounded_sql("lighting"),
    "colorfulness": _rounded_sql("colorfulness"),
    "hue_contrast": _rounded_sql("hue_contrast", "color_harmony"),
    "edge_clutter": _rounded_sql("visual_clutter"),
    "aesthetic_proxy": _rounded_sql("aesthetic"),
    "technical_composite": _rounded_sql(*METRICS),
    "facing_guess": f"""WITH {ad.RASTER_SQL}, s AS (SELECT vec_id, avg(CASE WHEN grad > {ad.EDGE} THEN 255.0::DOUBLE ELSE 0 END) FILTER (x < 2) AS l, avg(CASE WHEN grad > {ad.EDGE} THEN 255.0::DOUBLE ELSE 0 END) FILTER (x > 5) AS r, sum(greatest(across, 0)) / 64 AS up, sum(greatest(-across, 0)) / 64 AS down FROM px GROUP BY vec_id)
      SELECT vec_id, CASE WHEN l > r * 1.05 THEN 'left' WHEN r > l * 1.05 THEN 'right' WHEN up > down * 1.05 THEN 'right' WHEN down > up * 1.05 THEN 'left' ELSE 'head-on' END AS facing, round(l, 6) AS edge_left, round(r, 6) AS edge_right FROM s""",
}
