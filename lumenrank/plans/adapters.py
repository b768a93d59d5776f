"""How the tables stand in for photo collections: rasters from vectors, boxes from order lines, model scores from ids.

Each adapter comes twice, as a DataFrame and as SQL common table expressions, both plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenrank.functions import geometry as geo
from lumenrank.functions import rasters as ras
from lumenrank.functions import scoring
from lumenrank.functions.replies import KEYS
from lumenrank.sources.shared import materialise

SIDE, SHARP_WIDTH, EDGE = 8, 1080.0, 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, gray, r, g, b, mask, has_box, m_x, m_y): each vector as an 8 by 8 picture; every fifth has no subject box."""
    level = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((4 * v.cast("double") + 1) * 127.5).cast("double")))
    base = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", level).alias("gray"))
    turned = lambda k: F.concat(F.slice("gray", k + 1, 64 - k), F.slice("gray", 1, k))
    boxed = F.col("vec_id") % 5 != 0
    df = base.select("*", F.col("gray").alias("r"), turned(21).alias("g"), turned(42).alias("b"), boxed.alias("has_box"), F.when(boxed, F.col("vec_id") % 4).alias("m_x"), F.when(boxed, F.floor(F.col("vec_id") / 4) % 4).alias("m_y"))
    return df.withColumn("mask", ras.mask(F.col("m_x"), F.col("m_y"), F.lit(4), F.lit(4), SIDE, SIDE))


def technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metrics() written once, as a technical cache: what ranks, cuts and sums reads numbers, not pictures."""
    return materialise(metrics(spark, sf_dir), "technical")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rasters() reduced to the seven metrics and their composite. Without a line detector the horizon counts as unknown."""
    df = rasters(spark, sf_dir)
    gray, r, g, b, m = (F.col(c) for c in ("gray", "r", "g", "b", "mask"))
    df = df.withColumns({"lap": ras.laplacian(gray, SIDE, SIDE), "grad": ras.gradient(gray, SIDE, SIDE), "hues": ras.hue(r, g, b), "sat": ras.saturation(r, g, b), "across": ras.horizontal(gray, SIDE, SIDE)})
    cx, cy = (F.when(F.col("has_box"), (F.col(c) + 1.5) / SIDE).otherwise(0.5) for c in ("m_x", "m_y"))
    right = ras.total(F.zip_with("across", m, lambda v, k: v * k)) >= 0
    lead = F.when(m.isNull(), 0.5).otherwise(geo.lead_room(F.when(right, 1 - cx).otherwise(cx)))
    df = df.select(
        "vec_id",
        "label",
        ras.energy(F.col("lap"), m).alias("lap_energy"),
        ras.sharpness(ras.energy(F.col("lap"), m), SHARP_WIDTH).alias("sharpness"),
        ras.background_separation(F.col("lap"), m).alias("background_sep"),
        (0.5 * geo.placement(cx, cy) + 0.25 * geo.tilt_score(F.lit(None).cast("double")) + 0.25 * lead).alias("composition"),
        ras.lighting(gray).alias("lighting"),
        ras.colourfulness(r, g, b).alias("colorfulness"),
        ras.hue_contrast(F.col("hues"), m).alias("hue_contrast"),
        ras.clutter(F.col("grad"), m, EDGE).alias("visual_clutter"),
        ras.aesthetic(gray, F.col("sat")).alias("aesthetic"),
    )
    df = df.withColumn("color_harmony", 0.6 * F.col("colorfulness") + 0.4 * F.col("hue_contrast"))
    return df.withColumn("composite", F.round(scoring.composite(), 9))


def votes(df: DataFrame, item: str = "vec_id") -> DataFrame:
    """df with six model scores, total, failed, scorer and available, by arithmetic on the id."""
    v = F.col(item)
    scores = {k: (7 * v + 3 * i + 5 * F.floor(v / 11)) % 11 for i, k in enumerate(KEYS)}
    df = df.withColumns({k: c.cast("long") for k, c in scores.items()})
    summed = sum((F.col(k) for k in KEYS[1:]), F.col(KEYS[0]))
    return df.withColumns({"total": F.when(v % 7 == 3, None).otherwise(summed).cast("long"), "failed": v % 13 == 0, "scorer": F.when(v % 3 == 0, "claude").when(v % 3 == 1, "ollama").otherwise("clip"), "available": v % 17 != 0})


def scored(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """(vec_id, label, composite, model scores, final_score); known is technical(), if it is there already."""
    df = votes((known or technical(spark, sf_dir)).select("vec_id", "label", "composite"))
    return df.withColumn("final_score", F.round(scoring.final_score(F.col("composite"), F.col("total"), F.col("crop_4x5"), F.col("scorer"), F.col("failed"), F.col("available")), 9))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, img_w, img_h, ord, x, y, w, h, cls_id, conf): order lines as detected boxes; the order is the picture."""
    li = table(spark, sf_dir, "lineitem")
    image = F.col("l_orderkey")
    w, h = 640 + image % 5 * 320, 480 + image % 4 * 320
    ord_ = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    df = li.select(image.alias("image"), w.alias("img_w"), h.alias("img_h"), ord_.alias("key"), (F.col("l_partkey") * 13 % (w - 40)).alias("x"), (F.col("l_suppkey") * 7 % (h - 40)).alias("y"), (20 + F.col("l_quantity") * 11).cast("long").alias("w0"), (20 + F.col("l_quantity") * 7 + F.col("l_suppkey") % 200).cast("long").alias("h0"), F.element_at(F.array(*(F.lit(c) for c in (0, 3, 2, 16, 62))), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("cls_id"), F.round(1 - F.col("l_discount") * 5, 6).alias("conf"))
    df = df.withColumn("ord", F.row_number().over(W.partitionBy("image").orderBy("key")).cast("long"))
    return df.select("image", "img_w", "img_h", "ord", "x", "y", F.least("w0", F.col("img_w") - F.col("x")).alias("w"), F.least("h0", F.col("img_h") - F.col("y")).alias("h"), "cls_id", "conf")


def _mirror(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} >= 8 THEN 14 - ({v}) ELSE {v} END)"


def _px(dy: int, dx: int) -> str:
    return f"a[({_mirror(f'y + {dy}')} * 8 + {_mirror(f'x + {dx}')} + 1)::BIGINT]"


RASTER_SQL = f"""
e AS (SELECT vec_id, label, list_transform(embedding, lambda v: least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor((4 * v::DOUBLE + 1) * 127.5)))) AS a FROM embeddings),
p0 AS (SELECT vec_id, label, a, unnest(range(64)) AS i FROM e),
p1 AS (SELECT vec_id, label, a, i, i // 8 AS y, i % 8 AS x, vec_id % 5 <> 0 AS boxed, vec_id % 4 AS mx, (vec_id // 4) % 4 AS my FROM p0),
p2 AS (SELECT *, a[i + 1] AS g0, a[(i + 21) % 64 + 1] AS g1, a[(i + 42) % 64 + 1] AS g2, CASE WHEN NOT boxed THEN NULL WHEN x BETWEEN mx AND mx + 3 AND y BETWEEN my AND my + 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS k,
  {_px(-1, 0)} + {_px(1, 0)} + {_px(0, -1)} + {_px(0, 1)} - 4 * a[i + 1] AS lap,
  abs({_px(0, 1)} - {_px(0, -1)}) + abs({_px(1, 0)} - {_px(-1, 0)}) AS grad,
  {_px(-1, 1)} + 2 * {_px(0, 1)} + {_px(1, 1)} - {_px(-1, -1)} - 2 * {_px(0, -1)} - {_px(1, -1)} AS across FROM p1),
p3 AS (SELECT *, greatest(g0, g1, g2) AS top, least(g0, g1, g2) AS low FROM p2),
px AS (SELECT *, CASE WHEN top = 0 THEN 0.0 ELSE 255 * (top - low) / top END AS sat,
  (CASE WHEN top = low THEN 0.0 WHEN top = g0 THEN CASE WHEN g1 < g2 THEN 360 ELSE 0 END + 60 * (g1 - g2) / (top - low) WHEN top = g1 THEN 120 + 60 * (g2 - g0) / (top - low) ELSE 240 + 60 * (g0 - g1) / (top - low) END) / 2 AS hue FROM p3)
"""


def placement_sql(cx: str, cy: str) -> str:
    near = ", ".join(f"sqrt(({cx} - {x}) * ({cx} - {x}) + ({cy} - {y}) * ({cy} - {y}))" for grid in (geo.THIRDS, geo.PHI) for x in grid for y in grid)
    return f"exp(-0.5 * power(least({near}) / {geo.SPREAD}, 2))"


def band_sql(x: str, inner: tuple, outer: tuple, values: tuple) -> str:
    return f"CASE WHEN {x} BETWEEN {inner[0]} AND {inner[1]} THEN {values[0]} WHEN {x} BETWEEN {outer[0]} AND {outer[1]} THEN {values[1]} ELSE {values[2]} END"


METRIC_SQL = f"""{RASTER_SQL},
m0 AS (SELECT vec_id, any_value(label) AS label, any_value(boxed) AS boxed, any_value(mx) AS mx, any_value(my) AS my,
  CASE WHEN any_value(boxed) THEN sum(lap * lap * k) / greatest(1, sum(k)) ELSE var_pop(lap) END AS lap_energy,
  sum(lap * lap * k) / greatest(1, sum(k)) AS in_energy, sum(lap * lap * (1 - k)) / greatest(1, sum(1 - k)) AS out_energy,
  sum(across * k) AS across, avg(g0) AS lum, (count(*) FILTER (g0 < 5 OR g0 >= 250)) / 64.0 AS clipped,
  sqrt(var_pop(g0 - g1) + var_pop((g0 + g1) / 2 - g2)) AS spread, sqrt(power(avg(g0 - g1), 2) + power(avg((g0 + g1) / 2 - g2), 2)) AS centre,
  abs(sum(hue * k) / greatest(1, sum(k)) - sum(hue * (1 - k)) / greatest(1, sum(1 - k))) AS hue_gap,
  CASE WHEN any_value(boxed) THEN sum(CASE WHEN grad > {EDGE} THEN 1 - k ELSE 0 END) / greatest(1, sum(1 - k)) ELSE (count(*) FILTER (grad > {EDGE})) / 64.0 END AS edge_share,
  stddev_pop(g0) AS contrast, avg(sat) AS sat FROM px GROUP BY vec_id),
m1 AS (SELECT *, CASE WHEN boxed THEN (mx + 1.5) / 8 ELSE 0.5 END AS cx, CASE WHEN boxed THEN (my + 1.5) / 8 ELSE 0.5 END AS cy FROM m0),
m2 AS (SELECT *, CASE WHEN across >= 0 THEN 1 - cx ELSE cx END AS ahead FROM m1),
m3 AS (SELECT vec_id, label, lap_energy, least(lap_energy / 500, 1.0) AS sharpness, CASE WHEN boxed THEN least(in_energy / greatest(out_energy, 1e-6) / 5, 1.0) ELSE 0.5 END AS background_sep,
  0.5 * {placement_sql("cx", "cy")} + 0.25 * 0.8 + 0.25 * (CASE WHEN boxed THEN {band_sql("ahead", *geo.LEAD)} ELSE 0.5 END) AS composition,
  ({band_sql("lum", *ras.LUMINANCE)}) * (1 - least(clipped, 0.04) / 0.04) AS lighting,
  least((spread + 0.3 * centre) / 80, 1.0) AS colorfulness, CASE WHEN boxed THEN least((CASE WHEN hue_gap > 90 THEN 180 - hue_gap ELSE hue_gap END) / 60, 1.0) ELSE 0.5 END AS hue_contrast,
  greatest(0.0, 1 - 10 * edge_share) AS visual_clutter, 0.5 * least(contrast / 80, 1.0) + 0.5 * (1 - 2 * abs(sat / 255 - 0.5)) AS aesthetic FROM m2),
m4 AS (SELECT *, 0.6 * colorfulness + 0.4 * hue_contrast AS color_harmony FROM m3),
metrics AS (SELECT *, round({" + ".join(f"{k} * {w}" for k, w in scoring.WEIGHTS.items())}, 9) AS composite FROM m4)
"""

GATE_SQL = "CASE " + " ".join(f"WHEN coalesce(crop_4x5, 0) <= {most} THEN {f}" for most, f in scoring.GATE) + " ELSE 1.0 END"

SCORED_SQL = f"""{METRIC_SQL},
v0 AS (SELECT vec_id, label, composite, {", ".join(f"(7 * vec_id + {3 * i} + 5 * (vec_id // 11)) % 11 AS {k}" for i, k in enumerate(KEYS))} FROM metrics),
v1 AS (SELECT *, CASE WHEN vec_id % 7 <> 3 THEN {" + ".join(KEYS)} END AS total, vec_id % 13 = 0 AS failed, CASE vec_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'ollama' ELSE 'clip' END AS scorer, vec_id % 17 <> 0 AS available FROM v0),
scored AS (SELECT *, round(CASE WHEN NOT available THEN composite WHEN failed THEN composite * 0.3 ELSE (composite * 0.3 + coalesce(total, 30) / 60.0 * 0.7) * (CASE WHEN scorer = 'clip' THEN 1.0 ELSE {GATE_SQL} END) END, 9) AS final_score FROM v1)
"""

DETECTION_SQL = """
d0 AS (SELECT l_orderkey AS image, 640 + l_orderkey % 5 * 320 AS img_w, 480 + l_orderkey % 4 * 320 AS img_h, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  trunc(20 + l_quantity * 11)::BIGINT AS w0, trunc(20 + l_quantity * 7 + l_suppkey % 200)::BIGINT AS h0, [0, 3, 2, 16, 62][l_linenumber % 5 + 1] AS cls_id, round(1 - l_discount * 5, 6) AS conf FROM lineitem),
d1 AS (SELECT *, l_partkey * 13 % (img_w - 40) AS x, l_suppkey * 7 % (img_h - 40) AS y, row_number() OVER (PARTITION BY image ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord FROM d0),
detections AS (SELECT image, img_w, img_h, ord, x, y, least(w0, img_w - x) AS w, least(h0, img_h - y) AS h, cls_id, conf,
  CASE cls_id WHEN 0 THEN 'person' WHEN 3 THEN 'motorcycle' WHEN 2 THEN 'car' WHEN 16 THEN 'dog' ELSE 'class_62' END AS kind FROM d1)
"""

SUBJECT_SQL = f"""{DETECTION_SQL},
s0 AS (SELECT *, count(*) OVER (PARTITION BY image) AS n, row_number() OVER (PARTITION BY image ORDER BY conf * (w * h) / (img_w * img_h) * (CASE cls_id WHEN 3 THEN 2.25 WHEN 62 THEN 1.0 ELSE 2.0 END) DESC, ord) AS place FROM detections),
subjects AS (SELECT image, img_w, img_h, x AS s_x, y AS s_y, w AS s_w, h AS s_h, kind, conf, n FROM s0 WHERE place = 1)
"""

MERGED_SQL = f"""{SUBJECT_SQL},
g0 AS (SELECT s.*, d.x AS d_x, d.y AS d_y, d.w AS d_w, d.h AS d_h, d.conf AS d_conf, d.ord AS d_ord, greatest(0, least(s_x + s_w, d.x + d.w) - greatest(s_x, d.x)) * greatest(0, least(s_y + s_h, d.y + d.h) - greatest(s_y, d.y)) AS shared,
  sqrt(power(s_x + s_w / 2.0 - d.x - d.w / 2.0, 2) + power(s_y + s_h / 2.0 - d.y - d.h / 2.0, 2)) / sqrt(power(s.img_w, 2) + power(s.img_h, 2)) AS apart
  FROM subjects s JOIN detections d ON s.image = d.image AND ((s.kind = 'person' AND d.kind = 'motorcycle') OR (s.kind = 'motorcycle' AND d.kind = 'person'))),
g1 AS (SELECT *, shared::DOUBLE / (s_w * s_h + d_w * d_h - shared) AS overlap FROM g0),
g2 AS (SELECT *, d_conf * (1 + overlap * 1.8 - apart * 0.8) AS pair_score FROM g1 WHERE overlap >= 0.01 OR apart <= 0.35),
g3 AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY pair_score DESC, d_ord) AS place FROM g2 WHERE pair_score > 0),
merged AS (SELECT s.image, s.img_w, s.img_h, CASE WHEN g.image IS NULL THEN s.s_x ELSE least(s.s_x, g.d_x) END AS s_x, CASE WHEN g.image IS NULL THEN s.s_y ELSE least(s.s_y, g.d_y) END AS s_y,
  CASE WHEN g.image IS NULL THEN s.s_w ELSE greatest(s.s_x + s.s_w, g.d_x + g.d_w) - least(s.s_x, g.d_x) END AS s_w, CASE WHEN g.image IS NULL THEN s.s_h ELSE greatest(s.s_y + s.s_h, g.d_y + g.d_h) - least(s.s_y, g.d_y) END AS s_h,
  CASE WHEN g.image IS NULL THEN s.kind ELSE 'rider_motorcycle' END AS kind, CASE WHEN g.image IS NULL THEN s.conf ELSE greatest(s.conf, g.d_conf) END AS conf, s.n FROM subjects s LEFT JOIN g3 g ON s.image = g.image AND g.place = 1)
"""
