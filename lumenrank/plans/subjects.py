"""Subjects among detected boxes, and the crop around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenrank.functions import geometry as geo
from lumenrank.operators import crop
from lumenrank.operators import detections as det
from lumenrank.plans import adapters as ad

FRAME = ["img_w", "img_h"]


def subject_pick(spark, d):
    return det.subjects(ad.detections(spark, d), "image", FRAME)


def subject_merge(spark, d):
    return det.merged_subjects(ad.detections(spark, d), "image", FRAME)


def _centre(df):
    w, h = F.col("img_w"), F.col("img_h")
    return (F.col("s_x") + F.col("s_w") / 2) / w, (F.col("s_y") + F.col("s_h") / 2) / h, F.col("s_w") * F.col("s_h") / (w * h)


def subject_words(spark, d):
    df = subject_pick(spark, d)
    cx, cy, share = _centre(df)
    return df.select("image", geo.position_words(cx, cy).alias("position"), geo.size_words(share).alias("size"), F.concat(F.lit("confidence: "), F.bround(F.col("conf") * 100, 0).cast("long").cast("string"), F.lit("%")).alias("confidence"))


def _facing(df):
    """Where the subject looks: by the picture's number."""
    return df.withColumn("facing", F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("head-on")), (F.col("image") % 3 + 1).cast("int")))


def shot_type_targets(spark, d):
    df = _facing(subject_merge(spark, d))
    df = df.withColumn("shot", geo.shot_type(_centre(df)[2]))
    return df.select("image", "shot", geo.ideal_x(F.col("facing"), F.col("shot")).alias("ideal_x"), geo.ideal_y(F.col("shot")).alias("ideal_y"))


def expand_box(spark, d):
    df = subject_merge(spark, d)
    b = geo.expanded(geo.box("s"), F.col("kind"), F.col("img_w"), F.col("img_h"))
    return df.select("image", *(v.cast("long").alias(f"e_{c}") for c, v in zip("xywh", b, strict=True)))


def subject_fallback(spark, d):
    """Pictures without a detection of confidence 0.95 fall back to a saliency box (every other one has one), then to the middle."""
    df = ad.detections(spark, d)
    images = df.groupBy("image", *FRAME).agg(F.count("*").alias("n"))
    has = F.col("image") % 2 == 0
    images = images.withColumns({"f_x": F.when(has, F.col("n") * 10), "f_y": F.when(has, F.col("n") * 5), "f_w": F.when(has, F.floor(F.col("img_w") / 3)), "f_h": F.when(has, F.floor(F.col("img_h") / 3))}).drop("n")
    return det.with_fallback(images, det.subjects(df.where("conf >= 0.95"), "image", FRAME), "image", FRAME)


def _windows(spark, d):
    return crop.chosen(_facing(subject_merge(spark, d)))


def crop_candidates(spark, d):
    df = crop.candidates(_facing(subject_merge(spark, d))).where("mode <> 'none'")
    return df.select("image", "mode", "crop_w", "crop_h", F.explode("candidates").alias("c")).select("image", "mode", "crop_w", "crop_h", F.col("c.name").alias("name"), F.col("c.start").alias("start"), F.round("c.score", 6).alias("score"))


def crop_choice(spark, d):
    return _windows(spark, d).select("image", "chosen", "crop_x", "crop_y", "crop_w", "crop_h")


def crop_uncertainty(spark, d):
    df = crop.doubts(_windows(spark, d))
    ratio = F.rint(F.col("min_gap_ratio") * 1e6) / 1e6  # as the SQL rounds: of the number itself, not of its shortest decimals
    return df.select("image", "gap_px_threshold", "min_gap_px", ratio.alias("min_gap_ratio"), "uncertain", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {f.__name__: f for f in (subject_pick, subject_merge, subject_words, shot_type_targets, expand_box, subject_fallback, crop_candidates, crop_choice, crop_uncertainty)}

_FACING = "CASE image % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'head-on' END"
_SHOT = "CASE WHEN share >= 0.5 THEN 'close-up' WHEN share >= 0.2 THEN 'medium' WHEN share >= 0.1 THEN 'environmental' WHEN share >= 0.05 THEN 'scenic' ELSE 'extreme_wide' END"
_TARGETS = f"""{ad.MERGED_SQL},
f0 AS (SELECT *, {_FACING} AS facing, s_w * s_h::DOUBLE / (img_w * img_h) AS share FROM merged),
f1 AS (SELECT *, {_SHOT} AS shot FROM f0),
f2 AS (SELECT *, CASE WHEN shot IN ('close-up', 'extreme_wide') THEN 0.5 WHEN facing = 'right' THEN 0.35 WHEN facing = 'left' THEN 0.65 ELSE 0.5 END::DOUBLE AS ideal_x, CASE WHEN shot IN ('environmental', 'scenic', 'extreme_wide') THEN 0.62 ELSE 0.5 END::DOUBLE AS ideal_y FROM f1)"""


def expanded_sql(table: str, out: str) -> str:
    """Common table expression out: table with e_x..e_h."""
    return f"""{out}_p AS (SELECT *, greatest(12, round_even(s_w * CASE kind WHEN 'rider_motorcycle' THEN 0.10::DOUBLE WHEN 'motorcycle' THEN 0.08::DOUBLE ELSE 0.06::DOUBLE END, 0)::BIGINT) AS pad_x, greatest(12, round_even(s_h * CASE kind WHEN 'rider_motorcycle' THEN 0.08::DOUBLE WHEN 'motorcycle' THEN 0.07::DOUBLE ELSE 0.06::DOUBLE END, 0)::BIGINT) AS pad_y FROM {table}),
{out} AS (SELECT *, greatest(0, s_x - pad_x) AS e_x, greatest(0, s_y - pad_y) AS e_y, greatest(1, least(img_w, s_x + s_w + pad_x) - greatest(0, s_x - pad_x)) AS e_w, greatest(1, least(img_h, s_y + s_h + pad_y) - greatest(0, s_y - pad_y)) AS e_h FROM {out}_p)"""


_CROP = f"""{_TARGETS},
k0 AS (SELECT *, CASE WHEN abs(img_w / img_h::DOUBLE - 0.75) < 0.01 THEN 'none' WHEN img_w / img_h::DOUBLE > 0.75 THEN 'sides' ELSE 'top_bottom' END AS mode, s_x + s_w // 2 AS mid_x, s_y + s_h // 2 AS mid_y FROM f2),
k1 AS (SELECT *, CASE mode WHEN 'sides' THEN trunc(img_h * 0.75::DOUBLE)::BIGINT ELSE img_w END AS crop_w, CASE mode WHEN 'top_bottom' THEN trunc(img_w / 0.75::DOUBLE)::BIGINT ELSE img_h END AS crop_h FROM k0),
k2 AS (SELECT *, greatest(8, trunc((CASE mode WHEN 'top_bottom' THEN crop_h ELSE crop_w END) * 0.03::DOUBLE)::BIGINT) AS gap, img_w - crop_w AS room_x, img_h - crop_h AS room_y FROM k1),
k3 AS (SELECT *, greatest(0, least(trunc(mid_x - ideal_x * crop_w)::BIGINT, room_x)) AS ideal_free FROM k2),
k4 AS (SELECT *, greatest(0, least(CASE facing WHEN 'left' THEN s_x - gap WHEN 'right' THEN s_x + s_w + gap - crop_w ELSE ideal_free END, room_x)) AS front_free,
  greatest(0, s_x + s_w + gap - crop_w) AS lo, least(room_x, s_x - gap) AS hi, least(mid_x - crop_w // 2, s_x) AS safe0, least(mid_y - crop_h // 2, s_y) AS safe1 FROM k3),
k5 AS (SELECT *, mode = 'sides' AND s_w + 2 * gap <= crop_w AND lo <= hi AS bounded FROM k4),
k6 AS (SELECT *, unnest(CASE mode WHEN 'sides' THEN [
    {{'pos': 0, 'name': 'front_preserve', 'at': front_free}}, {{'pos': 1, 'name': 'ideal', 'at': ideal_free}},
    {{'pos': 2, 'name': 'safe', 'at': greatest(0, least(CASE WHEN safe0 + crop_w < s_x + s_w THEN s_x + s_w - crop_w ELSE safe0 END, room_x))}}, {{'pos': 3, 'name': 'center', 'at': greatest(0, room_x // 2)}}]
  WHEN 'top_bottom' THEN [
    {{'pos': 0, 'name': 'top_preserve', 'at': greatest(0, least(s_y - gap, room_y))}}, {{'pos': 1, 'name': 'ideal', 'at': greatest(0, least(trunc(mid_y - ideal_y * crop_h)::BIGINT, room_y))}},
    {{'pos': 2, 'name': 'safe', 'at': greatest(0, least(CASE WHEN safe1 + crop_h < s_y + s_h THEN s_y + s_h - crop_h ELSE safe1 END, room_y))}}, {{'pos': 3, 'name': 'center', 'at': greatest(0, room_y // 2)}}] END) AS c FROM k5 WHERE mode <> 'none'),
k7 AS (SELECT *, c.pos AS pos, c.name AS name, CASE WHEN bounded THEN least(greatest(c.at, lo), hi) ELSE c.at END AS start FROM k6),
k8 AS (SELECT *, CASE mode WHEN 'sides' THEN start ELSE 0 END AS wx, CASE mode WHEN 'sides' THEN 0 ELSE start END AS wy FROM k7),
k9 AS (SELECT *, (s_x + s_w / 2.0::DOUBLE - wx) / crop_w AS cx, (s_y + s_h / 2.0::DOUBLE - wy) / crop_h AS cy, (s_x - wx) / crop_w::DOUBLE AS gl, (wx + crop_w - s_x - s_w) / crop_w::DOUBLE AS gr,
  greatest(0, least(s_x + s_w, wx + crop_w) - greatest(s_x, wx)) * greatest(0, least(s_y + s_h, wy + crop_h) - greatest(s_y, wy)) / (s_w * s_h)::DOUBLE AS whole FROM k8),
k10 AS (SELECT *, CASE facing WHEN 'right' THEN 1 - cx WHEN 'left' THEN cx ELSE 0.65 END AS ahead, CASE facing WHEN 'left' THEN gl WHEN 'right' THEN gr ELSE least(gl, gr) END AS front, CASE facing WHEN 'left' THEN gr WHEN 'right' THEN gl ELSE least(gl, gr) END AS rear FROM k9),
cand AS (SELECT *, least(gl, gr) AS min_gap, 0.15 * {ad.placement_sql("cx", "cy")} + 0.15 * ({ad.band_sql("ahead", *geo.LEAD)}) + 0.55 * power(whole, 1.8) + 0.15 * (0.7 * least(greatest(front / 0.03, 0), 1) + 0.3 * least(greatest(rear / 0.03, 0), 1)) AS score FROM k10)"""

_CHOICE = f"""{_CROP},
b0 AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, pos) AS place, max(score) OVER (PARTITION BY image) AS top_score, max(CASE WHEN pos = 0 THEN score END) OVER (PARTITION BY image) AS first_score FROM cand),
b1 AS (SELECT image, mode = 'sides' AND facing IN ('left', 'right') AND first_score >= top_score - 0.05 AS keep_front, name, start, score, front_free, first_score, crop_w, s_x, s_w, mode FROM b0 WHERE place = 1),
b2 AS (SELECT image, CASE WHEN keep_front THEN 'front_preserve' ELSE name END AS p_name, CASE WHEN keep_front THEN front_free ELSE start END AS p_start, CASE WHEN keep_front THEN first_score ELSE score END AS p_score FROM b1),
b3 AS (SELECT c.*, p_name, p_start, p_score, least(s_x - p_start, p_start + crop_w - s_x - s_w) / crop_w::DOUBLE AS p_gap FROM cand c JOIN b2 USING (image)),
b4 AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, min_gap DESC, pos) AS alt_place FROM b3 WHERE mode = 'sides' AND s_w / crop_w::DOUBLE >= 0.6 AND p_gap <= 0.03 * 1.15 AND name <> p_name AND min_gap >= 0.06 AND score >= p_score - 0.12),
b5 AS (SELECT image, any_value(mode) AS mode, any_value(s_w > crop_w) AS wide, any_value(s_h > crop_h AND kind IN ('person', 'rider_motorcycle')) AS tall, any_value(shot = 'close-up') AS close, any_value(ideal_free) AS ideal_free, any_value(front_free) AS front_free, any_value(p_name) AS p_name, any_value(p_start) AS p_start, max(CASE WHEN name = 'top_preserve' THEN start END) AS top_start FROM b3 GROUP BY image),
b6 AS (SELECT b5.*, b4.name AS a_name, b4.start AS a_start FROM b5 LEFT JOIN b4 ON b5.image = b4.image AND b4.alt_place = 1),
b7 AS (SELECT image, mode, CASE WHEN mode = 'sides' AND wide THEN CASE WHEN close THEN 'ideal' ELSE 'front_preserve' END WHEN mode = 'top_bottom' AND tall THEN 'top_preserve' WHEN a_name IS NOT NULL THEN a_name ELSE p_name END AS chosen,
  CASE WHEN mode = 'sides' AND wide THEN CASE WHEN close THEN ideal_free ELSE front_free END WHEN mode = 'top_bottom' AND tall THEN top_start WHEN a_name IS NOT NULL THEN a_start ELSE p_start END AS start FROM b6),
chosen AS (SELECT k.image, img_w, img_h, s_x, s_y, s_w, s_h, coalesce(b.chosen, 'no_crop') AS chosen, CASE WHEN k.mode = 'sides' THEN start ELSE 0 END AS crop_x, CASE WHEN k.mode = 'top_bottom' THEN start ELSE 0 END AS crop_y, crop_w, crop_h FROM k5 k LEFT JOIN b7 b ON k.image = b.image)"""

SQL = {
    "subject_pick": f"WITH {ad.SUBJECT_SQL} SELECT * FROM subjects",
    "subject_merge": f"WITH {ad.MERGED_SQL} SELECT * FROM merged",
    "subject_words": f"""WITH {ad.SUBJECT_SQL}, c AS (SELECT *, (s_x + s_w / 2.0::DOUBLE) / img_w AS cx, (s_y + s_h / 2.0::DOUBLE) / img_h AS cy, s_w * s_h::DOUBLE / (img_w * img_h) AS share FROM subjects),
      w AS (SELECT *, CASE WHEN cx < 0.33 THEN 'left' WHEN cx > 0.66 THEN 'right' ELSE 'center' END AS a, CASE WHEN cy < 0.33 THEN 'top' WHEN cy > 0.66 THEN 'bottom' ELSE 'middle' END AS b FROM c)
      SELECT image, CASE WHEN a = 'center' AND b = 'middle' THEN 'centered' ELSE b || '-' || a END AS position, CASE WHEN share > 0.3 THEN 'large' WHEN share > 0.1 THEN 'medium' ELSE 'small' END AS size, 'confidence: ' || round_even(conf * 100, 0)::BIGINT || '%' AS confidence FROM w""",
    "shot_type_targets": f"WITH {_TARGETS} SELECT image, shot, ideal_x, ideal_y FROM f2",
    "expand_box": f"WITH {ad.MERGED_SQL}, {expanded_sql('merged', 'big')} SELECT image, e_x, e_y, e_w, e_h FROM big",
    "subject_fallback": f"""WITH {ad.DETECTION_SQL}, im AS (SELECT image, img_w, img_h, count(*) AS n FROM detections GROUP BY ALL),
      q AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf * (w * h) / (img_w * img_h) * (CASE cls_id WHEN 3 THEN 2.25 WHEN 62 THEN 1.0 ELSE 2.0 END) DESC, ord) AS place FROM detections WHERE conf >= 0.95),
      su AS (SELECT image, img_w, img_h, x AS s_x, y AS s_y, w AS s_w, h AS s_h, kind FROM q WHERE place = 1), {expanded_sql("su", "big")}
      SELECT im.image, im.img_w, im.img_h, CASE WHEN e_x IS NOT NULL THEN e_x WHEN im.image % 2 = 0 THEN n * 10 ELSE im.img_w // 4 END AS b_x, CASE WHEN e_y IS NOT NULL THEN e_y WHEN im.image % 2 = 0 THEN n * 5 ELSE im.img_h // 4 END AS b_y,
        CASE WHEN e_w IS NOT NULL THEN e_w WHEN im.image % 2 = 0 THEN im.img_w // 3 ELSE im.img_w // 2 END AS b_w, CASE WHEN e_h IS NOT NULL THEN e_h WHEN im.image % 2 = 0 THEN im.img_h // 3 ELSE im.img_h // 2 END AS b_h,
        coalesce(kind, '') AS kind, CASE WHEN e_x IS NOT NULL THEN 'detector' WHEN im.image % 2 = 0 THEN 'saliency' ELSE 'center' END AS method FROM im LEFT JOIN big ON im.image = big.image""",
    "crop_candidates": f"WITH {_CROP} SELECT image, mode, crop_w, crop_h, name, start, round(score, 6) AS score FROM cand",
    "crop_choice": f"WITH {_CHOICE} SELECT image, chosen, crop_x, crop_y, crop_w, crop_h FROM chosen",
    "crop_uncertainty": f"""WITH {_CHOICE}, g AS (SELECT *, least(s_x - crop_x, crop_x + crop_w - s_x - s_w, s_y - crop_y, crop_y + crop_h - s_y - s_h) AS min_gap_px, least((s_x - crop_x) / crop_w::DOUBLE, (crop_x + crop_w - s_x - s_w) / crop_w::DOUBLE, (s_y - crop_y) / crop_h::DOUBLE, (crop_y + crop_h - s_y - s_h) / crop_h::DOUBLE) AS ratio, greatest(8, round_even(least(crop_w, crop_h) * 0.02::DOUBLE, 0)::BIGINT) AS gap_px_threshold FROM chosen),
      r AS (SELECT *, list_filter([CASE WHEN s_w > crop_w OR s_h > crop_h THEN 'subject_larger_than_crop' END, CASE WHEN min_gap_px < 0 THEN 'subject_clipped_by_crop' END, CASE WHEN min_gap_px < gap_px_threshold OR ratio < 0.02 THEN 'subject_too_close_to_crop_border' END, CASE WHEN s_x <= 0 OR s_y <= 0 OR s_x + s_w >= img_w OR s_y + s_h >= img_h THEN 'subject_bbox_hits_image_edge' END], lambda x: x IS NOT NULL) AS reasons FROM g)
      SELECT image, gap_px_threshold, min_gap_px, round_even(ratio, 6) AS min_gap_ratio, len(reasons) > 0 AS uncertain, array_to_string(reasons, ',') AS reasons FROM r""",
}
