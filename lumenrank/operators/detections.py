"""Choosing the subject among detected boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions import geometry as geo

# Classes that are likely subjects, and how much more they count.
PRIORITY = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 4: "airplane", 5: "bus", 6: "train", 7: "truck", 16: "dog", 17: "cat", 18: "horse"}
MOTORCYCLE_FACTOR, PRIORITY_FACTOR = 2.25, 2.0
MIN_IOU, MAX_DISTANCE, IOU_GAIN, DISTANCE_LOSS = 0.01, 0.35, 1.8, 0.8


def class_name(cls_id: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for i, name in PRIORITY.items():
        out = out.when(cls_id == i, name)
    return out.otherwise(F.concat(F.lit("class_"), cls_id.cast("string")))


def class_factor(cls_id: Column) -> Column:
    return F.when(cls_id == 3, MOTORCYCLE_FACTOR).when(cls_id.isin(*PRIORITY), PRIORITY_FACTOR).otherwise(1.0)


def subjects(detections: DataFrame, image: str, frame: list[str]) -> DataFrame:
    """(image, frame columns, s_x..s_h, kind, conf, n): the detection of greatest confidence * share of the frame * class factor, of equal ones the first.

    detections: image, frame columns (width, height), ord, x, y, w, h as numbers, cls_id, conf. The share comes from the box as
    detected, the box itself is cut to whole pixels. One aggregation, combined before rows move.
    """
    score = F.col("conf") * (F.col("w") * F.col("h")) / (F.col(frame[0]) * F.col(frame[1])) * class_factor(F.col("cls_id"))
    key = F.struct(score.alias("score"), (-F.col("ord")).alias("o"), *(F.col(c).cast("long").alias(c) for c in "xywh"), class_name(F.col("cls_id")).alias("kind"), "conf")
    best = detections.groupBy(image, *frame).agg(F.max(key).alias("b"), F.count("*").alias("n")).where("b.score > 0")
    return best.select(image, *frame, *(F.col(f"b.{c}").alias(f"s_{c}") for c in "xywh"), F.col("b.kind").alias("kind"), F.col("b.conf").alias("conf"), "n")


def merged_subjects(detections: DataFrame, image: str, frame: list[str]) -> DataFrame:
    """subjects(), with a person and a motorcycle that overlap or stand close joined to one rider_motorcycle.

    Of counterparts the one of greatest conf * (1 + 1.8 iou - 0.8 distance) above 0 joins, of equal ones the first.
    Detections of one image meet its subject only: an equi-join and an aggregation.
    """
    best = subjects(detections, image, frame)
    other = detections.select(F.col(image).alias("__image"), F.col("ord").alias("__ord"), class_name(F.col("cls_id")).alias("d_kind"), F.col("conf").alias("d_conf"), *(F.col(c).cast("long").alias(f"d_{c}") for c in "xywh"))
    wanted = F.when(F.col("kind") == "person", "motorcycle").when(F.col("kind") == "motorcycle", "person")
    s, d = geo.box("s"), geo.box("d")
    overlap, apart = geo.iou(s, d), geo.centre_distance(s, d, F.col(frame[0]), F.col(frame[1]))
    pair = best.join(other, (F.col(image) == F.col("__image")) & (F.col("d_kind") == wanted))
    pair = pair.withColumns({"overlap": overlap, "apart": apart}).where((F.col("overlap") >= MIN_IOU) | (F.col("apart") <= MAX_DISTANCE))
    pair = pair.withColumn("pair_score", F.col("d_conf") * (1 + F.col("overlap") * IOU_GAIN - F.col("apart") * DISTANCE_LOSS)).where("pair_score > 0")
    key = F.struct("pair_score", (-F.col("__ord")).alias("o"), "d_conf", *(f"d_{c}" for c in "xywh"))
    joined = pair.groupBy(F.col(image).alias("__image")).agg(F.max(key).alias("p"))
    both = best.join(joined, F.col(image) == F.col("__image"), "left").select("*", *(F.col(f"p.d_{c}").alias(f"d_{c}") for c in "xywh"))
    u = geo.union(s, d)
    found = F.col("p").isNotNull()
    return both.select(image, *frame, *(F.when(found, v).otherwise(F.col(f"s_{c}")).alias(f"s_{c}") for c, v in zip("xywh", u, strict=True)), F.when(found, "rider_motorcycle").otherwise(F.col("kind")).alias("kind"), F.when(found, F.greatest("conf", "p.d_conf")).otherwise(F.col("conf")).alias("conf"), "n")


def with_fallback(images: DataFrame, found: DataFrame, image: str, frame: list[str]) -> DataFrame:
    """images with a subject each: the detected box with room around it, else the saliency box (f_x..f_h) as it is, else the middle of the frame; method says which."""
    w, h = F.col(frame[0]), F.col(frame[1])
    room = geo.expanded(geo.box("s"), F.col("kind"), w, h)
    both = images.join(found.select(F.col(image).alias("__image"), "s_x", "s_y", "s_w", "s_h", "kind", "conf"), F.col(image) == F.col("__image"), "left")
    detected, salient = F.col("s_x").isNotNull(), F.col("f_x").isNotNull()
    middle = geo.Box(F.floor(w / 4), F.floor(h / 4), F.floor(w / 2), F.floor(h / 2))
    sides = {f"b_{c}": F.when(detected, r).when(salient, F.col(f"f_{c}")).otherwise(m).cast("long") for c, r, m in zip("xywh", room, middle, strict=True)}
    return both.select(image, *frame, *(v.alias(k) for k, v in sides.items()), F.coalesce("kind", F.lit("")).alias("kind"), F.when(detected, "detector").when(salient, "saliency").otherwise("center").alias("method"))
