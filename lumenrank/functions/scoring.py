"""Blending of technical and model scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights sum to 1.
WEIGHTS = {"sharpness": 0.18, "background_sep": 0.12, "composition": 0.20, "lighting": 0.18, "color_harmony": 0.13, "visual_clutter": 0.12, "aesthetic": 0.07}
TECHNICAL_SHARE, MODEL_SHARE, FULL_TOTAL, DEFAULT_TOTAL = 0.3, 0.7, 60.0, 30.0
GATE = ((4.0, 0.15), (5.0, 0.35), (6.0, 0.60), (7.0, 0.80))
GATED_SCORERS = ("claude", "ollama")
CROP_SAFE = 6.0
COST_PER_ITEM = 0.005


def composite(metric=F.col) -> Column:
    """Weighted sum of the seven metrics; a missing one counts 0."""
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + F.coalesce(metric(name), F.lit(0.0)) * F.lit(weight)
    return out


def gate(crop: Column) -> Column:
    """Factor by how well an item can be cropped; unknown counts as 0."""
    crop, out = F.coalesce(crop.cast("double"), F.lit(0.0)), F.when(F.lit(False), F.lit(0.0))
    for most, factor in GATE:
        out = out.when(crop <= most, factor)
    return out.otherwise(1.0)


def final_score(technical: Column, total: Column, crop: Column, scorer: Column, failed: Column, available: Column) -> Column:
    """The blend; without a working scorer the technical score alone; a failed item keeps its technical share only."""
    blend = technical * TECHNICAL_SHARE + F.coalesce(total.cast("double"), F.lit(DEFAULT_TOTAL)) / FULL_TOTAL * MODEL_SHARE
    gated = F.when(scorer.isin(*GATED_SCORERS), blend * gate(crop)).otherwise(blend)
    return F.when(~available, technical).when(failed, technical * TECHNICAL_SHARE).otherwise(gated)


def crop_safe(crop: Column) -> Column:
    return F.coalesce(crop.cast("double"), F.lit(0.0)) >= CROP_SAFE


def clip_payload(logits: Column) -> dict[str, Column]:
    """Scores from six logits, four of good prompts and two of bad ones; sub-scores may leave 0..10."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    p = [F.get(e, F.lit(i)) / z for i in range(6)]
    both = (p[0] + p[1] + p[2] + p[3]) / 4 - (p[4] + p[5]) / 2
    whole = lambda x: x.cast("long")  # noqa: E731  cut towards zero
    total = F.least(F.greatest(whole(both * 120 + 30), F.lit(0)), F.lit(60))
    return {"subject_clarity": whole(p[0] * 30 + 3), "lighting": whole(p[0] * 20 + 3), "color_pop": whole(p[2] * 20 + 3), "emotion": whole(p[3] * 20 + 3), "scroll_stop": whole(both * 20 + 5), "crop_4x5": F.lit(5).cast("long"), "total": total}
