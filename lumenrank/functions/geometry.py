"""Boxes (x, y, w, h in pixels) and where a subject stands in a frame."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrank.functions.numeric import band, half_even_int

# Fixed values.
THIRDS, PHI = (0.333, 0.667), (0.382, 0.618)
SPREAD = 0.12
PAD = {"rider_motorcycle": (0.10, 0.08), "motorcycle": (0.08, 0.07)}
PAD_OTHER, PAD_LEAST = 0.06, 12
SHOTS = ((0.50, "close-up"), (0.20, "medium"), (0.10, "environmental"), (0.05, "scenic"))
WIDEST = "extreme_wide"
LEAD = ((0.55, 0.75), (0.45, 0.85), (1.0, 0.7, 0.3))


class Box(NamedTuple):
    """A box of columns."""

    x: Column
    y: Column
    w: Column
    h: Column

    def struct(self) -> Column:
        return F.struct(*(c.cast("long").alias(n) for n, c in zip("xywh", self, strict=True)))


def box(name: str) -> Box:
    """The box in columns name_x ... name_h, or in a struct column if name ends with a dot."""
    return Box(*(F.col(f"{name}{c}" if name.endswith(".") else f"{name}_{c}") for c in "xywh"))


def iou(a: Box, b: Box) -> Column:
    """Shared area over joint area; 0 without overlap."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    inner = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    joint = a.w * a.h + b.w * b.h - inner
    return F.when((inner > 0) & (joint > 0), inner / joint).otherwise(0.0)


def centre_distance(a: Box, b: Box, frame_w: Column, frame_h: Column) -> Column:
    """Distance of the centres over the diagonal of the frame."""
    dx, dy = (p + q / 2 - (r + s / 2) for p, q, r, s in ((a.x, a.w, b.x, b.w), (a.y, a.h, b.y, b.h)))
    return F.hypot(dx, dy) / F.greatest(F.hypot(frame_w.cast("double"), frame_h.cast("double")), F.lit(1.0))


def union(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.x + a.w, b.x + b.w) - x, F.greatest(a.y + a.h, b.y + b.h) - y)


def expanded(b: Box, kind: Column, frame_w: Column, frame_h: Column) -> Box:
    """A detected box with room around it, by its kind, inside the frame."""

    def ratio(i: int) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for name, pads in PAD.items():
            out = out.when(kind == name, pads[i])
        return out.otherwise(PAD_OTHER)

    px, py = (F.greatest(F.lit(PAD_LEAST).cast("long"), half_even_int(side * ratio(i))) for i, side in enumerate((b.w, b.h)))
    x, y = F.greatest(b.x - px, F.lit(0)), F.greatest(b.y - py, F.lit(0))
    right, low = F.least(frame_w, b.x + b.w + px), F.least(frame_h, b.y + b.h + py)
    return Box(x, y, F.greatest(right - x, F.lit(1)), F.greatest(low - y, F.lit(1)))


def placement(cx: Column, cy: Column) -> Column:
    """1 on one of eight power points, falling off as a Gaussian."""
    near = F.least(*(F.hypot(cx - F.lit(x), cy - F.lit(y)) for grid in (THIRDS, PHI) for x in grid for y in grid))
    return F.exp(F.lit(-0.5) * F.pow(near / F.lit(SPREAD), 2))


def lead_room(ahead: Column) -> Column:
    return band(ahead, *LEAD)


def shot_type(share: Column) -> Column:
    """Name of the shot by the share of the frame that the subject fills."""
    out = F.when(F.lit(False), F.lit(""))
    for least, name in SHOTS:
        out = out.when(share >= least, name)
    return out.otherwise(WIDEST)


def ideal_x(facing: Column, shot: Column) -> Column:
    return F.when(shot.isin("close-up", WIDEST), 0.50).when(facing == "right", 0.35).when(facing == "left", 0.65).otherwise(0.50)


def ideal_y(shot: Column) -> Column:
    return F.when(shot.isin("environmental", "scenic", WIDEST), 0.62).otherwise(0.50)


def position_words(cx: Column, cy: Column) -> Column:
    """Such as top-left; the middle of both is "centered"."""
    h = F.when(cx < 0.33, "left").when(cx > 0.66, "right").otherwise("center")
    v = F.when(cy < 0.33, "top").when(cy > 0.66, "bottom").otherwise("middle")
    return F.when((h == "center") & (v == "middle"), "centered").otherwise(F.concat_ws("-", v, h))


def size_words(share: Column) -> Column:
    return F.when(share > 0.3, "large").when(share > 0.1, "medium").otherwise("small")


def tilt_angle(dx: Column, dy: Column) -> Column:
    """Degrees off level of a segment that is near level, else null."""
    a = F.abs(F.degrees(F.atan2(dy, dx)))
    return F.when((a < 15) | (a > 165), F.least(a, 180 - a))


def tilt_score(median: Column) -> Column:
    """1 up to two degrees, then falling; 0.8 if no line is known."""
    return F.when(median.isNull(), 0.8).when(median <= 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (median - 2) / 10))
