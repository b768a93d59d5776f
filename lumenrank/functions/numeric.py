"""Rounding, clamping, casting and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even_int(x: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.bround(x, 0).cast("long")


def clamp(x: Column, lo, hi) -> Column:
    """x within [lo, hi]; a null x stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def safe_number(text: Column, default: float) -> Column:
    """A number read from text, or the default where there is none."""
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def shrunk(width: Column, height: Column, limit: int, least: int = 0) -> Column:
    """struct(w, h): sizes whose longer edge is at most limit, cut to whole pixels."""
    longest = F.greatest(width, height)
    scale = F.when(longest > limit, F.lit(float(limit)) / longest).otherwise(F.lit(1.0))
    side = lambda v: F.greatest((v * scale).cast("long"), F.lit(least).cast("long"))
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def fitted(width: Column, height: Column, out_w: int, out_h: int) -> Column:
    """struct(w, h, x, y): the whole picture scaled into a frame, and its centred offset."""
    scale = F.least(F.lit(float(out_w)) / width, F.lit(float(out_h)) / height)
    w, h = (F.greatest((v * scale).cast("long"), F.lit(1).cast("long")) for v in (width, height))
    return F.struct(w.alias("w"), h.alias("h"), F.floor((F.lit(out_w) - w) / 2).alias("x"), F.floor((F.lit(out_h) - h) / 2).alias("y"))


def backoff(base: Column, attempt: Column) -> Column:
    """Seconds before the next attempt: doubled each time."""
    return base * F.pow(F.lit(2.0), attempt)


def band(x: Column, inner: tuple[float, float], outer: tuple[float, float], values: tuple[float, float, float]) -> Column:
    """One of three values: within the inner range, within the outer, or beyond; ends belong to the range."""
    return F.when(x.between(*inner), values[0]).when(x.between(*outer), values[1]).otherwise(values[2])


def array_mean(a: Column) -> Column:
    """Mean of an array, null if it is empty."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    return F.aggregate(a, start, lambda t, x: F.struct((t["s"] + x).alias("s"), (t["n"] + 1).alias("n")), lambda t: F.try_divide(t["s"], t["n"]))


def array_median(a: Column) -> Column:
    """Median of an array: the mean of the middle two if their number is even, null if it is empty."""
    s, n = F.array_sort(a), F.size(a)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
