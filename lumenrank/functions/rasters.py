"""Picture metrics on arrays of pixel values, row by row; borders mirror without repeating the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrank.functions.numeric import array_mean, band

# Fixed values.
SHARP, SHARP_WIDTH = 500.0, 1080.0
LUMINANCE = ((90.0, 170.0), (60.0, 200.0), (1.0, 0.7, 0.4))


def mirrored(i: Column, n: int) -> Column:
    """An index one beyond a border, folded back inside."""
    return F.when(i < 0, -i).when(i >= n, F.lit(2 * n - 2) - i).otherwise(i)


def _pixel(a: Column, y: Column, x: Column, w: int, h: int) -> Column:
    return F.get(a, (mirrored(y, h) * w + mirrored(x, w)).cast("int"))


def _stencil(a: Column, w: int, h: int, f) -> Column:
    """f(pixel at offset (dy, dx)) for each pixel."""

    def at(i: Column) -> Column:
        y, x = F.floor(i / w), F.pmod(i, F.lit(w))
        return f(lambda dy, dx: _pixel(a, y + F.lit(dy), x + F.lit(dx), w, h))

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), at)


def laplacian(a: Column, w: int, h: int) -> Column:
    return _stencil(a, w, h, lambda p: p(-1, 0) + p(1, 0) + p(0, -1) + p(0, 1) - 4 * p(0, 0))


def gradient(a: Column, w: int, h: int) -> Column:
    """Absolute central differences in both directions, summed: the measure of edges here."""
    return _stencil(a, w, h, lambda p: F.abs(p(0, 1) - p(0, -1)) + F.abs(p(1, 0) - p(-1, 0)))


def horizontal(a: Column, w: int, h: int) -> Column:
    """Sobel derivative from left to right, 3 by 3."""
    return _stencil(a, w, h, lambda p: p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1))


def mask(x: Column, y: Column, bw: Column, bh: Column, w: int, h: int) -> Column:
    """Array of 1.0 inside a box and 0.0 outside; a null box gives null."""
    inside = lambda i: F.when(F.pmod(i, F.lit(w)).between(x, x + bw - 1) & F.floor(i / w).between(y, y + bh - 1), 1.0).otherwise(0.0)
    return F.when(x.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), inside))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def masked_mean(a: Column, m: Column) -> Column:
    """Mean of a where m is 1; an empty mask counts one pixel."""
    both = F.zip_with(a, m, lambda v, k: F.struct((v * k).alias("v"), k.alias("k")))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    return F.aggregate(both, start, lambda t, p: F.struct((t["s"] + p["v"]).alias("s"), (t["n"] + p["k"]).alias("n")), lambda t: t["s"] / F.greatest(t["n"], F.lit(1.0)))


def inverse(m: Column) -> Column:
    return F.transform(m, lambda k: 1 - k)


def variance(a: Column) -> Column:
    """Population variance, in one pass over sums: pixel values are small whole numbers, so the sums are exact."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    step = lambda t, v: F.struct((t["n"] + 1).alias("n"), (t["s"] + v).alias("s"), (t["q"] + v * v).alias("q"))
    return F.aggregate(a, start, step, lambda t: F.greatest(F.lit(0.0), F.try_divide(t["q"] - t["s"] * t["s"] / t["n"], t["n"])))


def energy(lap: Column, m: Column) -> Column:
    """Sharpness before scaling: mean square under the mask, or the variance of the whole without one."""
    return F.when(m.isNull(), variance(lap)).otherwise(masked_mean(F.transform(lap, lambda v: v * v), m))


def sharpness(lap_energy: Column, width: float) -> Column:
    return F.least(lap_energy / (SHARP * width / SHARP_WIDTH), F.lit(1.0))


def background_separation(lap: Column, m: Column) -> Column:
    """How much sharper the subject is than what is behind it; 0.5 without a subject."""
    squares = F.transform(lap, lambda v: v * v)
    ratio = masked_mean(squares, m) / F.greatest(masked_mean(squares, inverse(m)), F.lit(1e-6))
    return F.when(m.isNull(), 0.5).otherwise(F.least(ratio / 5, F.lit(1.0)))


def lighting(gray: Column) -> Column:
    """Mean luminance in a good range, less what is clipped at either end."""
    n = F.size(gray).cast("double")
    clipped = F.size(F.filter(gray, lambda v: (v < 5) | (v >= 250))) / n
    return band(array_mean(gray), *LUMINANCE) * (1 - F.least(clipped, F.lit(0.04)) / 0.04)


def colourfulness(r: Column, g: Column, b: Column) -> Column:
    """Spread and mean of the two opponent channels."""
    rg = F.zip_with(r, g, lambda x, y: x - y)
    yb = F.zip_with(F.zip_with(r, g, lambda x, y: (x + y) / 2), b, lambda x, y: x - y)
    spread = F.sqrt(variance(rg) + variance(yb))
    mean = F.sqrt(F.pow(array_mean(rg), 2) + F.pow(array_mean(yb), 2))
    return F.least((spread + 0.3 * mean) / 80, F.lit(1.0))


def _pixels(r: Column, g: Column, b: Column) -> Column:
    return F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue of each pixel in half degrees, [0, 180); 0 for greys."""

    def one(p: Column) -> Column:
        x, y, z = p["r"], p["g"], p["b"]
        top, low = F.greatest(x, y, z), F.least(x, y, z)
        d = top - low
        deg = F.when(d == 0, 0.0).when(top == x, 60 * F.try_divide(y - z, d)).when(top == y, 120 + 60 * F.try_divide(z - x, d)).otherwise(240 + 60 * F.try_divide(x - y, d))
        return F.when(deg < 0, deg + 360).otherwise(deg) / 2

    return F.transform(_pixels(r, g, b), one)


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Saturation of each pixel, 0 to 255."""
    one = lambda p: F.coalesce(F.try_divide(255 * (F.greatest(p["r"], p["g"], p["b"]) - F.least(p["r"], p["g"], p["b"])), F.greatest(p["r"], p["g"], p["b"])), F.lit(0.0))
    return F.transform(_pixels(r, g, b), one)


def hue_difference(a: Column, b: Column) -> Column:
    """Share of a good contrast of two hues on the circle."""
    d = F.abs(a - b)
    return F.least(F.when(d > 90, 180 - d).otherwise(d) / 60, F.lit(1.0))


def hue_contrast(hues: Column, m: Column) -> Column:
    return F.when(m.isNull(), 0.5).otherwise(hue_difference(masked_mean(hues, m), masked_mean(hues, inverse(m))))


def clutter(grad: Column, m: Column, threshold: float) -> Column:
    """1 less ten times the share of edge pixels behind the subject."""
    edge = F.transform(grad, lambda v: F.when(v > threshold, 1.0).otherwise(0.0))
    share = F.when(m.isNull(), array_mean(edge)).otherwise(masked_mean(edge, inverse(m)))
    return F.greatest(F.lit(0.0), 1 - 10 * share)


def aesthetic(gray: Column, sat: Column) -> Column:
    """Contrast, and saturation near the middle."""
    return 0.5 * F.least(F.sqrt(variance(gray)) / 80, F.lit(1.0)) + 0.5 * (1 - 2 * F.abs(array_mean(sat) / 255 - 0.5))


def column_energy(a: Column, w: int, first: int, last: int) -> Column:
    """Mean of the columns first..last (inclusive) of a raster."""
    pick = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.when(F.pmod(i, F.lit(w)).between(first, last), F.get(a, i)))
    return array_mean(F.filter(pick, lambda v: v.isNotNull()))


def facing(edge_left: Column, edge_right: Column, rising: Column, falling: Column) -> Column:
    """Where a subject looks: by edges in the outer thirds, then by the sign of the gradient; a lead of 5 % decides."""
    return F.when(edge_left > edge_right * 1.05, "left").when(edge_right > edge_left * 1.05, "right").when(rising > falling * 1.05, "right").when(falling > rising * 1.05, "left").otherwise("head-on")
