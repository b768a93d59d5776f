"""One decoded picture at a time, as arrays: sizes of any kind, blue first. The column functions of rasters.py say the same for small ones."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lumenrank.functions.scoring import WEIGHTS

# Fixed values.
GRAY = (1868, 9617, 4899)  # of blue, green and red, in 1 / 2**14
SOBEL_3 = ((1, 2, 1), (-1, 0, 1))
SOBEL_5 = ((1, 4, 6, 4, 1), (-1, -2, 0, 2, 1))
EDGES = (50, 150)
LINE_VOTES, LINE_GAP, LINE_SHARE, LEVEL = 100, 20, 4, 15.0
SHARP, SHARP_WIDTH = 500.0, 1080.0
THIRDS, PHI, SPREAD = (0.333, 0.667), (0.382, 0.618), 0.12
LEAD, LUMINANCE = ((0.55, 0.75), (0.45, 0.85), (1.0, 0.7, 0.3)), ((90.0, 170.0), (60.0, 200.0), (1.0, 0.7, 0.4))
HASH_SIDE, HASH_FACTOR = 16, 4
THUMB, BINS = 256, 8
KEYPOINTS, PATCH, POINT_SIDE = 500, 31, 512


def picture(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) of 8 bits from rows of pixels; one channel is grey, a fourth is dropped."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def gray(a: np.ndarray) -> np.ndarray:
    """Luminance in whole numbers."""
    return ((a.astype(np.int64) @ np.array(GRAY) + (1 << 13)) >> 14).astype(np.float64)


def _mirrored(a: np.ndarray, by: int) -> np.ndarray:
    return np.pad(a, by, mode="reflect" if min(a.shape) > by else "edge")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _mirrored(g, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def sobel(g: np.ndarray, across: bool, kernel=SOBEL_3) -> np.ndarray:
    """Derivative from left to right, or from top to bottom."""
    smooth, slope = (np.array(k, float) for k in kernel)
    rows, cols = (smooth, slope) if across else (slope, smooth)
    by = len(smooth) // 2
    p = _mirrored(g, by)
    h, w = g.shape
    half = sum(k * p[i : i + h] for i, k in enumerate(rows))
    return sum(k * half[:, i : i + w] for i, k in enumerate(cols))


def edges(g: np.ndarray, low: float = EDGES[0], high: float = EDGES[1]) -> np.ndarray:
    """Edge pixels by gradient, thinned across it; weak ones count if they touch strong ones."""
    gx, gy = sobel(g, True), sobel(g, False)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    flat, steep = np.abs(gy) <= np.abs(gx) * np.tan(np.pi / 8), np.abs(gy) >= np.abs(gx) * np.tan(3 * np.pi / 8)
    same = (gx >= 0) == (gy >= 0)
    before = np.select([flat, steep, same], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, same], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    thin = (size > before) & (size >= after)
    weak, strong = thin & (size > low), thin & (size > high)
    while True:  # grow strong edges along weak ones
        q = np.pad(strong, 1)
        grown = weak & np.logical_or.reduce([q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        if (grown == strong).all():
            return strong
        strong = grown


def level_lines(edge: np.ndarray) -> list[float]:
    """Degrees off level of the long straight segments that are near level: votes by angle and distance, then the longest run of each line.

    Every edge pixel votes (no sampling), so equal pictures have equal lines.
    """
    h, w = edge.shape
    y, x = np.nonzero(edge)
    out: list[float] = []
    for tilt in np.arange(-int(LEVEL) + 1, int(LEVEL)):
        t = np.deg2rad(tilt)
        dist = np.rint(y * np.cos(t) - x * np.sin(t)).astype(int)
        along = np.rint(x * np.cos(t) + y * np.sin(t)).astype(int)
        votes = np.bincount(dist - dist.min()) if len(dist) else np.zeros(0, int)
        for d in np.flatnonzero(votes >= LINE_VOTES):
            if d and votes[d] < votes[d - 1] or d + 1 < len(votes) and votes[d] < votes[d + 1]:
                continue  # a neighbour says it better
            s = np.sort(along[dist - dist.min() == d])
            cuts = np.flatnonzero(np.r_[True, np.diff(s) > LINE_GAP, True])
            if max(s[b - 1] - s[a] for a, b in zip(cuts[:-1], cuts[1:], strict=True)) >= w / LINE_SHARE:
                out.append(abs(float(tilt)))
    return out


def tilt_score(lines: list[float]) -> float:
    if not lines:
        return 0.8
    m = float(np.median(lines))
    return 1.0 if m <= 2 else max(0.0, 1 - (m - 2) / 10)


def banded(v: float, inner, outer, scores) -> float:
    return scores[0] if inner[0] <= v <= inner[1] else scores[1] if outer[0] <= v <= outer[1] else scores[2]


def hsv(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hue in half degrees, saturation of 255)."""
    b, g, r = (a[:, :, i].astype(float) for i in range(3))
    top, low = a.max(axis=2).astype(float), a.min(axis=2).astype(float)
    d = np.where(top > low, top - low, 1.0)
    deg = np.select([top == low, top == r, top == g], [0.0, 60 * (g - b) / d, 120 + 60 * (b - r) / d], 240 + 60 * (r - g) / d)
    return np.where(deg < 0, deg + 360, deg) / 2, np.where(top > 0, 255 * (top - low) / np.where(top > 0, top, 1), 0.0)


def metrics(a: np.ndarray, box: tuple[int, int, int, int] | None = None) -> dict[str, float]:
    """The seven metrics and their weighted sum; box (x, y, w, h) holds the subject, if one is known."""
    h, w = a.shape[:2]
    g = gray(a)
    mask = None
    if box is not None:
        x, y, bw, bh = box
        mask = np.zeros((h, w), bool)
        mask[max(y, 0) : max(y + bh, 0), max(x, 0) : max(x + bw, 0)] = True
        mask = mask if mask.any() else None
    mean = lambda v, m: float(v[m].mean()) if m.any() else 0.0
    lap2 = laplacian(g)
    spread = float(lap2.var())
    lap2 **= 2
    energy = spread if mask is None else mean(lap2, mask)
    cx, cy = (0.5, 0.5) if mask is None else (float(v.mean()) / n for v, n in zip(np.nonzero(mask)[::-1], (w, h), strict=True))
    near = min(np.hypot(cx - px, cy - py) for grid in (THIRDS, PHI) for px in grid for py in grid)
    edge = edges(g)
    right = mask is not None and float((sobel(g, True, SOBEL_5) * mask).mean()) >= 0
    lead = 0.5 if mask is None else banded(1 - cx if right else cx, *LEAD)
    clipped = float(((g < 5) | (g >= 250)).mean())
    b, gr, r = (a[:, :, i].astype(float) for i in range(3))
    rg, yb = r - gr, (r + gr) / 2 - b
    colour = min((np.sqrt(rg.var() + yb.var()) + 0.3 * np.hypot(rg.mean(), yb.mean())) / 80, 1.0)
    hue, sat = hsv(a)
    apart = abs(mean(hue, mask) - mean(hue, ~mask)) if mask is not None else 0.0
    contrast = 0.5 if mask is None else min((180 - apart if apart > 90 else apart) / 60, 1.0)
    out = {
        "sharpness": min(energy / (SHARP * w / SHARP_WIDTH), 1.0),
        "background_sep": 0.5 if mask is None else min(mean(lap2, mask) / max(mean(lap2, ~mask), 1e-6) / 5, 1.0),
        "composition": 0.5 * float(np.exp(-0.5 * (near / SPREAD) ** 2)) + 0.25 * tilt_score(level_lines(edge)) + 0.25 * lead,
        "lighting": banded(float(g.mean()), *LUMINANCE) * (1 - min(clipped, 0.04) / 0.04),
        "color_harmony": float(0.6 * colour + 0.4 * contrast),
        "visual_clutter": max(0.0, 1 - 10 * float((edge & ~mask).mean() if mask is not None else edge.mean())),
        "aesthetic": 0.5 * min(float(g.std()) / 80, 1.0) + 0.5 * (1 - 2 * abs(float(sat.mean()) / 255 - 0.5)),
    }
    out["composite"] = sum(out[k] * v for k, v in WEIGHTS.items())
    return out


def resampled(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """a at another size, by Lanczos windows of three lobes that widen where it shrinks; rounded to 8 bits after each direction."""

    def one(v: np.ndarray, n: int) -> np.ndarray:
        size = v.shape[0]
        if size == n:
            return v
        scale = size / n
        wide = 3 * max(scale, 1.0)
        out = np.empty((n, *v.shape[1:]))
        for i in range(n):
            centre = (i + 0.5) * scale
            lo, hi = max(int(centre - wide + 0.5), 0), min(int(centre + wide + 0.5), size)
            t = (np.arange(lo, hi) + 0.5 - centre) / max(scale, 1.0)
            k = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
            out[i] = np.tensordot(k / k.sum(), v[lo:hi], axes=1)
        return np.clip(np.rint(out), 0, 255)

    across = one(np.swapaxes(a.astype(float), 0, 1), width)
    return one(np.swapaxes(across, 0, 1), height).astype(np.uint8)


def oriented(a: np.ndarray, orientation: int | None) -> np.ndarray:
    """A picture as it is meant to be seen, by the tag's eight values."""
    if orientation in (5, 6, 7, 8):
        a = np.swapaxes(a, 0, 1)
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    return np.ascontiguousarray(a)


def shrunk_size(width: int, height: int, limit: int) -> tuple[int, int]:
    longest = max(width, height)
    return (width, height) if longest <= limit else (max(1, int(width * (limit / longest))), max(1, int(height * (limit / longest))))


def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(n)[:, None] / (2 * n))


def perceptual_hash(a: np.ndarray) -> list[int]:
    """256 bits in four words: which of the lowest 16 by 16 frequencies of the small grey picture lie above their median; the first bit is the highest of the first word."""
    side = HASH_SIDE * HASH_FACTOR
    small = resampled(gray(a), side, side).astype(float)
    c = _cosines(side)[:HASH_SIDE]
    low = c @ small @ c.T
    bits = np.packbits(low > np.median(low))
    return [int(x) for x in bits.view(">i8")]


def quick_sharpness(a: np.ndarray) -> float:
    return float(laplacian(gray(a)).var())


def histogram(a: np.ndarray) -> list[float]:
    """8 by 8 by 8 shares of colours of a 256 by 256 thumbnail, scaled to length 1."""
    small = resampled(a, THUMB, THUMB).astype(int) // (256 // BINS)
    n = np.bincount(((small[:, :, 0] * BINS + small[:, :, 1]) * BINS + small[:, :, 2]).ravel(), minlength=BINS**3).astype(float)
    return (n / np.sqrt((n * n).sum())).tolist()


def descriptors(a: np.ndarray) -> list[bytes]:
    """256-bit descriptors of up to 500 corners of a 512 by 512 grey picture: signs of fixed pairs of points, turned with the patch.

    Corners by the smaller eigenvalue of the local gradients, the strongest of each 3 by 3 first. The pairs are our own
    (drawn once), so descriptors compare with each other, not with those of an imaging library.
    """
    g = resampled(gray(a), POINT_SIDE, POINT_SIDE).astype(float)
    gx, gy = sobel(g, True), sobel(g, False)

    def box(v: np.ndarray, by: int) -> np.ndarray:
        c = np.pad(np.pad(v, by, mode="reflect").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        n = 2 * by + 1
        return c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]

    xx, yy, xy = box(gx * gx, 3), box(gy * gy, 3), box(gx * gy, 3)
    least = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    p = np.pad(least, 1, constant_values=-1)
    peak = least >= np.max([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    by = PATCH // 2 + 1
    inside = np.zeros_like(peak)
    inside[by:-by, by:-by] = True
    y, x = np.nonzero(peak & inside & (least > 1e3))
    first = np.argsort(-least[y, x], kind="stable")[:KEYPOINTS]
    y, x = y[first], x[first]
    smooth = box(g, 2) / 25
    r = PATCH // 2
    oy, ox = np.mgrid[-r : r + 1, -r : r + 1]
    disc = oy * oy + ox * ox <= r * r
    pairs = np.clip(np.random.default_rng(31).normal(0, PATCH / 5, (256, 4)), -r * 0.7, r * 0.7)
    out = []
    for cy, cx in zip(y.tolist(), x.tolist(), strict=True):
        patch = g[cy - r : cy + r + 1, cx - r : cx + r + 1] * disc
        t = np.arctan2((patch * oy).sum(), (patch * ox).sum())
        c, s = np.cos(t), np.sin(t)
        at = lambda px, py: smooth[cy + np.rint(s * px + c * py).astype(int), cx + np.rint(c * px - s * py).astype(int)]  # noqa: B023, E731
        out.append(np.packbits(at(pairs[:, 0], pairs[:, 1]) < at(pairs[:, 2], pairs[:, 3])).tobytes())
    return out


def match_share(a: list[bytes], b: list[bytes], limit: int = 50) -> float:
    """Of descriptors that are each other's nearest the share closer than limit bits; 0 without any."""
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(b"".join(d), np.uint64).reshape(len(d), -1) for d in (a, b))
    apart = np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(axis=2)
    there, back = apart.argmin(axis=1), apart.argmin(axis=0)
    mutual = np.flatnonzero(back[there] == np.arange(len(x)))
    return float((apart[mutual, there[mutual]] < limit).mean()) if len(mutual) else 0.0


def correlation(a: list[float], b: list[float]) -> float:
    """Pearson's r of two histograms; 1 where either has no spread."""
    x, y = (np.array(v) - np.mean(v) for v in (a, b))
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / n) if n > 0 else 1.0


def png(a: np.ndarray) -> bytes:
    """A PNG file of a picture."""
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(a[:, :, ::-1]).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def padded(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """The whole picture scaled into a frame, in front of itself blurred."""
    h, w = a.shape[:2]
    scale = min(width / w, height / h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
    back = resampled(resampled(a, max(1, height // 32), max(1, width // 32)), height, width)
    y, x = (height - nh) // 2, (width - nw) // 2
    back[y : y + nh, x : x + nw] = resampled(a, nh, nw)
    return back


# Tags of the format: number -> name, in the main and in the second directory.
_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "modified", 0x829A: "exposure", 0x829D: "f_number", 0x8827: "iso", 0x9003: "original", 0x9291: "subsecond", 0x920A: "focal", 0xA434: "lens"}
_MORE = 0x8769
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(content: bytes) -> dict[str, object]:
    """The tags of a JPEG or PNG file that are used here; what cannot be read is left out."""
    at = -1
    if content[:2] == b"\xff\xd8":
        i = 2
        while i + 4 <= len(content) and content[i] == 0xFF and content[i + 1] != 0xDA:
            size = int.from_bytes(content[i + 2 : i + 4], "big")
            if content[i + 1] == 0xE1 and content[i + 4 : i + 10] == b"Exif\0\0":
                at = i + 10
                break
            i += 2 + max(size, 2)
    elif content[:4] == b"\x89PNG":
        i = 8
        while i + 8 <= len(content):
            if content[i + 4 : i + 8] == b"eXIf":
                at = i + 8
                break
            i += 12 + int.from_bytes(content[i : i + 4], "big")
    t = content[at:] if at >= 0 else b""
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(t[:4])
    out: dict[str, object] = {}
    if order is None:
        return out
    number = lambda s: int.from_bytes(s, order)
    todo, seen = [number(t[4:8])], set()
    while todo:
        d = todo.pop()
        if d in seen or d + 2 > len(t):
            continue
        seen.add(d)
        for k in range(number(t[d : d + 2])):
            e = t[d + 2 + 12 * k : d + 14 + 12 * k]
            if len(e) < 12:
                break
            tag, kind, n = number(e[:2]), number(e[2:4]), number(e[4:8])
            size = _SIZES.get(kind, 0) * n
            v = e[8 : 8 + size] if size <= 4 else t[number(e[8:12]) : number(e[8:12]) + size]
            if tag == _MORE:
                todo.append(number(e[8:12]))
            elif tag in _TAGS and size and len(v) == size:
                if kind == 2:
                    out[_TAGS[tag]] = v.split(b"\0")[0].decode("utf-8", "replace").strip()
                elif kind in (5, 10):
                    den = number(v[4:8])
                    if den:
                        out[_TAGS[tag]] = number(v[:4]) / den
                elif kind in (3, 4):
                    out[_TAGS[tag]] = number(v[: _SIZES[kind]])
    return out
