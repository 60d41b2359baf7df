"""The feature bank in tile form: each task gets tiles with a halo, computes every feature in numpy and emits an array a pixel.

Features read true neighbours across tile borders; only the image's own border is mirrored. What needs a whole image (the largest
smoothed value, the strongest ridge) is an aggregate over its tiles that is joined back, so results do not depend on the tiles."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.operators import border, features
from gridloom.sources.raster import workers_find_package


def windows(a: np.ndarray, k: int, axis: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, k, axis=axis)


def correlate(a: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Where the taps fit whole."""
    return windows(a, len(taps), axis) @ np.asarray(taps)


def correlate_same(a: np.ndarray, taps: np.ndarray, axis: int, mode: str, before: int | None = None) -> np.ndarray:
    """Same size; the taps start before places ahead of a pixel; beyond the array there are its edge values or zeros."""
    before = len(taps) // 2 if before is None else before
    pad = [(0, 0)] * a.ndim
    pad[axis] = (before, len(taps) - 1 - before)
    return correlate(np.pad(a, pad, mode=mode), taps, axis)


def next_regular(n: int) -> int:
    """The least number from n on without prime factors above 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def convolve_all(a: np.ndarray, kernels: list[np.ndarray], inner: int):
    """Convolutions of a with odd square kernels by one transform of a each way; the part inner pixels from the border."""
    h, w = a.shape
    most = max(len(k) for k in kernels)
    size = (next_regular(h + most - 1), next_regular(w + most - 1))
    fa = np.fft.rfft2(a, size)
    for k in kernels:
        at = len(k) // 2 + inner
        yield np.fft.irfft2(fa * np.fft.rfft2(k, size), size)[at : at + h - 2 * inner, at : at + w - 2 * inner]


def generic_filter(a: np.ndarray, size: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f of every window of a, windows in the last two axes; the features first."""
    return np.moveaxis(f(windows(windows(a, size, 0), size, 1)), -1, 0)


def u8_steps(a: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(a, 0, 1) * 255) / 255


def unit_hys(f: np.ndarray) -> np.ndarray:
    """Along the first axis: unit length, clipped, unit length; zeros stay."""
    for clip in (True, False):
        n = np.sqrt((f * f).sum(0))
        f = np.divide(f, n, out=np.zeros_like(f), where=n > 0)
        f = np.minimum(f, features.CLIP) if clip else f
    return f


def box(a: np.ndarray, k: int) -> np.ndarray:
    s = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def haar(p: np.ndarray, scale: dict, compat: bool = False) -> np.ndarray:
    q = p[1:, 1:]  # 7 before to 8 after
    ones, half = np.ones(16), np.repeat([-1.0, 1.0], 8)
    down = correlate(q, ones, 0)
    area = correlate(down, ones, 1)
    x, y = correlate(down, half, 1), correlate(correlate(q, half, 0), ones, 1)
    total = area + 1e-5 if compat else area
    return np.stack([np.divide(d, total, out=np.zeros_like(d), where=area > 0) for d in (x, y)])


def hog(p: np.ndarray, scale: dict) -> np.ndarray:
    dx, dy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    theta = np.arctan2(dy, dx)
    theta = np.where(theta < 0, theta + math.pi, theta)
    b, mag = np.minimum((theta * 9 / math.pi).astype(int), 8), np.sqrt(dx * dx + dy * dy)
    h, w = p.shape[0] - 18, p.shape[1] - 18
    cells = [box(np.where(b == k, mag, 0), 8) for k in range(9)]  # cell (y, x) starts at gradient (y, x), 8 before the pixel
    return unit_hys(np.stack([c[1 + 8 * i : 1 + 8 * i + h, 1 + 8 * j : 1 + 8 * j + w] for i in range(2) for j in range(2) for c in cells]))


def _soft_cells() -> np.ndarray:
    """(2, 15): how far each row of a patch counts to the two inner cells, linear between cell centres 8 apart."""
    at = np.arange(15) / 8 + 0.5
    low = at.astype(int)
    rest = at - low + 1 / 16
    return np.stack([np.where(low == c, 1 - rest, 0) + np.where(low + 1 == c, rest, 0) for c in (1, 2)])


def hog_compat(p: np.ndarray, scale: dict) -> np.ndarray:
    """Each pixel's own 15 by 15 patch, zero outside, with votes shared between neighbouring bins and cells."""
    soft = _soft_cells()

    def patches(a: np.ndarray) -> np.ndarray:
        wide = np.pad(a, [(0, 0), (0, 0), (1, 1), (1, 1)])
        dx, dy = wide[:, :, 1:-1, 2:] - wide[:, :, 1:-1, :-2], wide[:, :, :-2, 1:-1] - wide[:, :, 2:, 1:-1]
        mag = np.sqrt(dx * dx + dy * dy)
        place = (np.arctan2(dy, dx) + (dy < 0) * math.pi) * (9 / math.pi) + 0.5
        upper = place.astype(int)
        share = place - upper
        lower, upper = np.where(upper == 0, 8, upper - 1), np.where(upper == 9, 0, upper)
        votes = [mag * ((lower == k) * (1 - share) + (upper == k) * share) for k in range(9)]
        return np.stack([np.einsum("hwyx,y,x->hw", v, soft[i], soft[j]) for i in range(2) for j in range(2) for v in votes], axis=-1)

    rows = [generic_filter(p[y : y + 15], 15, patches) for y in range(p.shape[0] - 14)]  # a row of pixels at a time
    return unit_hys(np.concatenate(rows, axis=1))


def beyond(p: np.ndarray, halo: int, ty: int, tx: int, tile: int, h: int, w: int) -> tuple[int, int, int, int]:
    """How many lines and columns of a tile with its halo lie above, left of, below and right of an image of h by w."""
    y0, x0 = ty * tile, tx * tile
    return max(0, halo - y0), max(0, halo - x0), max(0, y0 + p.shape[0] - halo - h), max(0, x0 + p.shape[1] - halo - w)


def zero_border(p: np.ndarray, out: tuple[int, int, int, int]) -> np.ndarray:
    """Zeros in place of the mirrored image beyond its border."""
    top, left, bottom, right = out
    q = np.zeros_like(p)
    inner = slice(top, p.shape[0] - bottom), slice(left, p.shape[1] - right)
    q[inner] = p[inner]
    return q


def edge(p: np.ndarray, scale: dict, compat: bool = False) -> np.ndarray:
    """compat: the gradient sees zeros beyond the image, and its magnitudes at the border are mirrored."""
    g, d = features.gauss_pair()
    if compat:
        p = zero_border(p, scale["beyond"])
    mag = np.hypot(correlate(correlate(p, g, 0), d, 1), correlate(correlate(p, d, 0), g, 1))
    if compat:
        top, left, bottom, right = (max(0, n - 3) for n in scale["beyond"])
        mag = np.pad(mag[top : mag.shape[0] - bottom, left : mag.shape[1] - right], ((top, bottom), (left, right)), mode="symmetric")
    return shifted(mag, features.square(3), 3)


def shifted(p: np.ndarray, offsets: list[tuple[int, int]], r: int) -> np.ndarray:
    h, w = p.shape[0] - 2 * r, p.shape[1] - 2 * r
    return np.stack([p[r + dy : r + dy + h, r + dx : r + dx + w] for dx, dy in offsets])


def ridge_parts(p: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    v, uu, u = features.hessian_taps(sigma)
    r = len(v) // 2
    q = p[33 - r : p.shape[0] - 33 + r, 33 - r : p.shape[1] - 33 + r]
    d1, d2, dxy = (correlate(correlate(q, a, 0), b, 1) for a, b in ((u, v), (v, u), (uu, uu)))
    root = np.sqrt((d1 - d2) ** 2 + 4 * dxy * dxy)
    a, b = (d1 + d2 + root) / 2, (d1 + d2 - root) / 2
    swap = np.abs(a) > np.abs(b)
    return np.where(swap, b, a), np.where(swap, a, b)


def ridge_tops(p: np.ndarray) -> list[float]:
    out = []
    for im in (p, 1 - p):
        for s in features.FRANGI_SIGMAS:
            l1, l2 = ridge_parts(im, s)
            out.append(float(np.where(l2 > 0, l1 * l1 + l2 * l2, 0).max()))
    return out


def frangi(p: np.ndarray, scale: dict) -> np.ndarray:
    out = []
    for turn, im in enumerate((p, 1 - p)):
        for k, s in enumerate(features.FRANGI_SIGMAS):
            l1, l2 = ridge_parts(im, s)
            top = scale["ridges"][turn * len(features.FRANGI_SIGMAS) + k]
            on = (l2 > 0) & (top > 0)
            safe = np.where(on, l2, 1.0)
            out.append(np.where(on, features.FRANGI_SCALE * np.exp(-2 * l1 * l1 / (safe * safe)) * (1 - np.exp(-2 * (l1 * l1 + l2 * l2) / (top or 1.0))), 0))
    return np.stack(out)


@lru_cache(maxsize=1)
def gabor_kernels() -> list[np.ndarray]:
    """Pairs of phases 0 and pi / 2, the second negated: for each sigma, direction and wavelength."""
    out = []
    for s in (2, 3, 4, 5, 6):
        y, x = np.mgrid[-3 * s : 3 * s + 1, -3 * s : 3 * s + 1].astype(float)
        for k in range(1, 13):
            t = k * math.pi / 6
            along, across = x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)
            bell = np.exp(-(along**2 + across**2) / (2 * s * s))
            for f in (2, 2.25, 2.5):
                wave = 2 * math.pi / (f * s) * along
                out += [bell * np.cos(wave), -bell * np.cos(wave + math.pi / 2)]
    return out


def gabor(p: np.ndarray, scale: dict, compat: bool = False) -> np.ndarray:
    parts = list(convolve_all(p, gabor_kernels(), 18))
    if compat:
        parts = [u8_steps(a) for a in parts]
    return np.stack([np.sqrt(a * a + b * b) for a, b in zip(parts[::2], parts[1::2])])


def _bell(n: int) -> np.ndarray:
    t = np.arange(n) - n // 2
    g = np.exp(-t * t / 2.0)
    return g / g.sum()


def smoothed(p: np.ndarray) -> np.ndarray:
    g = _bell(7)
    return correlate_same(correlate_same(p, g, 0, "edge"), g, 1, "edge")


def sift(p: np.ndarray, scale: dict, compat: bool = False) -> np.ndarray:
    im = smoothed(zero_border(p, scale["beyond"]) if compat else p)
    top = scale["smooth"]
    if compat:
        im, top = u8_steps(im), float(u8_steps(np.array(scale["smooth_zero"])))
    im = im / top if top else im
    s = _bell(5)
    d = np.gradient(s)
    d = d * 2 / np.abs(np.outer(d, s)).sum()
    gx = correlate_same(correlate_same(im, s, 0, "constant"), d, 1, "constant")
    gy = correlate_same(correlate_same(im, d, 0, "constant"), s, 1, "constant")
    mag = np.sqrt(gx * gx + gy * gy)
    cos, sin = np.divide(gx, mag, out=np.ones_like(gx), where=mag > 0), np.divide(gy, mag, out=np.zeros_like(gy), where=mag > 0)
    weight = 1 - np.abs(np.arange(1, 3, 0.25) - 1.875)
    channels = []
    for a in range(8):
        c = np.maximum(cos * math.cos(a * math.pi / 4) + sin * math.sin(a * math.pi / 4), 0) ** 9 * mag
        channels.append(correlate_same(correlate_same(c, weight, 0, "constant", 2), weight, 1, "constant", 2))
    h, w = p.shape[0] - 30, p.shape[1] - 30
    out = np.stack([c[8 + 4 * j : 8 + 4 * j + h, 8 + 4 * i : 8 + 4 * i + w] for i in range(4) for j in range(4) for c in channels])
    n = (out * out).sum(0)
    unit = np.minimum(out / np.sqrt(np.maximum(n, 1e-300)), features.CLIP)
    unit = unit / np.sqrt(np.maximum((unit * unit).sum(0), 1e-300))
    return np.where(n > 1, unit, out)


#: name: (halo, number of features, whether they are normalized, function)
FILTERS: dict[str, tuple[int, int, bool, Callable]] = {
    "haar": (8, 2, True, haar), "hog": (9, 36, True, hog), "hog-compat": (7, 36, True, hog_compat), "edge": (6, 49, True, edge), "gabor": (18, 180, True, gabor), "sift": (15, 128, True, sift), "frangi": (33, 14, False, frangi),
    "haar-compat": (8, 2, True, lambda p, s: haar(p, s, True)), "edge-compat": (6, 49, True, lambda p, s: edge(p, s, True)), "gabor-compat": (18, 180, True, lambda p, s: gabor(p, s, True)), "sift-compat": (15, 128, True, lambda p, s: sift(p, s, True)),
}
#: The bank that images get unless another is named.
DEFAULT = ("haar", "hog", "edge", "gabor-compat", "sift-compat", "intensity-stencil-10")
DEFAULT_CONTEXT = ("intensity-stencil-7",)


def filter_of(name: str) -> tuple[int, int, bool, Callable]:
    if name in FILTERS:
        return FILTERS[name]
    kind, _, r = name.rpartition("-")
    if kind in ("intensity-square", "intensity-stencil") and r.isdigit():
        offsets = (features.square if kind.endswith("square") else features.stencil)(int(r))
        return int(r), len(offsets), False, lambda p, s: shifted(p, offsets, int(r))
    raise ValueError(f"no filter {name!r}")


def parse(names: str, base: tuple[str, ...] = DEFAULT) -> tuple[str, ...]:
    """A list of filters split by commas; with + or - in front of the first, added to or taken from base."""
    sign = names[:1] if names[:1] in "+-" and names else ""
    parts = tuple(n.strip() for n in names[len(sign) :].split(",") if n.strip())
    for n in parts:
        filter_of(n)
    return base + parts if sign == "+" else tuple(n for n in base if n not in parts) if sign == "-" else parts


def count(names: tuple[str, ...]) -> int:
    return sum(filter_of(n)[1] for n in names)


def normalized(names: tuple[str, ...]) -> np.ndarray:
    return np.concatenate([np.full(filter_of(n)[1], filter_of(n)[2]) for n in names])


def halo_tiles(lines: DataFrame, halo: int, tile: int, tiles: DataFrame | None = None) -> DataFrame:
    """image_id, ty, tx, h, w, r, px: the lines r of tiles with their halos, and the size of the image. Lines of wanted tiles alone, if tiles (ty, tx) are given."""
    wide = border.pad(lines, halo, "symmetric")
    size = schema.heights(lines).select("image_id", "h", "w")
    out = wide.join(size, "image_id")
    first = F.greatest(F.lit(0), F.floor((F.col("y") - 2 * halo - tile) / tile) + 1).cast("int")
    last = F.least(F.floor(F.col("y") / tile), F.floor((F.col("h") - 1) / tile)).cast("int")
    out = out.select("*", F.explode(F.sequence(first, last)).alias("ty")).filter(F.col("y") < F.least((F.col("ty") + 1) * tile, F.col("h")) + 2 * halo)
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / tile).cast("int"))).alias("tx"))
    if tiles is not None:
        out = out.join(F.broadcast(tiles.select("ty", "tx")), ["ty", "tx"], "left_semi")
    wide_part = F.slice("px", F.col("tx") * tile + 1, F.least(F.lit(tile), F.col("w") - F.col("tx") * tile) + 2 * halo)
    return out.select("image_id", "ty", "tx", "h", "w", (F.col("y") - F.col("ty") * tile).alias("r"), wide_part.alias("px"))


def _scales(lines: DataFrame, names: tuple[str, ...], tile: int) -> DataFrame | None:
    """image_id, smooth, smooth_zero, ridges: what sift (with a mirrored and with a zero border) and frangi need of the whole image."""
    want = {"smooth": any(n.startswith("sift") for n in names), "ridges": "frangi" in names}
    if not any(want.values()):
        return None
    halo = 33 if want["ridges"] else 15

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.stack(pdf.sort_values("r")["px"].to_numpy())
        g, first = _bell(7), pdf.iloc[0]
        zero = zero_border(p, beyond(p, halo, first["ty"], first["tx"], tile, first["h"], first["w"]))
        tops = [float(correlate(correlate(q[halo - 3 : p.shape[0] - halo + 3, halo - 3 : p.shape[1] - halo + 3], g, 0), g, 1).max()) if want["smooth"] else 0.0 for q in (p, zero)]
        return pd.DataFrame({"image_id": [first["image_id"]], "smooth": [tops[0]], "smooth_zero": [tops[1]], "ridges": [ridge_tops(p) if want["ridges"] else []]})

    each = halo_tiles(lines, halo, tile).groupBy("image_id", "ty", "tx").applyInPandas(run, "image_id string, smooth double, smooth_zero double, ridges array<double>")
    tops = F.array(*[F.max(F.get("ridges", F.lit(k))) for k in range(14)]) if want["ridges"] else F.lit(None).cast("array<double>")
    return each.groupBy("image_id").agg(F.max("smooth").alias("smooth"), F.max("smooth_zero").alias("smooth_zero"), tops.alias("ridges"))


def bank(lines: DataFrame, names: tuple[str, ...], tile: int = 64, scope: str = "image", tiles: DataFrame | None = None) -> DataFrame:
    """image_id, y, x, xs: all features of every pixel, in the order of names. scope "tile" takes each tile's own largest values."""
    workers_find_package(lines.sparkSession)
    parts = [filter_of(n) for n in names]
    halo = max(p[0] for p in parts)
    cut = halo_tiles(lines, halo, tile, tiles)
    scales = _scales(lines, names, tile) if scope == "image" else None
    whole = scales is not None
    if whole:
        cut = cut.join(scales, "image_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        p = np.stack(pdf["px"].to_numpy())
        first = pdf.iloc[0]
        ty, tx = int(first["ty"]), int(first["tx"])
        out = beyond(p, halo, ty, tx, tile, int(first["h"]), int(first["w"]))
        scale = {"smooth": float(first["smooth"]), "smooth_zero": float(first["smooth_zero"]), "ridges": first["ridges"]} if whole else {}
        inside = lambda r: p[halo - r : p.shape[0] - halo + r, halo - r : p.shape[1] - halo + r]
        if scope == "tile":
            zero = zero_border(p, out)[halo - min(halo, 15) : p.shape[0] - halo + min(halo, 15), halo - min(halo, 15) : p.shape[1] - halo + min(halo, 15)]
            scale = {"smooth": float(smoothed(inside(min(halo, 15))).max()), "smooth_zero": float(smoothed(zero).max()), "ridges": ridge_tops(p) if halo >= 33 else []}
        h, w = p.shape[0] - 2 * halo, p.shape[1] - 2 * halo
        xs = np.concatenate([f(inside(r), scale | {"beyond": tuple(max(0, n - halo + r) for n in out)}) for r, _, _, f in parts]).reshape(-1, h * w).T
        y, x = np.divmod(np.arange(h * w), w)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": (y + ty * tile).astype(np.int32), "x": (x + tx * tile).astype(np.int32), "xs": list(xs)})

    return cut.groupBy("image_id", "ty", "tx").applyInPandas(run, "image_id string, y int, x int, xs array<double>")
