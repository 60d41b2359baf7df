"""Feature images in line form: each operator turns lines into features(image_id, y, feat, px)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions.pixel import remap
from gridloom.operators import border, resample

#: The scale of ridge features, their sigmas, and where block norms are clipped.
FRANGI_SCALE = 1.1565176427496657
FRANGI_SIGMAS = (2, 3, 4, 5, 7, 9, 11)
CLIP = 0.2


def square(r: int) -> list[tuple[int, int]]:
    """(dx, dy) of a square neighbourhood, by dx."""
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]


def stencil(r: int) -> list[tuple[int, int]]:
    """(dx, dy) of the arms of + and x, by dy."""
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx == 0 or dy == 0 or abs(dx) == abs(dy)]


def intensity(lines: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Shifted copies with symmetric borders. A line is joined once for each dy; dx is an index within it."""
    size = schema.heights(lines).select("image_id", "h")
    wanted: dict[int, list[tuple[int, int]]] = {}
    for feat, (dx, dy) in enumerate(offsets):
        wanted.setdefault(dy, []).append((feat, dx))
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.array(*[F.struct(F.lit(f).alias("feat"), F.lit(dx).alias("dx")) for f, dx in d]).alias("d")) for dy, d in wanted.items()])
    to = size.select("image_id", "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("to"), moves.alias("m"))
    to = to.select("image_id", "h", "to", F.explode("m").alias("m")).select("image_id", "to", "m.d", remap(F.col("to") + F.col("m.dy"), F.col("h"), "symmetric").alias("y"))
    got = to.join(lines, ["image_id", "y"]).select("image_id", F.col("to").alias("y"), F.explode("d").alias("d"), "px")
    w = F.size("px")
    shifted = F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.get("px", remap(x + F.col("d.dx"), w, "symmetric")))
    return got.select("image_id", "y", F.col("d.feat").alias("feat"), shifted.alias("px"))


def paired(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f of the elements of two images with the same lines."""
    both = a.join(b.withColumnRenamed("px", "other"), ["image_id", "y"])
    return both.select("image_id", "y", F.zip_with("px", "other", f).alias("px"))


def gauss_pair() -> tuple[list[float], list[float]]:
    """Seven taps of a Gaussian and of its derivative, sigma 1, such that their product has unit Frobenius norm."""
    t = np.arange(-3, 4)
    g = np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    d = t * g
    k = 1 / math.sqrt(np.linalg.norm(np.outer(d, g)))
    return (g * k).tolist(), (d * k).tolist()


def edge_magnitude(lines: DataFrame, mode: str = "symmetric") -> DataFrame:
    g, d = gauss_pair()
    f = lambda a, b: F.sqrt(a * a + b * b)
    return paired(resample.correlate(lines, d, g, mode), resample.correlate(lines, g, d, mode), f)


def edge(lines: DataFrame) -> DataFrame:
    """49 features: the edge magnitude in a square neighbourhood. Borders: the image is mirrored, then filtered."""
    wide = border.pad(lines, 6, "symmetric")
    g, d = gauss_pair()
    f = lambda a, b: F.sqrt(a * a + b * b)
    return neighbours(paired(resample.correlate(wide, d, g), resample.correlate(wide, g, d), f), square(3), 3)


def neighbours(wide: DataFrame, offsets: Sequence[tuple[int, int]], margin: int) -> DataFrame:
    """Shifted copies of the inner part of images that have a margin."""
    out = intensity(wide, offsets)
    size = schema.heights(wide).select("image_id", "h", "w")
    out = out.join(size, "image_id").filter((F.col("y") >= margin) & (F.col("y") < F.col("h") - margin))
    return out.select("image_id", (F.col("y") - margin).alias("y"), "feat", F.slice("px", margin + 1, F.col("w") - 2 * margin).alias("px"))


def integral(lines: DataFrame) -> DataFrame:
    """Inclusive two-dimensional prefix sums: along each line in its array, then down each column."""
    running = F.aggregate("px", F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))
    along = schema.to_pixels(lines.withColumn("px", running))
    return along.withColumn("v", F.sum("v").over(Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)))


def haar(lines: DataFrame, compat: bool = False) -> DataFrame:
    """(right - left) / sum and (bottom - top) / sum of 16 by 16 windows, from 7 before to 8 after the pixel."""
    one = [1.0] * 16
    at = lambda i, k, n: remap(i + k - 7, n, "symmetric")
    same = lambda n: n
    half = [-1.0] * 8 + [1.0] * 8
    down = resample.along_y(lines, one, at, same)
    x = resample.along_x(down, half, at, same)
    area = resample.along_x(down, one, at, same)
    y = resample.along_x(resample.along_y(lines, half, at, same), one, at, same)
    share = (lambda d, a: F.when(a > 0, d / (a + 1e-5)).otherwise(0.0)) if compat else (lambda d, a: F.when(a > 0, d / a).otherwise(0.0))
    return paired(x, area, share).withColumn("feat", F.lit(0)).unionByName(paired(y, area, share).withColumn("feat", F.lit(1))).select("image_id", "y", "feat", "px")


def gradients(lines: DataFrame) -> DataFrame:
    """image_id, y, dx, dy: central differences with symmetric borders."""
    at = lambda i, k, n: remap(i + k - 1, n, "symmetric")
    same = lambda n: n
    dx = resample.along_x(lines, (-1.0, 0.0, 1.0), at, same).withColumnRenamed("px", "dx")
    dy = resample.along_y(lines, (-1.0, 0.0, 1.0), at, same).withColumnRenamed("px", "dy")
    return dx.join(dy, ["image_id", "y"])


def hog_bin(dx: Column, dy: Column, bins: int = 9) -> Column:
    theta = F.atan2(dy, dx)
    theta = F.when(theta < 0, theta + math.pi).otherwise(theta)
    return F.least(F.floor(theta * bins / math.pi), F.lit(bins - 1)).cast("int")


def hog_bins(lines: DataFrame) -> DataFrame:
    """image_id, y, x, bin, mag of each pixel."""
    g = gradients(lines).select("image_id", "y", F.posexplode(F.arrays_zip("dx", "dy")).alias("x", "g")).select("image_id", "y", "x", "g.dx", "g.dy")
    return g.select("image_id", "y", "x", hog_bin(F.col("dx"), F.col("dy")).alias("bin"), F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2).alias("mag"))


def hessian_taps(s: float) -> tuple[list[float], list[float], list[float]]:
    """The smooth, first and second derivative taps of a Gaussian of width s."""
    t = np.arange(-int(3 * s + 0.5), int(3 * s + 0.5) + 1)
    v = np.exp(-t * t / (2 * s * s)) / (math.sqrt(2 * math.pi) * s * s)
    return v.tolist(), (v * t).tolist(), (v * (t * t - s * s)).tolist()


def eigenvalues(d1: Column, d2: Column, dxy: Column) -> tuple[Column, Column]:
    """Of a symmetric 2 by 2 matrix: the smaller and the larger by absolute value."""
    root = F.sqrt((d1 - d2) * (d1 - d2) + 4.0 * dxy * dxy)
    a, b = (d1 + d2 + root) / 2.0, (d1 + d2 - root) / 2.0
    swap = F.abs(a) > F.abs(b)
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def hessian(lines: DataFrame, sigma: float) -> DataFrame:
    """image_id, y, p: (d1, d2, dxy) of each element, with symmetric borders."""
    v, uu, u = hessian_taps(sigma)
    d1 = resample.correlate(lines, v, u, "symmetric").withColumnRenamed("px", "d1")
    d2 = resample.correlate(lines, u, v, "symmetric").withColumnRenamed("px", "d2")
    dxy = resample.correlate(lines, uu, uu, "symmetric").withColumnRenamed("px", "dxy")
    return d1.join(d2, ["image_id", "y"]).join(dxy, ["image_id", "y"]).select("image_id", "y", F.arrays_zip("d1", "d2", "dxy").alias("p"))


def frangi(lines: DataFrame, sigmas: Sequence[float] = FRANGI_SIGMAS) -> DataFrame:
    """Dark ridges at each width, on the image and then on its inverse. The largest second-order strength, which scales the
    result, is that of the whole image."""
    out = []
    for turn in range(2):
        im = lines if turn == 0 else lines.withColumn("px", F.transform("px", lambda v: 1.0 - v))
        for k, s in enumerate(sigmas):
            h = hessian(im, s)
            pairs = F.transform("p", lambda p: (lambda e: F.struct(e[0].alias("l1"), e[1].alias("l2")))(eigenvalues(p["d1"], p["d2"], p["dxy"])))
            h = h.select("image_id", "y", pairs.alias("e"))
            strength = lambda e: e["l1"] * e["l1"] + e["l2"] * e["l2"]
            top = h.groupBy("image_id").agg(F.max(F.array_max(F.transform("e", lambda e: F.when(e["l2"] > 0, strength(e)).otherwise(0.0)))).alias("top"))
            ridge = lambda e: F.when((e["l2"] > 0) & (F.col("top") > 0), FRANGI_SCALE * F.exp(-2.0 * e["l1"] * e["l1"] / (e["l2"] * e["l2"])) * (1.0 - F.exp(-2.0 * strength(e) / F.col("top")))).otherwise(0.0)
            out.append(h.join(top, "image_id").select("image_id", "y", F.lit(turn * len(sigmas) + k).alias("feat"), F.transform("e", ridge).alias("px")))
    return reduce(DataFrame.unionByName, out)


def orientation_channels(lines: DataFrame, angles: int = 8) -> DataFrame:
    """image_id, y, x, feat, v: the gradient's strength in each of some directions, the ninth power of its cosine."""
    g = gradients(lines).select("image_id", "y", F.posexplode(F.arrays_zip("dx", "dy")).alias("x", "g")).select("image_id", "y", "x", "g.dx", "g.dy")
    table = F.array(*[F.struct(F.lit(a).alias("feat"), F.lit(math.cos(2 * math.pi * a / angles)).alias("c"), F.lit(math.sin(2 * math.pi * a / angles)).alias("s")) for a in range(angles)])
    g = g.withColumns({"mag": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2), "a": F.explode(table)})
    unit = F.when(F.col("mag") > 0, (F.col("dx") * F.col("a.c") + F.col("dy") * F.col("a.s")) / F.col("mag")).otherwise(F.col("a.c"))
    return g.select("image_id", "y", "x", F.col("a.feat").alias("feat"), (F.pow(F.greatest(unit, F.lit(0.0)), 9) * F.col("mag")).alias("v"))
