"""Weighted sums along an axis, and what is built of them: resampling, pooling, correlation, thresholds.

Along a line the sum reads the line's own array and needs no shuffle. Across lines, each result line joins the few lines that it
reads and adds them element by element: a shuffle of lines, not of pixels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions.pixel import remap

#: The taps of halving with a cubic kernel, from the border to the middle and back.
HALVE = (-0.01171875, -0.03515625, 0.11328125, 0.43359375, 0.43359375, 0.11328125, -0.03515625, -0.01171875)


def along_x(lines: DataFrame, taps: Sequence[float], at: Callable[[Column, int, Column], Column], n: Callable[[Column], Column]) -> DataFrame:
    """Result element i is the sum of taps[k] * px[at(i, k, w)]; there are n(w) elements."""
    w = F.size("px")
    one = lambda i: sum((F.lit(float(t)) * F.get("px", at(i, k, w)) for k, t in enumerate(taps)), F.lit(0.0))
    return lines.withColumn("px", F.transform(F.sequence(F.lit(0), n(w) - 1), one))


def along_y(lines: DataFrame, taps: Sequence[float], at: Callable[[Column, Column, Column], Column], n: Callable[[Column], Column]) -> DataFrame:
    """The same across lines."""
    size = schema.heights(lines).select("image_id", "h")
    to = size.select("image_id", "h", F.explode(F.sequence(F.lit(0), n(F.col("h")) - 1)).alias("to"))
    to = to.select("image_id", "h", "to", F.posexplode(F.array(*[F.lit(float(t)) for t in taps])).alias("k", "t"))
    to = to.select("image_id", "to", "k", "t", at(F.col("to"), F.col("k"), F.col("h")).alias("y"))
    return _summed(to, lines)


def _summed(to: DataFrame, lines: DataFrame) -> DataFrame:
    """to: image_id, to, k, t, y. The lines' weighted sums, in the order of k."""
    got = to.join(lines, ["image_id", "y"]).groupBy("image_id", "to").agg(F.array_sort(F.collect_list(F.struct("k", "t", "px"))).alias("p"))
    zero = F.transform(F.col("p")[0]["px"], lambda _: F.lit(0.0))
    total = F.aggregate("p", zero, lambda acc, p: F.zip_with(acc, p["px"], lambda a, b: a + b * p["t"]))
    return got.select("image_id", F.col("to").alias("y"), total.alias("px"))


def upsample(lines: DataFrame, levels: int) -> DataFrame:
    """Each pixel as a block of 2**levels by 2**levels."""
    f = 1 << levels
    out = lines.withColumn("px", F.flatten(F.transform("px", lambda v: F.array_repeat(v, f))))
    return out.withColumn("y", F.explode(F.sequence(F.col("y") * f, F.col("y") * f + (f - 1))))


def halve(lines: DataFrame) -> DataFrame:
    """Half the size, rounded up, by a cubic kernel with antialiasing; lines first, then along them."""
    up = lambda n: F.floor((n + 1) / 2).cast("int")
    at = lambda i, k, n: remap(2 * i - 3 + k, n, "edge")
    return along_x(along_y(lines, HALVE, at, up), HALVE, at, up)


def downsample(lines: DataFrame, levels: int) -> DataFrame:
    for _ in range(levels):
        lines = halve(lines)
    return lines


def max_pool(lines: DataFrame, levels: int) -> DataFrame:
    """The largest of each block of 2**levels by 2**levels; blocks at the far borders may be partial."""
    f = 1 << levels
    count = F.floor((F.size("px") + (f - 1)) / f).cast("int")
    out = lines.withColumn("px", F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_max(F.slice("px", i * f + 1, f))))
    by = out.groupBy("image_id", F.shiftright("y", levels).alias("y")).agg(F.collect_list("px").alias("p"))
    return by.select("image_id", "y", F.aggregate("p", F.col("p")[0], lambda a, b: F.zip_with(a, b, lambda u, v: F.greatest(u, v))).alias("px"))


def cubic(t: float) -> float:
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t <= 2 else 0.0


def box(t: float) -> float:
    return 1.0 if -0.5 <= t < 0.5 else 0.0


def triangle(t: float) -> float:
    return max(0.0, 1 - abs(t))


def lanczos(t: float, a: int) -> float:
    return 0.0 if abs(t) >= a else float(np.sinc(t) * np.sinc(t / a))


KERNELS: dict[str, tuple[Callable[[float], float], float]] = {
    "bicubic": (cubic, 4), "nearest": (box, 1), "box": (box, 1), "bilinear": (triangle, 2), "triangle": (triangle, 2),
    "lanczos2": (lambda t: lanczos(t, 2), 4), "lanczos3": (lambda t: lanczos(t, 3), 6),
}


def contributions(n: int, out: int, method: str | tuple = "bicubic", antialias: bool | None = None) -> list[tuple[int, int, int, float]]:
    """(result, tap, source, weight) of one axis: centres are aligned, weights of a result sum to 1, sources stay within the axis.
    Bounded by the image's size."""
    kernel, width = KERNELS[method] if isinstance(method, str) else method
    scale = out / n
    wide = (method != "nearest" if antialias is None else antialias) and scale < 1
    stretch = scale if wide else 1.0
    width /= stretch
    rows = []
    for i in range(out):
        centre = (i + 0.5) / scale - 0.5
        first = math.floor(centre - width / 2)
        taps = [(j, stretch * kernel(stretch * (centre - j))) for j in range(first, first + math.ceil(width) + 2)]
        total = sum(t for _, t in taps)
        rows += [(i, k, min(max(j, 0), n - 1), t / total) for k, (j, t) in enumerate((j, t) for j, t in taps if t)]
    return rows


def shape_of(h: int, w: int, to: float | tuple) -> tuple[int, int]:
    """A result's size from a scale, two scales, or two whole numbers of which one may be None."""
    if isinstance(to, (int, float)):
        return math.ceil(h * to), math.ceil(w * to)
    a, b = to
    if isinstance(a, float) or isinstance(b, float):
        return math.ceil(h * a), math.ceil(w * b)
    return (math.ceil(h * b / w) if a is None else a, math.ceil(w * a / h) if b is None else b)


def imresize(lines: DataFrame, h: int, w: int, to: float | tuple, method: str | tuple = "bicubic", antialias: bool | None = None) -> DataFrame:
    """Images of one size h by w resampled; the axis that shrinks more goes first."""
    spark = lines.sparkSession
    oh, ow = shape_of(h, w, to)

    def y_axis(x: DataFrame) -> DataFrame:
        table = spark.createDataFrame(contributions(h, oh, method, antialias), "to int, k int, y int, t double")
        return _summed(x.select("image_id").distinct().crossJoin(F.broadcast(table)), x)

    def x_axis(x: DataFrame) -> DataFrame:
        rows: list[list] = [[] for _ in range(ow)]
        for i, _, j, t in contributions(w, ow, method, antialias):
            rows[i].append((j, t))
        table = spark.createDataFrame([(rows,)], "c array<array<struct<j:int,t:double>>>")
        out = x.crossJoin(F.broadcast(table))
        one = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, p: acc + F.get("px", p["j"]) * p["t"])
        return out.select("image_id", "y", F.transform("c", one).alias("px"))

    return x_axis(y_axis(lines)) if oh / h <= ow / w else y_axis(x_axis(lines))


def imresize_bool(lines: DataFrame, h: int, w: int, to: float | tuple, method: str = "bilinear") -> DataFrame:
    """Truth values resampled as 0 and 255, true above 128."""
    out = imresize(lines.withColumn("px", F.transform("px", lambda v: v * 255.0)), h, w, to, method)
    return out.withColumn("px", F.transform("px", lambda v: (v > 128).cast("double")))


def otsu(pixels: DataFrame, bins: int = 256, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The threshold of each image, or of a whole stack with by=(): the first bin edge that separates two classes of values
    from 0 to 1 best. Only the histogram's rows are ordered."""
    keys = [F.col(c) for c in by]
    hist = pixels.groupBy(*keys, F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*keys)
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.select(*keys, "bin", F.sum("n").over(run).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(run).alias("s0"), F.sum("n").over(part).alias("n"), F.sum(F.col("n") * F.col("bin")).over(part).alias("s"))
    n1 = F.col("n") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    h = h.filter("n > n0").withColumn("between", F.col("n0").cast("double") * n1.cast("double") * apart * apart)
    pick = F.max(F.struct("between", (-F.col("bin")).alias("b"))).alias("m")
    best = h.groupBy(*keys).agg(pick) if by else h.agg(pick)
    return best.select(*keys, ((F.lit(1) - F.col("m.b")) / float(bins)).alias("threshold"))


def ensure_binary(pixels: DataFrame) -> DataFrame:
    """v as a truth value: one value is false, of two the larger is true, of more those above the image's threshold."""
    count = pixels.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_distinct("v").alias("kinds"))
    size = F.col("high") - F.col("low")
    unit = pixels.join(count, "image_id").withColumn("v", F.when(size > 0, (F.col("v") - F.col("low")) / size).otherwise(0.0))
    cut = otsu(unit.select("image_id", "y", "x", "v"))
    out = unit.join(cut, "image_id", "left")
    true = F.when(F.col("kinds") == 1, False).when(F.col("kinds") == 2, F.col("v") == 1.0).otherwise(F.col("v") >= F.col("threshold"))
    return out.select("image_id", "y", "x", true.alias("v"))


def correlate(lines: DataFrame, wx: Sequence[float], wy: Sequence[float], mode: str | None = None) -> DataFrame:
    """Separable correlation: wy across lines, then wx along them. Without a border mode only where the kernel fits whole."""
    if mode is None:
        fit = lambda taps: ((lambda i, k, n: i + k), (lambda n: n - (len(taps) - 1)))
    else:
        fit = lambda taps: ((lambda i, k, n: remap(i + k - len(taps) // 2, n, mode)), (lambda n: n))
    out = along_y(lines, wy, *fit(wy)) if len(wy) > 1 or wy[0] != 1 else lines
    return along_x(out, wx, *fit(wx)) if len(wx) > 1 or wx[0] != 1 else out


def separate(kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """(across, along) of a kernel of rank 1, else the kernel."""
    u, s, v = np.linalg.svd(kernel)
    if len(s) > 1 and s[1] > 1e-10 * max(s[0], 1e-300):
        return kernel
    return u[:, 0] * np.sqrt(s[0]), v[0] * np.sqrt(s[0])
