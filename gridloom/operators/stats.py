"""Exact statistics by feature, normalization and quality metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.pixel import one_over
from gridloom.sources.raster import workers_find_package

#: Fixed value: the factor from a median absolute deviation to a standard deviation.
MAD = 1.482602218505602
#: Of the sketch that bounds a rank: it is off by at most one in so many values.
ACCURACY = 100_000
#: Bits of a value's order that each pass over arrays settles, the highest first.
DIGITS = (22, 21, 21)


def min_max(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def mean_std(df: DataFrame, *by: str, ddof: int = 0) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("v").alias("mean"), (F.stddev_samp if ddof else F.stddev_pop)("v").alias("std"))


def percentiles(df: DataFrame, qs: list[float], *by: str) -> DataFrame:
    """Exact, interpolated: q1, q2, ... in the order of qs; nulls do not count.

    A mergeable sketch bounds each wanted rank from both sides; then equal values between the bounds are counted, and all below as
    one. So a group of n values brings some 6 n / ACCURACY rows to the task that picks its values, however large it is."""
    values = df.select(*by, "v").filter("v is not null")
    near = [p for q in qs for p in (max(0.0, q - 3 / ACCURACY), min(1.0, q + 3 / ACCURACY))]
    ends = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("v", near, ACCURACY).alias("_p"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.col("_p")[2 * i].alias("lo"), F.col("_p")[2 * i + 1].alias("hi")) for i in range(len(qs))])
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in by], "_n", wanted.alias("_w"))
    few = F.col("_n") <= ACCURACY  # all values count where the bounds could be closer than the next value
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    both = values.join(ends, reduce(Column.__and__, same)) if by else values.crossJoin(F.broadcast(ends))
    both = both.select(*by, "_n", "v", F.explode("_w").alias("w")).filter(few | (F.col("v") <= F.col("w.hi")))
    counts = both.groupBy(*by, "_n", F.col("w.i").alias("i"), F.when(few | (F.col("v") >= F.col("w.lo")), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("c").over(upto))
    out = []
    for i, q in enumerate(qs):
        place = (F.col("_n") - 1) * F.lit(float(q))
        at = lambda k, i=i: F.min(F.when((F.col("i") == i) & (F.col("upto") > k), F.col("v")))
        one, share = at(F.floor(place)), F.max(place - F.floor(place))
        out.append(((1 - share) * one + share * at(F.ceil(place))).alias(f"q{i + 1}"))
    return counts.groupBy(*by).agg(*out)


def median(df: DataFrame, *by: str) -> DataFrame:
    return percentiles(df, [0.5], *by).withColumnRenamed("q1", "median")


def in_order(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the values: zeros are equal, and what is not a number comes last."""
    bits = np.where(np.isnan(v), np.nan, v + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def array_percentiles(rows: DataFrame, qs: list[float], centre: np.ndarray, apart: bool, use: np.ndarray) -> np.ndarray:
    """percentiles of each used component of xs (rows by qs, columns by use; no nulls), or of the distances to centre, without a
    row for each value. A pass counts the next digits of the values that begin like a wanted one; after the last they are known."""
    workers_find_package(rows.sparkSession)
    n, wanted = len(centre), {(int(k), 0): None for k in use}
    found, share = np.full((2 * len(qs), len(use)), np.nan), np.zeros(len(qs))
    column = {int(k): i for i, k in enumerate(use)}
    used = rows.select("xs") if len(use) == n else rows.select(F.array(*[F.get("xs", F.lit(int(k))) for k in use]))  # most features are not normalized
    shift = sum(DIGITS)
    for bits in DIGITS:
        above, shift, asked = shift, shift - bits, list(wanted.items())

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(-1, len(use))
                for at, ((k, begins), _) in enumerate(asked):
                    v = in_order(np.abs(x[:, column[k]] - centre[k]) if apart else x[:, column[k]])
                    keys, times = np.unique((v if above == 64 else v[v >> above == begins]) >> shift, return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(keys), at, np.int32)), pa.array(keys), pa.array(times)], names=["at", "key", "n"])

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("key")
            at, upto = int(pdf["at"].iloc[0]), pdf["n"].to_numpy().cumsum()
            ranks = asked[at][1]
            if ranks is None:
                places = [(int(upto[-1]) - 1) * float(q) for q in qs]
                ranks = [(2 * i + up, int(np.ceil(p) if up else np.floor(p))) for i, p in enumerate(places) for up in (0, 1)]
            out = []
            for want, rank in ranks:
                i = int(np.searchsorted(upto, rank, side="right"))
                out.append((at, want, int(pdf["key"].iloc[i]), rank - int(upto[i - 1] if i else 0), int(upto[-1])))
            return pd.DataFrame(out, columns=["at", "want", "key", "left", "n"])

        counts = used.mapInArrow(count, "at int, key long, n long").groupBy("at", "key").agg(F.sum("n").alias("n"))
        got = counts.groupBy("at").applyInPandas(pick, "at int, want int, key long, left long, n long").collect()  # two for each result
        if above == 64:
            for i, q in enumerate(qs):
                share[i] = (p := (got[0]["n"] - 1) * float(q) if got else 0.0) - np.floor(p)
        wanted = {}
        for r in got:
            k = asked[r["at"]][0][0]
            wanted.setdefault((k, r["key"]), []).append((r["want"], r["left"]))
            if not shift:
                v = np.int64(r["key"])
                found[r["want"], column[k]] = (v ^ ((v >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)
    return (1 - share[:, None]) * found[::2] + share[:, None] * found[1::2]


def median_mad(df: DataFrame, *by: str) -> DataFrame:
    """Medians, then the medians of the distances to them; there is a row of medians for each feature."""
    mid = median(df, *by)
    far = (df.join(mid, list(by)) if by else df.crossJoin(F.broadcast(mid))).withColumn("v", F.abs(F.col("v") - F.col("median")))
    spread = median(far, *by).select(*by, (F.col("median") * MAD).alias("mad"))
    if not by:
        return mid.crossJoin(F.broadcast(spread))
    return mid.join(spread, reduce(Column.__and__, [mid[c].eqNullSafe(spread[c]) for c in by])).select(*[mid[c] for c in by], "median", "mad")


def fit(df: DataFrame, method: str, *by: str) -> DataFrame:
    """by, off, scale. A spread of zero scales by 1."""
    if method == "none":
        return df.select(*by).distinct().select(*by, F.lit(0.0).alias("off"), F.lit(1.0).alias("scale"))
    if method == "min-max":
        return min_max(df, *by).select(*by, F.col("low").alias("off"), one_over(F.col("high") - F.col("low")).alias("scale"))
    if method == "mean-std":
        return mean_std(df, *by).select(*by, F.col("mean").alias("off"), one_over(5.0 * F.col("std")).alias("scale"))
    if method == "median-mad":
        return median_mad(df, *by).select(*by, F.col("median").alias("off"), one_over(5.0 * F.col("mad")).alias("scale"))
    if method == "iqr":
        q = percentiles(df, [0.25, 0.75], *by)
        iqr = F.col("q2") - F.col("q1")
        return q.select(*by, (F.col("q1") - 1.5 * iqr).alias("off"), one_over(4.0 * iqr).alias("scale"))
    raise ValueError(method)


def fit_arrays(rows: DataFrame, method: str, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fit of each component of xs that use says, as arrays; others, and all of no rows, stay as they are."""
    off, scale = np.zeros(len(use)), np.ones(len(use))
    at = np.flatnonzero(use)
    if method == "none" or not len(at):
        return off, scale
    if method not in ("median-mad", "iqr"):
        for r in fit(rows.select(F.posexplode("xs").alias("feat", "v")), method, "feat").collect():  # one row for each feature
            if use[r["feat"]]:
                off[r["feat"]], scale[r["feat"]] = r["off"], r["scale"]
        return off, scale
    if method == "median-mad":
        mid = np.zeros(len(use))
        mid[at] = array_percentiles(rows, [0.5], mid, False, at)[0]
        if np.isnan(mid[at]).all():
            return off, scale
        first, width = mid[at], 5.0 * (array_percentiles(rows, [0.5], mid, True, at)[0] * MAD)
    else:
        q1, q2 = array_percentiles(rows, [0.25, 0.75], off, False, at)
        if np.isnan(q1).all():
            return off, scale
        first, width = q1 - 1.5 * (q2 - q1), 4.0 * (q2 - q1)
    off[at], scale[at] = first, 1.0 / np.where(width == 0, 1.0, width)
    return off, scale


def scaled(v: Column, off: Column, scale: Column, method: str) -> Column:
    out = (v - off) * scale
    return out + 0.5 if method in ("mean-std", "median-mad") else v if method == "none" else out


def normalize(df: DataFrame, params: DataFrame, method: str, *by: str, only: Column | None = None) -> DataFrame:
    """v by the parameters of its feature; where only is false it stays as it is."""
    both = df.join(params, list(by)) if by else df.crossJoin(params)
    new = scaled(F.col("v"), F.col("off"), F.col("scale"), method)
    return both.withColumn("v", new if only is None else F.when(only, new).otherwise(F.col("v"))).drop("off", "scale")


def confusion(df: DataFrame) -> DataFrame:
    """tp, tn, fp, fn of pred and gt (bools), where mask, if there is one, is true."""
    rows = df.filter("mask") if "mask" in df.columns else df
    return rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("pred") & F.col("gt")), ("tn", ~F.col("pred") & ~F.col("gt")), ("fp", F.col("pred") & ~F.col("gt")), ("fn", ~F.col("pred") & F.col("gt")))])


def accuracy() -> Column:
    total = reduce(Column.__add__, map(F.col, ("tp", "tn", "fp", "fn")))
    return F.when(total == 0, 1.0).otherwise((F.col("tp") + F.col("tn")) / total)


def f_value() -> Column:
    return F.when((F.col("tp") == 0) & (F.col("fn") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def g_mean() -> Column:
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return F.sqrt(share("tp", "fn") * share("tn", "fp"))
