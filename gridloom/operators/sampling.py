"""Samples in a fixed order: an order by hash takes the place of random draws, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(order_of(seed, *keys), *keys)


def _led(df: DataFrame, seed: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the leading digits of their hash, and of each of these (65,536 at most) the number of rows and of those up to it."""
    rows = df.withColumn("_lead", F.substring(order_of(seed, *keys), 1, 4))
    counts = rows.groupBy("_lead").agg(F.count(F.lit(1)).alias("_n"))
    return rows, counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def places(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows with their place, from 1, in the shuffled order; a task ranks the rows of some leading digits."""
    rows, counts = _led(df, seed, *keys)
    rank = F.row_number().over(Window.partitionBy("_lead").orderBy(order_of(seed, *keys), *keys))
    return rows.join(F.broadcast(counts), "_lead").withColumn("place", rank + F.col("_upto") - F.col("_n")).drop("_lead", "_n", "_upto")


def random_subset(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows, without replacement: the first by hash. Only rows that share the last one's leading digits are ranked."""
    rows, counts = _led(df, seed, *keys)
    near = rows.join(F.broadcast(counts.filter(F.col("_upto") - F.col("_n") < n)), "_lead")
    last = near.filter(F.col("_upto") > n).withColumn("_rank", F.row_number().over(Window.partitionBy("_lead").orderBy(order_of(seed, *keys), *keys)))
    last = last.filter(F.col("_rank") <= n - F.col("_upto") + F.col("_n")).drop("_rank")
    return near.filter(F.col("_upto") <= n).unionByName(last).drop("_lead", "_n", "_upto")


def per_class(df: DataFrame, most: int, seed: int, label: str, *keys: str) -> DataFrame:
    """At most so many rows of each class. A first cut by the hash's leading digits keeps classes that are far too large from
    being sorted: it holds the rows that a class needs with a wide margin. If repeated keys leave a class short, none is cut."""
    h = order_of(seed, *keys)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), (4.0 * most + 1000) / F.col("_n"))
    lead = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)
    every = df.join(F.broadcast(counts), label)
    near = every.filter(lead < share)
    held = {r[label]: r["n"] for r in near.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each class
    if any(held.get(r[label], 0) < min(most, r["_n"]) for r in counts.filter(F.col(label).isNotNull()).collect()):
        near = every
    rank = F.row_number().over(Window.partitionBy(label).orderBy(h, *keys))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank", "_n")


def subsample(df: DataFrame, n: int, seed: int, label: str, *keys: str) -> DataFrame:
    """All rows, or at most n of each class if there are more than 2 n."""
    return per_class(df, n, seed, label, *keys) if df.count() > 2 * n else df


def every(df: DataFrame, step: int, least: int, label: str, order: str) -> DataFrame:
    """Rows with a true label; if there are more than least * step, every step-th from the first on. Places are counted within ranges
    of the order and added up, so that no task numbers all rows."""
    rows = df.filter(label)
    n = rows.count()
    if n < least:
        raise ValueError(f"{n} rows are too few for {least} clusters")
    if n <= least * step:
        return rows
    part = F.floor(F.col(order) / 4096)
    counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_p", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_before")
    return rows.withColumn("_p", part).join(counts, "_p").withColumn("_place", place).filter(F.col("_place") % step == 0).drop("_p", "_before", "_place")


def largest_remainders(df: DataFrame, n: int, parts: int, total: Column) -> DataFrame:
    """The n rows with the largest remainders, ends first, then the later ones."""
    ends = F.col("i").isin(0, parts - 1)
    return df.withColumn("rem", total).orderBy(F.desc("rem"), F.desc(ends.cast("int")), F.desc("i")).limit(n)
