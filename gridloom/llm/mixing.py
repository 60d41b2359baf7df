"""Mixing sources to target weights: sizes by source, repetition rates, then whole copies and one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _base

#: No document is taken more often than this.
MOST = 3
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_base.WORD)), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """Uniform in [0, 1), from the id and the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, most: int = MOST, weights: int = 3) -> DataFrame:
    """source, source_size, target: one row per source. The window orders these rows only, never documents.

    A source whose cap is reached before the common level gets its cap; the others share the rest by weight. The
    level of the k-th source in the order of cap by weight is what is left per weight if all before it are full."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    by = by.withColumn("weight", ((F.row_number().over(named) - 1) % weights + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    by = by.select(
        "source", "source_size", "weight", "cap",
        F.sum("source_size").over(whole).alias("all_size"), F.sum("weight").over(whole).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    by = by.withColumn("level", (F.col("all_size") - F.col("cap_before")).cast("double") / (F.col("all_weight") - F.col("weight_before")).cast("double"))
    by = by.withColumn("is_full", F.col("level") > F.col("cap") / F.col("weight"))
    by = by.withColumn("common", F.max(F.when(~F.col("is_full"), F.col("level"))).over(whole))
    return by.select("source", "source_size", F.when(F.col("is_full"), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (with source and size) with source_size, target and copies: floor(rate), and one more with the fraction as probability.

    A source may be null or hold most rows: the few rows of targets are joined null-safely, and Spark splits a hot source."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    (name,) = _base.fresh(docs, "source_")
    out = docs.join(targets.withColumnRenamed("source", name), F.col("source").eqNullSafe(F.col(name))).drop(name)
    return out.withColumn("copies", (F.floor(rate) + (draw(seed=seed) < rate - F.floor(rate)).cast("long")).cast("long"))


def mix_sizes(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs.

    Null texts and texts without words have size 0 and take nothing; a null source is a source of its own, the last; a null
    id draws as an empty one; rows with the same id draw alike; an empty table gives no rows; other columns are not read."""
    sizes = _base.staged(docs.select("doc_id", "source", size_of().alias("size")), "mix-sizes")
    targets = _base.staged(source_targets(sizes, most), "mix-targets")
    out = copies(sizes, _base.sized(targets), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is copied, with all its columns."""
    names = docs.columns
    sizes = _base.staged(docs.select("source", size_of().alias("size")), "mix-sizes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source")
    targets = _base.staged(source_targets(sizes, most), "mix-targets")
    _base.drop(sizes)
    out = copies(rows, _base.sized(targets), seed).filter(F.col("copies") > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
    CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weight_before
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(all_size - cap_before AS DOUBLE) / CAST(all_weight - weight_before AS DOUBLE) AS level FROM c),
f AS (SELECT *, level > CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS is_full FROM l),
g AS (SELECT *, max(CASE WHEN NOT is_full THEN level END) OVER () AS common FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE common * weight END AS target FROM g),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies
FROM (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
"""
