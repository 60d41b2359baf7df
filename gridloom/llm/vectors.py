"""What the searches over vectors share: which vectors take part, stated query sets, blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _base

#: Queries are the rows whose id is divisible by this.
EVERY = 20
K = 20


def takes_part(v: str, zero: bool) -> Column:
    """Not null, not empty, all components finite; with zero, a vector of zeros takes part too."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = finite if zero else finite & F.exists(v, lambda x: x != 0)
    return F.col(v).isNotNull() & (F.size(v) > 0) & some


def clean(df: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part; of several lengths the most frequent, as others have no inner product with it."""
    rows = df.filter(F.col("vec_id").isNotNull() & takes_part("embedding", zero)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("v") == most[0]["d"]) if most else rows


def sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded sample, the rows with the smallest hashes of their ids."""
    got = _base.smallest(rows.select("vec_id", "v"), most, "vec_id").toArrow().sort_by("vec_id")
    return got.column("vec_id").to_numpy(), matrix(got.column("v"))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def kmeans(x: np.ndarray, k: int, seed: int = 1, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = ((c * c).sum(1) - 2 * x[a : a + 4096] @ c.T).argmin(1)
    return out


def grouped(at: np.ndarray, counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(pivot, first group, groups) of the pivots at that queries are nearest to: neighbours share a group of at most some most
    queries, many queries of one pivot have several groups of their own."""
    left, order = dict(counts), []
    while left:
        here = at[order[-1]] if order else at[min(left)]
        keys = list(left)
        order.append(keys[int(((at[keys] - here) ** 2).sum(1).argmin())])
        del left[order[-1]]
    out, group, room = [], 0, most
    for p in order:
        if counts[p] > room and room < most:
            group, room = group + 1, most
        parts = -(-counts[p] // most)
        out.append((p, group, parts))
        if parts > 1:
            group, room = group + parts, most
        else:
            room -= counts[p]
    return out


def best(found: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: of each query's candidates from all blocks the k best, ties to the smaller id. A query has k
    candidates from each block at most, so its window is short."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, largest first, ties to smaller ids; ids are sorted."""
    n = scores.shape[1]
    if n <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), np.int64)
    above, equal = scores > kth, scores == kth
    need = k - above.sum(1)
    take = above | (equal & (np.cumsum(equal, axis=1) <= need[:, None]))
    out[:] = np.nonzero(take)[1].reshape(len(scores), k)
    order = np.argsort(-np.take_along_axis(scores, out, 1), axis=1, kind="stable")
    return np.take_along_axis(out, order, 1)
