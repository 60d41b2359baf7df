"""Nearest neighbours by largest inner product: an inverted file of coarse centroids with product-quantised residuals, distance tables
by decoded codes, and exact reranking of whatever the distance to its code leaves open."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, vectors

#: Rows that the index is fitted on; every row is indexed.
FIT = 16_000
#: Codewords of a subspace; components of a subspace, about. Random vectors need close codes for their bounds to leave out any.
WORDS, SUB = 256, 2
#: Rows of a block that are reranked for a query before its bounds are used, and sample rows that give a query its first bound.
RERANK, ANCHORS = 160, 4096
#: Rows of a block, and queries of one task.
BLOCK, QUERIES = 8192, 2048


@dataclass
class Index:
    coarse: np.ndarray
    cuts: np.ndarray  # where subspaces begin
    books: list[np.ndarray]
    radius: np.ndarray | None = None  # the largest distance of a list's rows to its centroid, below zero for a list without rows
    anchor_ids: np.ndarray | None = None
    anchors: np.ndarray | None = None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = vectors.nearest(x, self.coarse)
        rest = x - self.coarse[near]
        return near, np.stack([vectors.nearest(rest[:, a:b], w) for a, b, w in zip(self.cuts[:-1], self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.coarse[lists] + np.concatenate([w[codes[:, j]] for j, w in enumerate(self.books)], axis=1)

    def floors(self, q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """What the k nearest of each query reach at least: the k-th of the anchors with another id, which are rows of the table."""
        if len(self.anchors) < k:
            return np.full(len(q), -np.inf)
        s = q @ self.anchors.T
        s[ids[:, None] == self.anchor_ids] = -np.inf
        return -np.partition(-s, k - 1, axis=1)[:, k - 1] - norms(q) * rounding(norms(self.anchors).max(), q.shape[1])

    def probes(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The lists that can hold a row whose inner product with the query reaches its floor, as a mask: no row of a list is farther
        from its centroid than the list's radius."""
        far = self.radius + rounding(norms(self.coarse) + self.radius, q.shape[1])
        return (self.radius >= 0) & ~(q @ self.coarse.T + norms(q)[:, None] * far < floor[:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def rounding(size: np.ndarray | float, d: int) -> np.ndarray | float:
    """How far rounding moves an inner product of d terms of a vector of that size with one of unit length, at most."""
    return 1e-15 * (d + 8) * size


def nearest_of(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, x: np.ndarray, xid: np.ndarray, near: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its k nearest rows and their scores; rows below its floor may be left out. near: the rows as their
    codes have them, ids in order.

    The best by codes are scored exactly; the k-th of them is a bound, and whatever can reach it is scored too: an inner product
    differs from that by the code by the row's distance to its code times the query's length at most."""
    rerank = max(rerank, k)
    away, size = norms(x - near), rounding(norms(x) + norms(near), x.shape[1])
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1]
    for a in range(0, len(q), 128):
        p, own, length = q[a : a + 128], qid[a : a + 128, None] == xid, norms(q[a : a + 128])[:, None]
        s = p @ near.T
        s[own] = -np.inf
        first = np.sort(vectors.top(s, xid, rerank), axis=1)
        exact = np.full(s.shape, -np.inf)
        np.put_along_axis(exact, first, np.stack([(x[r] * v).sum(1) for r, v in zip(first, p)]), 1)
        exact[own] = -np.inf
        bound = floor[a : a + 128]
        if s.shape[1] > rerank:
            kth = -np.partition(-exact, k - 1, axis=1)[:, k - 1]
            bound = np.maximum(bound, kth - length[:, 0] * size.max())
            more = ~(s + length * (away + size) < bound[:, None]) & ~own
            np.put_along_axis(more, first, False, 1)
            some, rows = np.flatnonzero(more.any(1)), np.flatnonzero(more.any(0))
            i, j = np.nonzero(more)
            if 16 * len(i) > len(some) * len(rows):  # so many that one product is shorter
                exact[more] = (p[some] @ x[rows].T)[more[np.ix_(some, rows)]]
            else:
                for c in range(0, len(i), 8192):
                    exact[i[c : c + 8192], j[c : c + 8192]] = (x[j[c : c + 8192]] * p[i[c : c + 8192]]).sum(1)
            if len(i):
                bound = np.maximum(bound, -np.partition(-exact, k - 1, axis=1)[:, k - 1] - 2 * length[:, 0] * size.max())
        for v, e, b in zip(p, exact, bound):
            r = np.flatnonzero(~(e < b) & (e > -np.inf))
            _, one, each = np.unique(same[r], return_index=True, return_inverse=True)  # equal rows have one score
            e = (x[r[one]] * v).sum(1)[each]
            best = np.lexsort((r, -e))[:k]
            yield r[best], e[best]


def fit(x: np.ndarray, n: int) -> Index:
    """n: rows that will be indexed; the number of lists follows its root, within fixed bounds. Equal rows of the
    sample count once, lest a common vector takes the centroids."""
    x = np.unique(x, axis=0)
    lists = min(4096, max(16, 1 << round(math.log2(math.sqrt(max(n, 1)) / 2)) if n > 4 else 16))
    coarse = vectors.kmeans(x, min(lists, len(x)))
    rest = x - coarse[vectors.nearest(x, coarse)]
    parts = max(1, -(-x.shape[1] // SUB))
    cuts = np.linspace(0, x.shape[1], parts + 1).astype(int)
    return Index(coarse, cuts, [vectors.kmeans(rest[:, a:b], min(WORDS, len(x)), 2 + j, 6) for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])


def search(df: DataFrame, every: int = vectors.EVERY, k: int = vectors.K, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest for each row whose id is divisible by every, itself left out.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids or other lengths than
    the most frequent. Rows with one id are candidates each, but never for their own id's query. Ties go to the smaller id.
    Lists are dealt into blocks of at most some BLOCK rows, a large list into several by a hash of the id, so that equal vectors
    never meet in one task; queries, some QUERIES of neighbouring lists at a time, go to the blocks that hold a list they probe, and
    a block's rows to the groups of queries only that do so. What is left out, lists and rows, is left out by bounds, whatever the
    vectors are like; where they are loose more rows are scored."""
    spark = df.sparkSession
    _base.prepare(spark)
    rows = vectors.clean(df, zero=False)
    n = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    ids, some = vectors.sample(rows, FIT)
    index = fit(some, n)
    step = -(-len(ids) // ANCHORS)
    index.anchor_ids, index.anchors = ids[::step], some[::step]
    sent = spark.sparkContext.broadcast(index)  # lists, codewords, anchors and dimensions are bounded

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors.matrix(b.column(1))
            near, codes = sent.value.encode(x) if len(x) else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
            far = norms(x - sent.value.coarse[near]) if len(x) else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(near, pa.int32()), pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], names=["vec_id", "list", "far", "codes", "v"])

    indexed = _base.staged(rows.mapInArrow(encode, "vec_id long, list int, far double, codes binary, v array<double>"), "ann-index")
    held = {r["list"]: r for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # one for each list
    counts = {c: r["n"] for c, r in held.items()}
    index.radius = np.array([held[c]["far"] if c in held else -1.0 for c in range(len(index.coarse))])
    sized = spark.sparkContext.broadcast(index)
    first, parts, at, room = {}, {}, 0, BLOCK
    for c in sorted(counts):  # neighbouring lists share a block; a long one has its own
        if counts[c] > room:
            at, room = at + (room < BLOCK), BLOCK
        first[c], parts[c] = at, -(-counts[c] // BLOCK)
        if parts[c] > 1:
            at, room = at + parts[c], BLOCK
        else:
            room -= counts[c]
    of = spark.createDataFrame([(c, first[c], parts[c]) for c in counts], "list int, first int, parts int")
    coded = indexed.join(F.broadcast(of), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    blocks = {c: list(range(first[c], first[c] + parts[c])) for c in counts}
    queries = indexed.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "list")
    homes = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each list
    groups = {c: (a, n) for c, a, n in vectors.grouped(index.coarse, homes, QUERIES)}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
                q, ids = vectors.matrix(b.column(1)), b.column(0).to_numpy()
                floor = sized.value.floors(q, ids, k)
                to = [sorted({x for c in np.flatnonzero(m).tolist() for x in blocks.get(c, ())}) for m in sized.value.probes(q, floor)]
                each = np.repeat(np.arange(len(to)), [len(t) for t in to])
                part = np.array([groups[c][0] + i % groups[c][1] for c, i in zip(b.column(2).to_pylist(), ids.tolist())], np.int32)
                yield pa.record_batch([*(c.take(pa.array(each)) for c in (*b.columns[:2], pa.array(floor))), pa.array([x for t in to for x in t], pa.int32()), pa.array(part[each], pa.int32())], names=["query_id", "q", "floor", "block", "part"])

    asked = _base.staged(queries.mapInArrow(route, "query_id long, q array<double>, floor double, block int, part int"), "ann-queries")
    pairs = _base.staged(asked.select("block", "part").distinct(), "ann-pairs")
    spread = coded.select("block", "vec_id", "list", "codes", "v").join(_base.sized(pairs), "block")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("query_id"), right.sort_by("vec_id")
        q, x = vectors.matrix(left.column("q")), vectors.matrix(right.column("v"))
        qid, xid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        out: list[tuple] = []
        if len(q) and len(x):
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            near = sized.value.decode(right.column("list").to_numpy(), codes)
            for i, (r, score) in enumerate(nearest_of(q, qid, left.column("floor").to_numpy(), x, xid, near, k, rerank)):
                out.append((np.full(len(r), qid[i]), xid[r], score))
        qs, ids, scores = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(qs, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    found = asked.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInArrow(compare, "query_id long, vec_id long, score double")
    return vectors.best(found, k)
