"""Exact top-k inner products by dual-tree search: cover trees over queries and over data, node pairs pruned by their covering
radii against the worst k-th score of the queries below a node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, vectors

SCALE = 64
#: Rows that bound each query's k-th score from below beforehand, and that cells are laid around.
SEEDS = 2_000
#: Rows of a cell, queries of one task, rows of a leaf; children of a node, and by how much their radii shrink.
CELL, QUERIES, LEAF, CHILDREN, SHRINK = 4096, 2048, 256, 12, 1.4


def allowance(norm_q, reach_q, norm_d, reach_d):
    """By how much an inner product may exceed that of two centres, rounding included."""
    far = norm_q * reach_d + norm_d * reach_q + reach_q * reach_d
    return far + 1e-6 + 1e-12 * (norm_q * norm_d + far)


class CoverTree:
    """Nodes as rows: a centre among the points, the distance that covers all points below, and a range of the ordered points."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(x))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.x = x
        todo = [(self.node(0, len(x)), 0, len(x))] if len(x) else []
        while todo:
            node, lo, hi = todo.pop()
            if hi - lo <= leaf or self.radius[node] == 0:
                continue
            for a, b in self.cover(node, lo, hi):
                child = self.node(a, b)
                self.children[node].append(child)
                todo.append((child, a, b))
        self.points = x[self.order]
        self.at = x[self.centre] if self.centre else x
        self.reach = np.array(self.radius)
        self.norm = np.sqrt((self.at * self.at).sum(1))

    def node(self, lo: int, hi: int) -> int:
        """The first point is the centre."""
        mine = self.x[self.order[lo:hi]]
        self.centre.append(int(self.order[lo]))
        self.radius.append(float(np.sqrt(((mine - mine[0]) ** 2).sum(1).max())))
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.centre) - 1

    def cover(self, node: int, lo: int, hi: int) -> list[tuple[int, int]]:
        """Centres farthest first until all points lie within the shrunk radius of one, or there are CHILDREN; orders the points by them."""
        rows = self.order[lo:hi]
        mine = self.x[rows]
        near = ((mine - mine[0]) ** 2).sum(1)
        owner = np.zeros(len(mine), np.int64)
        centres = [0]
        while near.max() > (self.radius[node] / SHRINK) ** 2 and len(centres) < CHILDREN:
            far = int(near.argmax())
            d = ((mine - mine[far]) ** 2).sum(1)
            owner[d < near] = len(centres)
            near = np.minimum(near, d)
            centres.append(far)
        first = np.ones(len(mine), bool)
        first[centres] = False
        by = np.lexsort((first, owner))
        self.order[lo:hi] = rows[by]
        size = np.bincount(owner, minlength=len(centres))
        end = lo + np.cumsum(size)
        return list(zip((end - size).tolist(), end.tolist()))


class Search:
    """The k best of each query; kth is where a query's list ends, at least its seed."""

    def __init__(self, q: np.ndarray, qid: np.ndarray, seed: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> None:
        self.queries, self.data, self.k = CoverTree(q), CoverTree(x), k
        self.qid, self.xid = qid[self.queries.order], xid[self.data.order]
        self.seed = seed[self.queries.order].astype(np.float64)
        self.score = np.full((len(q), k), -np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.kth = self.seed.copy()
        self.pairs = 0

    def bound(self, a: int, b: list[int]) -> np.ndarray:
        """What no inner product between the points below a query node and below data nodes exceeds."""
        q, d = self.queries, self.data
        return d.at[b] @ q.at[a] + allowance(q.norm[a], q.reach[a], d.norm[b], d.reach[b])

    def run(self) -> None:
        if not len(self.qid) or not len(self.xid):
            return
        todo = [(0, [0])]
        while todo:
            a, data = todo.pop()
            lo, hi = self.queries.span[a]
            worst = self.kth[lo:hi].min()
            limit = self.bound(a, data)
            best = [i for i in np.argsort(-limit) if limit[i] >= worst]
            if not best:
                continue
            data = [data[i] for i in best]
            inner = [b for b in data if self.data.children[b]]
            below = self.queries.children[a]
            if not inner and not below:
                for b, most in zip(data, limit[best]):
                    if most < self.kth[lo:hi].min():
                        break  # so are all that follow
                    self.compare(a, b)
                continue
            # the node with the larger reach is opened; the others wait with what it opens into
            if inner and (not below or self.data.reach[inner].max() >= self.queries.reach[a]):
                todo.append((a, [c for b in data for c in (self.data.children[b] or [b])]))
            else:
                todo += [(c, data) for c in below]

    def compare(self, a: int, b: int) -> None:
        (q0, q1), (x0, x1) = self.queries.span[a], self.data.span[b]
        s = self.queries.points[q0:q1] @ self.data.points[x0:x1].T
        self.pairs += s.size
        s[self.qid[q0:q1, None] == self.xid[x0:x1]] = -np.inf
        row, col = np.nonzero(s >= self.kth[q0:q1, None])
        if not len(row):
            return
        # what is new together with what these queries have, in the order of the result; the first k of each stay
        rows = np.unique(row)
        old = np.repeat(rows, self.k)
        owner = np.concatenate([old, row])
        score = np.concatenate([self.score[q0 + rows].ravel(), s[row, col]])
        ids = np.concatenate([self.id[q0 + rows].ravel(), self.xid[x0 + col]])
        by = np.lexsort((ids, -score, owner))
        first = np.searchsorted(owner[by], rows)
        by = by[first[:, None] + np.arange(self.k)]
        self.score[q0 + rows], self.id[q0 + rows] = score[by], ids[by]
        self.kth[q0 + rows] = np.maximum(self.seed[q0 + rows], self.score[q0 + rows, -1])


def whole(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v with the whole numbers floor(scale * x)."""
    return vectors.clean(df, zero=True).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def search(df: DataFrame, every: int = vectors.EVERY, k: int = vectors.K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row whose id is divisible by every, itself left out.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do null ids or other lengths than the
    most frequent; zero vectors do. Rows with one id are candidates each, but never for their own id's query. Ties go to the
    smaller id. Inner products are exact up to 2**53.

    Rows are dealt to cells around pivots, a cell of many rows in parts by a hash of the id, and queries to groups by their
    nearest pivots. A query's k-th score among the seeds bounds its result from below: it goes to the cells only whose pivot and
    covering radius allow such a score, and a cell's rows go to the groups only that ask for it. A task holds some CELL rows and
    QUERIES queries."""
    spark = df.sparkSession
    _base.prepare(spark)
    rows = _base.staged(whole(df, scale), "exact-rows")
    n = _base.rows(rows)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    got = _base.smallest(rows, SEEDS, "vec_id").toArrow().sort_by("vec_id")
    seed_id, seeds = got.column("vec_id").to_numpy(), vectors.matrix(got.column("v"))
    pivots = vectors.kmeans(seeds, min(len(seeds), max(1, min(1024, -(-n // CELL)))))
    sent = spark.sparkContext.broadcast((seed_id, seeds, pivots))  # SEEDS rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors.matrix(b.column(1))
            near = vectors.nearest(x, sent.value[2]) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - sent.value[2][near]) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(far)], names=["vec_id", "v", "pivot", "far"])

    placed = _base.staged(rows.mapInArrow(place, "vec_id long, v array<double>, pivot int, far double"), "exact-placed")
    _base.drop(rows)
    first, at, reach = [], 0, np.full(len(pivots), -np.inf)
    for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).orderBy("pivot").collect():  # one for each pivot
        parts = -(-r["n"] // CELL)
        first.append((r["pivot"], at, parts))
        reach[r["pivot"]] = r["far"]
        at += parts
    of = spark.createDataFrame(first, "pivot int, first int, parts int")
    covers = spark.sparkContext.broadcast((np.flatnonzero(np.isfinite(reach)), np.sqrt((pivots * pivots).sum(1)), reach))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, centre = sent.value
        some, norm, far = covers.value
        for b in batches:
            q = vectors.matrix(b.column(1))
            seed, wants = np.full(len(q), -np.inf), []
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ x.T
                s[b.column(0).to_numpy()[a : a + 256, None] == ids] = -np.inf
                if s.shape[1] >= k:
                    seed[a : a + 256] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                own = np.sqrt((q[a : a + 256] ** 2).sum(1))[:, None]
                most = q[a : a + 256] @ centre[some].T + allowance(own, 0.0, norm[some], far[some])
                wants += [some[m] for m in most >= seed[a : a + 256, None]]
            where = np.concatenate([[0], np.cumsum([len(w) for w in wants])])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(seed), b.column(2), pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(np.concatenate([*wants, np.zeros(0, np.int64)]), pa.int32()))], names=["query_id", "q", "seed", "home", "wants"])

    asked = _base.staged(placed.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "pivot").mapInArrow(bounded, "query_id long, q array<double>, seed double, home int, wants array<int>"), "exact-queries")
    homes = {r["home"]: r["n"] for r in asked.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each pivot
    groups = spark.createDataFrame(vectors.grouped(pivots, homes, QUERIES), "home int, group int, groups int")
    asked = asked.join(F.broadcast(groups), "home").withColumn("part", F.col("group") + F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
    asked = asked.select("query_id", "q", "seed", "part", F.explode("wants").alias("pivot"))
    pairs = _base.staged(asked.select("part", "pivot").distinct(), "exact-pairs")
    asked = asked.join(F.broadcast(of), "pivot").select("query_id", "q", "seed", "part", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("cell"))
    cells = placed.join(F.broadcast(of), "pivot").select("vec_id", "v", "pivot", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).alias("cell"))
    spread = cells.join(_base.sized(pairs), "pivot").drop("pivot")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("query_id"), right.sort_by("vec_id")
        s = Search(vectors.matrix(left.column("q")), left.column("query_id").to_numpy(), left.column("seed").to_numpy(), vectors.matrix(right.column("v")), right.column("vec_id").to_numpy(), k)
        s.run()
        row, col = np.nonzero(np.isfinite(s.score))
        return pa.table({"query_id": pa.array(s.qid[row], pa.int64()), "vec_id": pa.array(s.id[row, col], pa.int64()), "score": pa.array(s.score[row, col].astype(np.int64))})

    found = asked.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(compare, "query_id long, vec_id long, score long")
    return vectors.best(found, k)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
