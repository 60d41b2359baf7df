"""Clustering and the logistic disjunctive normal network: 1 - prod_i (1 - prod_j sigmoid(w_ij . x + b_ij)).

samples: sample long, xs array<double>, label boolean. weights: i int, j int, w array<double>, the bias last. Evaluation and one
gradient are relational and distributed; training in order of samples is sequential by definition and runs in one task, which
keeps the samples in a local file."""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.pixel import SIGMOID_HIGH, SIGMOID_LOW, TARGET_HIGH, TARGET_LOW, sigmoid, target
from gridloom.operators import sampling
from gridloom.sources.raster import workers_find_package


@dataclass(frozen=True)
class Params:
    """Groups, nodes of a group, and how they are trained."""

    groups: int = 10
    nodes: int = 20
    dropout: bool = False
    batch: int = 100
    passes: int = 15
    rate: float = 0.005
    momentum: float = 0.5
    downsample: int = 10
    repeats: int = 1
    seed: int = 1


def default_params(stage: int, level: int) -> Params:
    """Level 0: plain minibatches, fewer passes after the first stage. Other levels: a larger network with dropout, sample by sample."""
    if level:
        return Params(24, 24, True, 1, 15, 0.025)
    return Params() if stage == 1 else replace(Params(), passes=6)


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def dot(w: Column, x: Column) -> Column:
    """w . x and the bias after w's last weight."""
    n = F.size(w) - 1
    return F.aggregate(F.zip_with(F.slice(w, 1, n), x, lambda a, b: a * b), F.get(w, n), lambda acc, v: acc + v)


def assigned(samples: DataFrame, centres: DataFrame) -> DataFrame:
    """sample, cluster, d2: the nearest centre, ties to the smaller number. centres: j, c; there are few, and each sample meets all
    of them in one array, without a join."""
    table = centres.agg(F.array_sort(F.collect_list(F.struct("j", "c"))).alias("centres"))
    each = F.transform("centres", lambda p: F.struct(distance2(F.col("xs"), p["c"]).alias("d2"), p["j"].alias("j")))
    return samples.crossJoin(F.broadcast(table)).select("sample", "xs", F.array_min(each).alias("m")).select("sample", "xs", F.col("m.j").alias("cluster"), F.col("m.d2").alias("d2"))


def pairwise(samples: DataFrame, centres: DataFrame) -> DataFrame:
    """sample, j, d2 of all pairs with a few centres."""
    return samples.join(F.broadcast(centres)).select("sample", "j", distance2(F.col("xs"), F.col("c")).alias("d2"))


def means(rows: DataFrame, by: str, n: int) -> DataFrame:
    """by, n, c: the mean of xs of each group, summed by component before the shuffle."""
    aggs = [F.avg(F.get("xs", F.lit(k))).alias(f"m{k}") for k in range(n)]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggs).select(by, "n", F.array(*[f"m{k}" for k in range(n)]).alias("c"))


def whitened(samples: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """samples over each feature's standard deviation (1 where that is none), and the deviations as one row."""
    dev = samples.agg(*[F.stddev_pop(F.get("xs", F.lit(k))).alias(f"s{k}") for k in range(n)])
    dev = dev.select(F.array(*[F.when(F.col(f"s{k}") < 1e-10, 1.0).otherwise(F.col(f"s{k}")) for k in range(n)]).alias("dev"))
    out = samples.crossJoin(F.broadcast(dev)).withColumn("xs", F.zip_with("xs", "dev", lambda x, s: x / s)).drop("dev")
    return out, dev


def kmeans_step(samples: DataFrame, centres: DataFrame, n: int) -> tuple[DataFrame, float]:
    """New centres and the mean squared distance to the old ones. An empty cluster takes the sample that is farthest from its centre
    in a cluster of several."""
    near = assigned(samples, centres).persist()
    total = near.agg(F.avg("d2")).first()[0]
    new = means(near, "cluster", n).withColumnRenamed("cluster", "j")
    missing = centres.select("j").join(new, "j", "left_anti").orderBy("j").collect()
    if missing:
        many = near.filter("d2 > 0").join(new.filter("n > 1").select(F.col("j").alias("cluster")), "cluster", "left_semi")
        far = many.orderBy(F.desc("d2"), "sample").limit(len(missing)).collect()
        moved = {m["j"]: r["xs"] for m, r in zip(missing, far)}
        rows = [(r["j"], moved.get(r["j"], r["c"])) for r in centres.collect()]
        near.unpersist()
        if not moved:
            return samples.sparkSession.createDataFrame(rows, "j int, c array<double>"), total
        return kmeans_step(samples, samples.sparkSession.createDataFrame(rows, "j int, c array<double>"), n)
    rows = [(r["j"], r["c"]) for r in new.select("j", "c").collect()]  # as many as clusters
    near.unpersist()
    return samples.sparkSession.createDataFrame(rows, "j int, c array<double>"), total


#: Samples of so many bytes at most are clustered in one task: passes over them are far shorter than jobs.
CLUSTERED = 128 << 20
#: The task that trains clusters so many times as much, from local files.
FILED = 32


#: Rows that k-means and descent take from a file at once.
TAKEN = 4096


def np_nearest(p: np.ndarray, size: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each of some rows, whose squared lengths are given. Where products leave it open within rounding,
    differences decide."""
    own = (centres * centres).sum(1)
    rough = own[:, None] - 2 * (centres @ p.T)
    best, low, second = np.zeros(len(p), np.int64), rough[0], np.full(len(p), np.inf)
    for j in range(1, len(centres)):
        less = rough[j] < low
        best[less] = j
        second = np.minimum(second, np.maximum(rough[j], low))
        low = np.minimum(low, rough[j])
    close = np.flatnonzero(second <= low + 1e-9 * (size + own.max()))
    if len(close):
        best[close] = ((p[close][:, None] - centres) ** 2).sum(2).argmin(1)
    return best


def np_distances(x: np.ndarray, size: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance."""
    near, d2 = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), TAKEN):
        p = x[at : at + TAKEN]
        near[at : at + TAKEN] = best = np_nearest(p, size[at : at + TAKEN], centres)
        d2[at : at + TAKEN] = ((p - centres[best]) ** 2).sum(1)
    return near, d2


def np_kmeans_step(ids: np.ndarray, x: np.ndarray, size: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kmeans_step in numpy: the new centres, and those that rows were nearest to, of which empty ones moved."""
    while True:
        count, sums = np.zeros(len(centres)), np.zeros(centres.shape)
        for at in range(0, len(x), TAKEN):
            p = x[at : at + TAKEN]
            mine = (np_nearest(p, size[at : at + TAKEN], centres) == np.arange(len(centres))[:, None]).astype(float)
            count += mine.sum(1)
            sums += mine @ p
        missing = np.flatnonzero(count == 0)
        if not len(missing):
            return sums / count[:, None], centres
        near, d2 = np_distances(x, size, centres)
        many = np.flatnonzero((count[near] > 1) & (d2 > 0))
        far = many[np.lexsort((ids[many], -d2[many]))][: len(missing)]
        if not len(far):
            return centres, centres
        centres = centres.copy()
        centres[missing[: len(far)]] = x[far]


def filed(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of x at those places; many are in a local file, of which only what is read is in memory."""
    if 8 * len(at) * x.shape[1] <= EVALUATED:
        return np.array(x[at])
    with tempfile.TemporaryFile() as file:
        for a in range(0, len(at), TAKEN):
            file.write(x[at[a : a + TAKEN]].tobytes())
        file.flush()
        return np.frombuffer(mmap.mmap(file.fileno(), 0, prot=mmap.PROT_READ)).reshape(len(at), x.shape[1])


def np_kmeans_ml(ids: np.ndarray, x: np.ndarray, k: int, seed: int, most: int, coarse: int, least: int) -> tuple[np.ndarray, float]:
    """kmeans_ml in numpy, with the same draws."""
    drawn = np.frombuffer(b"".join(hashlib.md5(f"{seed}:{i}".encode()).digest() for i in ids.tolist()), ">u8").reshape(-1, 2)
    drawn = np.lexsort((ids, drawn[:, 1], drawn[:, 0]))
    third = (len(x) + coarse // 2) // coarse
    if third < least or third < k:
        centres = x[drawn[:k]]
    else:
        some = np.sort(drawn[:third])
        centres, _ = np_kmeans_ml(ids[some], filed(x, some), k, seed + 1, most, coarse, least)
    size, old = np.concatenate([(x[a : a + TAKEN] ** 2).sum(1) for a in range(0, len(x), TAKEN)]), centres
    for _ in range(most):
        before = centres
        centres, old = np_kmeans_step(ids, x, size, before)
        if np.array_equal(centres, before):  # so the error will not change either
            break
    return centres, float(np_distances(x, size, old)[1].mean())


def _clustered(samples: DataFrame, k: int, n: int, *how: int) -> tuple[DataFrame, float]:
    """kmeans_ml of samples that one task can hold, in the order of their numbers."""
    workers_find_package(samples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            parts.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
        centres, error = np_kmeans_ml(np.concatenate(ids), np.concatenate(parts), k, *how)
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(centres.tolist(), pa.list_(pa.float64())), pa.array([error] * k)], names=["j", "c", "error"])

    got = samples.select("sample", "xs").repartition(1).sortWithinPartitions("sample").mapInArrow(run, "j int, c array<double>, error double").collect()
    return samples.sparkSession.createDataFrame([(r["j"], r["c"]) for r in got], "j int, c array<double>"), got[0]["error"]


def kmeans_ml(samples: DataFrame, k: int, n: int, seed: int = 1, most: int = 100, coarse: int = 3, least: int = 50) -> tuple[DataFrame, float]:
    """Multilevel k-means: the centres of a random third, found likewise, begin; a small set begins with random samples. Ends when
    neither error nor centres change. Returns j, c and the mean squared distance."""
    count = samples.count()
    if count < k:
        raise ValueError(f"{count} samples are too few for {k} clusters")
    if 8 * n * count <= CLUSTERED:
        return _clustered(samples, k, n, seed, most, coarse, least)
    third = (count + coarse // 2) // coarse
    if third < least or third < k:
        rows = sampling.shuffled(samples, seed, "sample").limit(k).collect()
        centres = samples.sparkSession.createDataFrame([(j, r["xs"]) for j, r in enumerate(rows)], "j int, c array<double>")
    else:
        centres, _ = kmeans_ml(sampling.random_subset(samples, third, seed, "sample").persist(), k, n, seed + 1, most, coarse, least)
    before, error = None, None
    for _ in range(most):
        old = sorted((r["j"], r["c"]) for r in centres.collect())
        centres, error = kmeans_step(samples, centres, n)
        if before is not None and error >= before and sorted((r["j"], r["c"]) for r in centres.collect()) == old:
            break
        before = error
    return centres, error


def init_weights(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """i, j, w: the plane halfway between each positive and each negative centre, of unit length. Both are small tables (j, c)."""
    pairs = positive.select(F.col("j").alias("i"), F.col("c").alias("p")).join(F.broadcast(negative.select("j", F.col("c").alias("q"))))
    diff = F.zip_with("p", "q", lambda a, b: a - b)
    norm = F.sqrt(F.aggregate("d", F.lit(0.0), lambda acc, v: acc + v * v))
    w = pairs.withColumn("d", diff).withColumn("norm", norm).withColumn("u", F.transform("d", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(v)))
    bias = -0.5 * F.aggregate(F.zip_with(F.zip_with("p", "q", lambda a, b: a + b), "u", lambda s, u: s * u), F.lit(0.0), lambda acc, v: acc + v)
    return w.select("i", "j", F.concat("u", F.array(bias)).alias("w"))


def _table(weights: DataFrame) -> DataFrame:
    """One row with all groups of all nodes: a network's size is fixed by its parameters."""
    by = weights.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda p: p["w"]).alias("g"))
    return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda p: p["g"]).alias("net"))


def product(c: Column) -> Column:
    return F.aggregate(c, F.lit(1.0), lambda acc, v: acc * v)


def sigmas(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """samples with s: the sigmoid of each node, by group."""
    s = F.transform("net", lambda g: F.transform(g, lambda w: sigmoid(dot(w, F.col("xs")))))
    return samples.crossJoin(F.broadcast(_table(weights))).withColumn("s", s).drop("net")


def evaluate(samples: DataFrame, weights: DataFrame, dropout: bool = False) -> DataFrame:
    """samples with gs (each group's output) and f."""
    out = sigmas(samples, weights).withColumn("gs", F.transform("s", product)).drop("s")
    if dropout:
        return out.withColumn("f", 1.0 - F.sqrt(product(F.transform("gs", lambda g: 1.0 - F.sqrt(g)))))
    return out.withColumn("f", 1.0 - product(F.transform("gs", lambda g: 1.0 - g)))


def error(scored: DataFrame) -> DataFrame:
    """The root mean squared distance of f from the classes' targets."""
    d = F.col("f") - target(F.col("label"))
    return scored.agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def gradient(samples: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """i, j, grad: the gradient of the squared error summed over samples, which is distributed: a row for each sample and node is
    summed by component before the shuffle."""
    out = sigmas(samples, weights).withColumn("gs", F.transform("s", product))
    out = out.withColumn("f", 1.0 - product(F.transform("gs", lambda g: 1.0 - g)))
    c1 = -2.0 * (target(F.col("label")) - F.col("f")) * (1.0 - F.col("f"))
    out = out.select("xs", c1.alias("c1"), F.posexplode(F.arrays_zip("gs", "s")).alias("i", "g"))
    out = out.select("xs", "i", (F.col("c1") * F.col("g.gs") / (1.0 - F.least(F.col("g.gs"), F.lit(1 - 1e-16)))).alias("c2"), F.posexplode("g.s").alias("j", "s"))
    out = out.select("i", "j", "xs", (F.col("c2") * (1.0 - F.col("s"))).alias("c3"))
    parts = [F.sum(F.col("c3") * (F.get("xs", F.lit(k)) if k < n else F.lit(1.0))).alias(f"g{k}") for k in range(n + 1)]
    return out.groupBy("i", "j").agg(*parts).select("i", "j", F.array(*[f"g{k}" for k in range(n + 1)]).alias("grad"))


def np_forward(w: np.ndarray, x: np.ndarray, dropout: bool = False):
    """s (samples, groups, nodes), g, f in numpy; x has the constant feature last."""
    s = 1 / (1 + np.exp(-np.clip(np.einsum("ijk,sk->sij", w, x), SIGMOID_LOW, SIGMOID_HIGH)))
    g = s.prod(2)
    return s, g, 1 - np.sqrt((1 - np.sqrt(g)).prod(1)) if dropout else 1 - (1 - g).prod(1)


def descend(w: np.ndarray, x: np.ndarray, y: np.ndarray, p: Params) -> tuple[np.ndarray, list[float]]:
    """Stochastic gradient descent with momentum in minibatches, in an order that the seed fixes; with dropout each batch trains half
    of the groups and half of their nodes. Returns the weights and each pass's error."""
    rng = np.random.default_rng(p.seed)
    w, speed, errors = np.array(w, order="C"), np.zeros(w.shape), []
    goal = np.where(y, TARGET_HIGH, TARGET_LOW)
    n, m = w.shape[:2]
    many = p.batch * max(1, TAKEN // p.batch)
    for _ in range(p.passes):
        order, total = rng.permutation(len(x)), 0.0
        for first in range(0, len(x), many):
            taken = order[first : first + many]
            block, aims = x[taken], goal[taken]
            for at in range(0, len(taken), p.batch):
                b, part = block[at : at + p.batch], w
                if p.dropout:
                    active = np.ix_(np.sort(rng.permutation(n)[: max(1, n // 2)]), np.sort(rng.permutation(m)[: max(1, m // 2)]))
                    part = w[active]
                # np_forward in fewer calls: batches are small and many
                z = b @ part.reshape(-1, w.shape[2]).T
                np.maximum(np.minimum(z, SIGMOID_HIGH, out=z), SIGMOID_LOW, out=z)
                s = (1 / (1 + np.exp(-z))).reshape(len(b), *part.shape[:2])
                g = np.multiply.reduce(s, axis=2)
                rest = np.multiply.reduce(1 - g, axis=1)
                off = aims[at : at + p.batch] - 1 + rest
                total += float(off @ off)
                c3 = (-2 * off * rest)[:, None] * g / (1 - np.minimum(g, 1 - 1e-16))
                grad = ((c3[:, :, None] * (1 - s)).reshape(len(b), -1).T @ b).reshape(part.shape)
                if p.dropout:
                    speed[active] = grad + p.momentum * speed[active]
                    w[active] -= p.rate * speed[active]
                else:
                    speed *= p.momentum
                    speed += grad
                    w -= p.rate * speed
        errors.append(float(np.sqrt(total / max(len(x), 1))))
    return w, errors


class FileRows:
    """Rows of doubles in an open file, read by number, or by place in an order: descent visits all in random order, however many
    there are. The file is mapped, so the machine keeps in memory what there is room for."""

    def __init__(self, file: int, rows: int, width: int, order: np.ndarray | None = None):
        self.data = np.frombuffer(mmap.mmap(file, 0, prot=mmap.PROT_READ)).reshape(rows, width) if rows else np.zeros((0, width))
        self.order, self.shape = order, (rows, width)

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, take: np.ndarray) -> np.ndarray:
        return self.data[take if self.order is None else self.order[take]]


def np_start(ids: np.ndarray, rows: FileRows, classes: list[np.ndarray], p: Params, n: int) -> np.ndarray:
    """Initial weights in numpy from the places of the rows of both classes, in their order: every downsample-th of a class is
    clustered, if there are many."""
    centres = []
    for mine, k in zip(classes, (p.groups, p.nodes)):
        at = mine[:: p.downsample] if len(mine) > k * p.downsample else mine
        parts = lambda at=at: (rows[at[a : a + TAKEN]][:, :n] for a in range(0, len(at), TAKEN))
        mean = sum(x.sum(0) for x in parts()) / len(at)
        dev = np.sqrt(sum(((x - mean) ** 2).sum(0) for x in parts()) / len(at))
        dev[dev < 1e-10] = 1.0
        x = filed(Whitened(rows, dev), at)
        got = min((np_kmeans_ml(ids[at], x, k, p.seed + 100 * r, 100, 3, 50) for r in range(p.repeats)), key=lambda c: c[1])
        centres.append(got[0] * dev)
    a, b = centres[0][:, None], centres[1][None]
    norm = np.sqrt(((a - b) ** 2).sum(2, keepdims=True))
    u = (a - b) / np.where(norm > 0, norm, 1.0)
    return np.concatenate([u, -0.5 * ((a + b) * u).sum(2, keepdims=True)], 2)


class Whitened:
    """The first components of rows over their deviations."""

    def __init__(self, rows: FileRows, dev: np.ndarray):
        self.rows, self.dev, self.shape = rows, dev, (len(rows), len(dev))

    def __getitem__(self, take: np.ndarray) -> np.ndarray:
        return self.rows[take][:, : len(self.dev)] / self.dev


def _start(samples: DataFrame, p: Params, n: int) -> np.ndarray:
    """np_start by jobs, for classes that a task cannot hold."""
    centres = []
    for positive, k in ((True, p.groups), (False, p.nodes)):
        mine = samples.withColumn("mine", F.col("label") == positive)
        some = sampling.every(mine, p.downsample, k, "mine", "sample").select("sample", "xs")
        white, dev = whitened(some, n)
        white = white.persist()
        got = min((kmeans_ml(white, k, n, p.seed + 100 * r) for r in range(p.repeats)), key=lambda c: c[1])
        white.unpersist()
        centres.append(got[0].crossJoin(F.broadcast(dev)).select("j", F.zip_with("c", "dev", lambda c, s: c * s).alias("c")))
    start = sorted((r["i"], r["j"], r["w"]) for r in init_weights(*centres).collect())
    return np.array([r[2] for r in start]).reshape(p.groups, p.nodes, n + 1)


def trained(samples: DataFrame, p: Params, n: int) -> tuple[np.ndarray, list[float]]:
    """Initial weights from clusters of both classes, then descent over all samples, both in one task, which reads the samples once;
    what is clustered is in local files, and only beyond FILED times CLUSTERED bytes of a class it takes jobs, of which there are
    some for each step. Returns the weights and each pass's error."""
    workers_find_package(samples.sparkSession)
    held = {r["label"]: r["n"] for r in samples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clustered = 0
    for positive, k in ((True, p.groups), (False, p.nodes)):
        rows = held.get(positive, 0)
        if rows < k:
            raise ValueError(f"{rows} rows are too few for {k} clusters")
        clustered = max(clustered, rows if rows <= k * p.downsample else -(-rows // p.downsample))
    start = _start(samples, p, n) if 8 * n * clustered > FILED * CLUSTERED else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            ids, labels, known = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(-1, n)
                file.write(np.column_stack([x, np.ones(len(x))]).tobytes())
                labels.append(b.column(1).fill_null(False).to_numpy(zero_copy_only=False))
                known.append(b.column(1).is_valid().to_numpy(zero_copy_only=False))
                ids.append(b.column(2).to_numpy(zero_copy_only=False))
            file.flush()
            y = np.concatenate(labels)
            ids = np.concatenate(ids)
            order = np.argsort(ids, kind="stable")
            y = y[order]
            rows = FileRows(file.fileno(), len(y), n + 1, order)
            w0 = start
            if w0 is None:
                w0 = np_start(ids[order], rows, [np.flatnonzero(y), np.flatnonzero(~y & np.concatenate(known)[order])], p, n)
            w, errors = descend(w0, rows, y, p)
        yield pa.record_batch([pa.array([w.ravel().tolist()], pa.list_(pa.float64())), pa.array([errors], pa.list_(pa.float64()))], names=["w", "errors"])

    got = samples.select("xs", "label", "sample").repartition(1).mapInArrow(run, "w array<double>, errors array<double>").first()
    return np.array(got["w"]).reshape(p.groups, p.nodes, n + 1), list(got["errors"])


def train(samples: DataFrame, p: Params, n: int) -> tuple[DataFrame, list[float]]:
    """trained, with the weights as a table."""
    w, errors = trained(samples, p, n)
    return weights_frame(samples.sparkSession, w), errors


#: Bytes that the rows evaluated at once take.
EVALUATED = 16 << 20


def evaluation_bytes(n: int, groups: int, nodes: int) -> int:
    """What the evaluation of one row takes: its features, and of each group its nodes' and its own output, as doubles."""
    return 8 * (n + groups * (nodes + 1))


def evaluated_in_batches(rows: DataFrame, weights: np.ndarray, dropout: bool, keep: list[str]) -> DataFrame:
    """keep and f by numpy in Arrow batches: for networks and features too wide for expressions. The weights are of fixed size."""
    workers_find_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    schema = rows.select(*keep, F.lit(0.0).alias("f")).schema
    step = max(1, EVALUATED // evaluation_bytes(weights.shape[2] - 1, *weights.shape[:2]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.column_stack([np.stack(b["xs"].to_numpy()), np.ones(len(b))]) if len(b) else np.zeros((0, sent.value.shape[2]))
            f = np.concatenate([np_forward(sent.value, x[a : a + step], dropout)[2] for a in range(0, len(x), step)]) if len(x) else np.zeros(0)
            yield b[keep].assign(f=f)

    return rows.select(*keep, "xs").mapInPandas(run, schema)


def weights_array(weights: DataFrame) -> np.ndarray:
    rows = sorted((r["i"], r["j"], r["w"]) for r in weights.select("i", "j", "w").collect())
    n, m = rows[-1][0] + 1, rows[-1][1] + 1
    return np.array([r[2] for r in rows]).reshape(n, m, -1)


def weights_frame(spark: SparkSession, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, w[i, j].tolist()) for i in range(w.shape[0]) for j in range(w.shape[1])], "i int, j int, w array<double>")


@dataclass(frozen=True)
class Classifier:
    """What the cascade needs of a kind of classifier; its weights are an array, its parameters a dataclass."""

    params: type
    learn: Callable[[DataFrame, object, int], tuple[np.ndarray, list[float]]]
    evaluate: Callable[[DataFrame, np.ndarray, object, list[str]], DataFrame]
    bytes: Callable[[object, int], int]


#: The kinds of classifiers by name; others may be added.
CLASSIFIERS = {"ldnn": Classifier(Params, trained, lambda rows, w, p, keep: evaluated_in_batches(rows, w, p.dropout, keep), lambda p, n: evaluation_bytes(n, p.groups, p.nodes))}
