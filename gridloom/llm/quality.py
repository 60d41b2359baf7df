"""Quality classifier: a factorisation machine over hashed words, word shapes and binned structure and length statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, labelled

#: Hashed features, bins of each statistic, rank of the pairwise weights.
BUCKETS, BINS, RANK = 1 << 16, 12, 8
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, SHRINK = 6, 64, 0.08, 1e-5
#: Bytes of text that are worked on at once; a longer text is cut between words.
CHUNK = 1 << 20


@dataclass
class Machine:
    """score = sigmoid(bias + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum (v x)^2))."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray  # (statistics, BINS - 1)

    def inputs(self, where, ids, count, stats):
        """Sparse rows: offsets, ids, values. Words and shapes have unit length together; each statistic adds its bin."""
        x = np.log1p(count).astype(np.float32)
        n, k = len(where) - 1, stats.shape[1]
        norm = np.sqrt(np.maximum(np.add.reduceat(np.append(x * x, 0), where[:-1]) * (np.diff(where) > 0), 1e-9)) if n else np.zeros(0)
        x = x / np.repeat(norm, np.diff(where)).astype(np.float32)
        bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, stats.T)], axis=1) + BUCKETS + BINS * np.arange(k)
        size = np.diff(where) + k
        off = np.concatenate([[0], np.cumsum(size)])
        out_ids, out_x = np.empty(off[-1], np.int64), np.empty(off[-1], np.float32)
        stat = off[1:, None] - k + np.arange(k)
        rest = np.ones(off[-1], bool)
        rest[stat.ravel()] = False
        out_ids[stat], out_x[stat] = bins, np.float32(1 / np.sqrt(k))
        out_ids[rest], out_x[rest] = ids, x
        return off, out_ids, out_x

    def forward(self, off, ids, x):
        at = off[:-1]
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, at, axis=0)
        z = self.bias + np.add.reduceat(self.w[ids] * x, at) + 0.5 * (s * s - np.add.reduceat(vx * vx, at, axis=0)).sum(1)
        return z, s, vx

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for _, features in labelled.features_by_parts(data, off, BUCKETS, CHUNK):
            z, _, _ = self.forward(*self.inputs(*features))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)


def fit(rows: list[tuple], labels: np.ndarray, stats: np.ndarray, seed: int = 1) -> Machine:
    """rows: (ids, counts) of each text. Logistic loss by AdaGrad, in an order that the seed fixes. Without labels: even odds;
    with one label alone: that label's odds."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + BINS * labelled.STATS
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(stats, q, axis=0).T.copy() if len(stats) else np.zeros((labelled.STATS, BINS - 1))
    p = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32), edges)
    if not 0 < labels.sum() < len(labels):
        m.v[:] = 0
        return m
    gw, gv = np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32)
    lengths = np.array([len(i) for i, _ in rows])
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            take = order[a : a + BATCH]
            where = np.concatenate([[0], np.cumsum(lengths[take])])
            off, ids, x = m.inputs(where, np.concatenate([rows[i][0] for i in take]), np.concatenate([rows[i][1] for i in take]), stats[take])
            z, s, vx = m.forward(off, ids, x)
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[take]) / len(take)
            m.bias -= RATE * float(d.sum())
            dx = np.repeat(d, np.diff(off)).astype(np.float32) * x
            to, inverse = np.unique(ids, return_inverse=True)
            dw = np.bincount(inverse, dx, len(to)).astype(np.float32) + SHRINK * m.w[to]
            each = dx[:, None] * (np.repeat(s, np.diff(off), axis=0) - vx)
            dv = np.stack([np.bincount(inverse, each[:, f], len(to)) for f in range(RANK)], axis=1).astype(np.float32) + SHRINK * m.v[to]
            gw[to] += dw * dw
            gv[to] += dv * dv
            m.w[to] -= RATE * dw / np.sqrt(gw[to])
            m.v[to] -= RATE * 0.5 * dv / np.sqrt(gv[to])
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.ROWS) -> Machine:
    """Learns in one task from a bounded sample of the labelled texts that are not held out; the driver gets the parameters alone."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, labels_, stats_ = [], [np.zeros(0)], [np.zeros((0, labelled.STATS))]
        for b in batches:
            labels_.append(b.column(1).to_numpy().astype(np.float64))
            for _, (where, ids, count, stats) in labelled.features_by_parts(*_base.texts_of(b.column(0)), BUCKETS, CHUNK):
                ids, count = ids.astype(np.int32), count.astype(np.int32)
                pairs += [(ids[a:z], count[a:z]) for a, z in zip(where[:-1], where[1:])]
                stats_.append(stats)
        y, stats = np.concatenate(labels_), np.concatenate(stats_)
        by = sorted(range(len(y)), key=lambda i: (len(pairs[i][0]), tuple(pairs[i][0][:8].tolist()), y[i]))  # whatever the order of the rows
        m = fit([pairs[i] for i in by], y[by], stats[by])
        yield labelled.parameters({"bias": np.array(m.bias), "w": m.w, "v": m.v, "edges": m.edges})

    _base.prepare(docs.sparkSession)
    got = labelled.learned(labelled.training_rows(docs, labels, label, rows), learn)
    if not got:  # without any rows no task learns
        return fit([], np.zeros(0), np.zeros((0, labelled.STATS)))
    return Machine(float(got["bias"]), got["w"], got["v"], got["edges"])


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and score, for each row; null and empty texts are scored by their statistics."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(machine)  # its size is fixed by BUCKETS and RANK
    _base.prepare(spark)
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.scores(*_base.texts_of(b.column(0)))
            yield pa.record_batch([*b.columns[1:], pa.array(s, pa.float64())], names=schema.names)

    return docs.select(F.col("text").alias(_base.fresh(docs, "text_")[0]), *keep).mapInArrow(run, schema)


def accepted(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is threshold or more, with all columns."""
    row, at = _base.fresh(docs, "row_", "score_")
    scored = score(docs.withColumn(row, F.struct(*(F.col(f"`{c}`") for c in docs.columns))), machine, [row])
    return scored.withColumnRenamed("score", at).filter(F.col(at) >= threshold).select(f"{row}.*")


def classify(docs: DataFrame, labels: DataFrame, rows: int = labelled.ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Labels of held-out ids are never read; null labels and labels without a document are left out; repeated labels of an id
    count once, the largest. A null id counts as an empty one. Rows with equal texts get equal scores; an empty table gives no
    rows; other columns are not read."""
    out = score(docs, train(docs, labels, "quality", rows), ["doc_id"])
    return out.select("doc_id", (labelled.fold() == labelled.HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
