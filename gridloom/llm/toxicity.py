"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base, labelled

#: Hashed words and byte pairs, and how many numbers stand for each.
WORDS, PAIRS, WORD_DIM, PAIR_DIM = 1 << 16, 1 << 12, 8, 6
#: Hidden numbers of each direction; words of a window, and from one window to the next.
HIDDEN, WINDOW, STRIDE = 8, 32, 16
THRESHOLD = 0.5
#: At most so many labelled rows are learned from.
ROWS = 8_000
#: Passes, and how many of them take windows of a text at random; windows of a step; step size.
EPOCHS, SPREAD, BATCH, RATE = 6, 2, 64, 0.01
CHUNK = 1 << 20
#: Windows that go through the network at once, and that are cut at once.
LANES, CUT = 4096, 1 << 15
PARAMETERS = ("words", "pairs", "wx", "bx", "uf", "ub", "att", "out", "bias")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Batch:
    """Texts as windows: the distinct words (bucket, and byte pairs as ragged rows), and each window's words, -1 after the end."""

    bucket: np.ndarray
    pairs: np.ndarray
    pair_off: np.ndarray
    windows: np.ndarray  # (windows, WINDOW) of distinct words
    first: np.ndarray  # each text's first window; a text without words has none


def batch_of(data: np.ndarray, off: np.ndarray) -> Batch:
    starts, ends = _base.word_bounds(data, off)
    words, at = _base.words_of(data, off)
    distinct, first, index = np.unique(words, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    n = e - s
    byte = data[_base.ranges(s, n)].astype(np.uint64)
    byte[(byte >= 65) & (byte <= 90)] += np.uint64(32)
    pair_off = np.concatenate([[0], np.cumsum(n + 1)])
    # the byte pairs of a word between two marks, so a word has one more pair than bytes
    left, right = np.zeros(pair_off[-1], np.uint64), np.zeros(pair_off[-1], np.uint64)
    inner = _base.ranges(pair_off[:-1], n)
    right[inner] = byte
    left[inner + 1] = byte
    pairs = (_base.mix(left * np.uint64(256) + right + np.uint64(1)) % np.uint64(PAIRS)).astype(np.int64)
    count = np.diff(at)
    many = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    of = np.concatenate([[0], np.cumsum(many)])
    start = _base.ranges(np.zeros(len(count), np.int64), many) * STRIDE
    first_word, ends_at = np.repeat(at[:-1], many) + start, np.repeat(at[1:], many)
    index, windows = index.astype(np.int32), np.full((len(start), WINDOW), -1, np.int32)
    for part in (slice(a, a + CUT) for a in range(0, len(start), CUT)):
        place = first_word[part, None] + np.arange(WINDOW)
        inside = place < ends_at[part, None]
        windows[part][inside] = index[place[inside]]
    return Batch((distinct % np.uint64(WORDS)).astype(np.int64), pairs, pair_off, windows, of)


class Network:
    def __init__(self, prior: float, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        f = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        d, h = WORD_DIM + PAIR_DIM, HIDDEN
        self.words, self.pairs = np.zeros((WORDS, WORD_DIM), np.float32), f(0.5, PAIRS, PAIR_DIM)  # a word not learned adds nothing
        self.wx, self.bx = f(1 / np.sqrt(d), d, 6 * h), np.zeros(6 * h, np.float32)
        self.uf, self.ub = f(1 / np.sqrt(h), h, 3 * h), f(1 / np.sqrt(h), h, 3 * h)
        self.att, self.out = f(0.3, 2 * h), f(0.3, 2 * h)
        self.bias = np.array([np.log(prior / (1 - prior))], np.float32)

    def inputs(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct words: their numbers, and these through the input weights; a last row leaves the state as it is."""
        n = np.diff(b.pair_off)
        x = np.empty((len(b.bucket), WORD_DIM + PAIR_DIM), np.float32)
        x[:, :WORD_DIM] = self.words[b.bucket]
        if len(n):
            x[:, WORD_DIM:] = np.add.reduceat(self.pairs[b.pairs], b.pair_off[:-1], axis=0) / n[:, None]
        pre = np.zeros((len(x) + 1, 6 * HIDDEN), np.float32)
        pre[:-1] = x @ self.wx + self.bx
        pre[-1, :HIDDEN] = pre[-1, 3 * HIDDEN : 4 * HIDDEN] = 30
        return x, pre

    def direction(self, pre: np.ndarray, windows: np.ndarray, u: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
        """The states after each word, (WINDOW, windows, HIDDEN). pre: update, reset and candidate parts side by side."""
        h = HIDDEN
        part = np.ascontiguousarray(pre[:, 3 * h :] if backward else pre[:, : 3 * h])
        state = np.zeros((len(windows), h), np.float32)
        out = np.empty((windows.shape[1], len(windows), h), np.float32)
        for t in range(windows.shape[1])[:: -1 if backward else 1]:
            a, r = part[windows[:, t]], state @ u
            gates = sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
            z, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + reset * r[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, reset, new, r[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def pooled(self, states: np.ndarray, windows: np.ndarray):
        """Attention over the words of each window; the logits."""
        s = states @ self.att
        s[windows.T < 0] = -1e9
        s = np.exp(s - s.max(0))
        a = s / s.sum(0)
        p = np.einsum("tn,tnd->nd", a, states)
        return p @ self.out + self.bias[0], a, p

    def logits(self, b: Batch) -> np.ndarray:
        _, pre = self.inputs(b)
        out = np.empty(len(b.windows), np.float32)
        for at in range(0, len(out), LANES):
            w = b.windows[at : at + LANES]
            states = np.concatenate([self.direction(pre, w, self.uf, False), self.direction(pre, w, self.ub, True)], axis=2)
            out[at : at + LANES] = self.pooled(states, w)[0]
        return out

    def text_logits(self, b: Batch) -> np.ndarray:
        """The largest logit of a text's windows; the bias alone for a text without words."""
        out = np.full(len(b.first) - 1, self.bias[0], np.float64)
        has = b.first[1:] > b.first[:-1]
        if has.any():
            out[has] = np.maximum.reduceat(self.logits(b), b.first[:-1][has])
        return out

    def long_logit(self, data: np.ndarray) -> float:
        """The same of one long text: runs of LANES windows one after the other, so that only some of its words are held as numbers."""
        starts, ends = _base.word_bounds(data, np.array([0, len(data)]))
        top, last = float(self.bias[0]) if not len(starts) else -np.inf, max(0, len(starts) - WINDOW)
        for first in range(0, last + STRIDE if len(starts) else 0, LANES * STRIDE):
            to = min(len(starts), first + (LANES - 1) * STRIDE + WINDOW)
            part = data[starts[first] : ends[to - 1]]
            top = max(top, float(self.text_logits(batch_of(part, np.array([0, len(part)])))[0]))
        return top

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for part in _base.segments(np.diff(off), CHUNK):
            o = off[part.start : part.stop + 1]
            text = data[o[0] : o[-1]]
            z = self.text_logits(batch_of(text, o - o[0])) if len(text) <= CHUNK else np.array([self.long_logit(text)])
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)

    def gradients(self, b: Batch, windows: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean logistic loss over windows; for words and pairs as (ids, gradient)."""
        h = HIDDEN
        used, inverse = np.unique(windows[windows >= 0], return_inverse=True)
        local = np.full(windows.shape, -1, np.int64)
        local[windows >= 0] = inverse
        n = np.diff(b.pair_off)[used]
        sub = Batch(b.bucket[used], b.pairs[_base.ranges(b.pair_off[:-1][used], n)], np.concatenate([[0], np.cumsum(n)]), local, b.first)
        x, pre = self.inputs(sub)
        kept: tuple[list, list] = ([], [])
        states = np.concatenate([self.direction(pre, local, u, back, kept[back]) for u, back in ((self.uf, False), (self.ub, True))], axis=2)
        z, a, p = self.pooled(states, local)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y).astype(np.float32) / len(y)
        g = {"bias": np.array([d.sum()]), "out": p.T @ d}
        dp = d[:, None] * self.out
        da = np.einsum("nd,tnd->tn", dp, states)
        ds = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnd->d", ds, states)
        dstates = a[:, :, None] * dp + ds[:, :, None] * self.att
        dpre = np.zeros_like(pre)
        for back, u, name in ((0, self.uf, "uf"), (1, self.ub, "ub")):
            du, carry = np.zeros_like(u), np.zeros((len(local), h), np.float32)
            for t, before, zg, reset, new, rn in reversed(kept[back]):
                dh = carry + dstates[t, :, back * h : (back + 1) * h]
                dnew = dh * (1 - zg) * (1 - new * new)
                dz = dh * (before - new) * zg * (1 - zg)
                dr = dnew * rn * reset * (1 - reset)
                to_r = np.concatenate([dz, dr, dnew * reset], axis=1)
                carry = dh * zg + to_r @ u.T
                du += before.T @ to_r
                np.add.at(dpre, (local[:, t], slice(3 * h * back, 3 * h * (back + 1))), np.concatenate([dz, dr, dnew], axis=1))
            g[name] = du
        dpre = dpre[:-1]
        g["wx"], g["bx"] = x.T @ dpre, dpre.sum(0)
        dx = dpre @ self.wx.T
        g["words"] = _summed(sub.bucket, dx[:, :WORD_DIM])
        g["pairs"] = _summed(sub.pairs, np.repeat(dx[:, WORD_DIM:] / n[:, None], n, axis=0))
        return g


def _summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    to, inverse = np.unique(ids, return_inverse=True)
    return to, np.stack([np.bincount(inverse, r, len(to)) for r in rows.T], axis=1).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Network:
    """First all windows of a text have its label; then its highest window alone, as that is what scores it. Adam, in an order
    that the seed fixes. With one label alone, or none: a constant score."""
    rng = np.random.default_rng(seed)
    net = Network((labels.sum() + 1) / (len(labels) + 2), seed)
    if not 0 < labels.sum() < len(labels):
        net.out[:] = 0
        return net
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    b = batch_of(data, off)
    owner = np.repeat(np.arange(len(texts)), np.diff(b.first))
    has = np.flatnonzero(np.diff(b.first))
    m1 = {k: np.zeros_like(getattr(net, k)) for k in PARAMETERS}
    m2 = {k: np.zeros_like(getattr(net, k)) for k in PARAMETERS}
    step = 0
    for epoch in range(EPOCHS):
        if epoch < SPREAD:  # a few windows of each text
            pick = rng.permutation(len(b.windows))
            rank = np.empty(len(pick), np.int64)
            by = np.argsort(owner[pick], kind="stable")
            rank[by] = np.arange(len(pick)) - b.first[:-1][owner[pick][by]]
            take = pick[rank < 4]
        else:
            order = np.lexsort((-net.logits(b), owner))
            second = (b.first[:-1] + 1)[np.flatnonzero((np.diff(b.first) > 1) & (labels == 0))]
            take = order[np.concatenate([b.first[:-1][has], second])]  # the second window of a clean text is clean too
        take = rng.permutation(take)
        for at in range(0, len(take), BATCH):
            w = take[at : at + BATCH]
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * (1 if epoch < EPOCHS - 1 else 0.3)
            for k, v in net.gradients(b, b.windows[w], labels[owner[w]]).items():
                p = getattr(net, k)
                to, v = v if isinstance(v, tuple) else (slice(None), v)
                m1[k][to] = 0.9 * m1[k][to] + 0.1 * v
                m2[k][to] = 0.999 * m2[k][to] + 0.001 * v * v
                p[to] -= rate * m1[k][to] / (np.sqrt(m2[k][to]) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> Network:
    """Learns in one task from a bounded sample of the labelled texts that are not held out; the driver gets the parameters alone."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted(p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        net = fit([t for t, _ in pairs], np.array([y for _, y in pairs], np.float64))
        yield labelled.parameters({k: getattr(net, k) for k in PARAMETERS})

    _base.prepare(docs.sparkSession)
    some = labelled.training_rows(docs, labels, label, rows).select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), "label")
    got = labelled.learned(some, learn)
    net = fit([], np.zeros(0))  # without any rows no task learns
    for k, v in got.items():
        setattr(net, k, v)
    return net


def classify(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs: the highest score of the overlapping windows of the whole text.

    Labels of held-out ids are never read; null labels and labels without a document are left out; repeated labels of an id
    count once, the largest. Null and empty texts have the score of the bias. A null id counts as an empty one. Rows with equal
    texts get equal scores; an empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs, labels, "toxic", rows))  # its size is fixed by WORDS and PAIRS
    _base.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(sent.value.scores(*_base.texts_of(b.column(1))), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (labelled.fold() == labelled.HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
