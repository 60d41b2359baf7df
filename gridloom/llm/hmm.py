"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by the scaled forward recursion.

The states emit symbols: the most frequent words, one each; a class for the endings of all other words; and the end of a text.
A word of a class has the share (c + 0.5) / (T + 0.5 (V + 1)) of it, c being its training count, T and V the count and number of
words of the class, so that all words, known or not, have probabilities that sum to 1."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base

#: States, words with a symbol of their own, classes of endings.
STATES, WORDS, CLASSES = 8, 4096, 512
SYMBOLS = WORDS + CLASSES + 1
END = SYMBOLS - 1
#: Words whose counts go to every worker, the most frequent; all others are looked up by a join.
HOT = 400_000
#: Passes of Baum-Welch over all training texts end once log10 of a token's likelihood rises by less than GAIN, or after PASSES.
PASSES, GAIN = 12, 0.001
#: Tokens of the pieces that a text is worked on in, joined at their ends; texts that the start is made from.
PIECE, START = 256, 2_000
FOLDS, HELD_OUT = 5, 1
#: Bytes of text, and tokens, that are worked on at once.
CHUNK, TOKENS = 4 << 20, 1 << 18
#: A word's count is held back by so much; what each symbol has beforehand.
PRIOR = 5.0


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def endings(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The class of each word, from its last three bytes."""
    starts, ends = _base.word_bounds(data, off)
    x = np.zeros(len(starts), np.uint64)
    for k in (1, 2, 3):
        at = ends - k
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint64) if len(starts) else x
        byte[(byte >= 65) & (byte <= 90)] += np.uint64(32)
        x = x * np.uint64(256) + byte
    return (_base.mix(x + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


def _distinct(data: np.ndarray, off: np.ndarray):
    """Distinct words, their classes, the index of each word's, and the offsets of each text's words."""
    words, at = _base.words_of(data, off)
    distinct, first, index = np.unique(words, return_index=True, return_inverse=True)
    return distinct, endings(data, off)[first], index, at


def counts(docs: DataFrame) -> DataFrame:
    """w, cls, c of all words of all texts. Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = _base.texts_of(b.column(0))
            for part in _base.segments(np.diff(off), CHUNK):
                o = off[part.start : part.stop + 1]
                w, cls, index, _ = _distinct(data[o[0] : o[-1]], o - o[0])
                yield pa.record_batch([pa.array(_base.signed(w)), pa.array(cls, pa.int32()), pa.array(np.bincount(index, minlength=len(w)), pa.int64())], names=["w", "cls", "n"])

    rows = docs.select("text").mapInArrow(run, "w long, cls int, n long")
    return _base.staged(rows.groupBy("w").agg(F.min("cls").alias("cls"), F.sum("n").alias("c")), "hmm-counts")


@dataclass
class Vocabulary:
    hot: np.ndarray  # sorted hashes of the most frequent words
    count: np.ndarray
    symbol: np.ndarray  # of the hot words; -1: by class
    share: np.ndarray  # log10 of T + 0.5 (V + 1) of each class
    tokens: int
    words: int
    end: int

    def of(self, w: np.ndarray, cls: np.ndarray):
        """Of distinct words: symbols, counts (0 if not hot), hot."""
        at = np.minimum(np.searchsorted(self.hot, w), max(len(self.hot) - 1, 0))
        hot = self.hot[at] == w if len(self.hot) else np.zeros(len(w), bool)
        own = np.where(hot, self.symbol[at] if len(self.hot) else -1, -1)
        return np.where(own >= 0, own, WORDS + cls), np.where(hot, self.count[at] if len(self.hot) else 0, 0), hot


def vocabulary(table: DataFrame, texts: int, hot: int = HOT) -> Vocabulary:
    """The hot words are all with at least a count that leaves at most hot of them; the other sums are made by Spark."""
    bins = sorted(((r["bin"], r["n"], r["c"]) for r in table.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()), reverse=True)
    least, room = None, hot
    for b, n, _ in bins:
        room -= n
        if room < 0:
            break
        least = b
    empty = np.zeros(0, np.int64)
    w, cls, c = empty, empty, empty
    if least is not None:
        got = table.filter(F.floor(F.log2("c") * 16) >= least).select("w", "cls", "c").toArrow()
        w, cls, c = (got.column(k).to_numpy().astype(np.int64) for k in ("w", "cls", "c"))
    order = np.argsort(w.view(np.uint64))
    w, cls, c = w[order].view(np.uint64), cls[order], c[order]
    symbol = np.full(len(w), -1, np.int64)
    top = np.lexsort((w, -c))[:WORDS]
    symbol[top] = np.arange(len(top))
    total, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in table.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect():
        total[r["cls"]], words[r["cls"]] = r["c"], r["n"]
    np.subtract.at(total, cls[top], c[top])
    np.subtract.at(words, cls[top], 1)
    tokens = sum(b[2] for b in bins) + texts
    return Vocabulary(w, c, symbol, np.log10(total + 0.5 * (words + 1)), tokens, sum(b[1] for b in bins) + (texts > 0), texts)


ROWS = "rid long, doc_id long, symbols array<short>, n long, known long, base double, inner double, rare array<long>, times array<int>"


def encoded(docs: DataFrame, sent) -> DataFrame:
    """Each text as symbols; its sums over hot words: known tokens, log10(c + 0.5) of all and, less the classes' shares, of those
    without a symbol; and its other words and how often it has them. Staged, so that all passes see the same row ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        end = np.log10(v.end + 0.5)
        for b in batches:
            data, off = _base.texts_of(b.column(2))
            for part in _base.segments(np.diff(off), CHUNK):
                o = off[part.start : part.stop + 1]
                w, cls, index, at = _distinct(data[o[0] : o[-1]], o - o[0])
                n = len(at) - 1
                symbol, count, hot = v.of(w, cls)
                log = np.where(hot, np.log10(count + 0.5), 0)
                inner = np.where(symbol >= WORDS, log - v.share[cls], 0)
                per = lambda x: (s := np.concatenate([[0], np.cumsum(x[index])]))[at[1:]] - s[at[:-1]]
                size = np.diff(at)
                to = at + np.arange(n + 1)  # each text has an end more
                symbols = np.full(to[-1], END, np.int16)
                ends = np.zeros(to[-1], bool)
                ends[to[1:] - 1] = True
                symbols[~ends] = symbol[index]
                rare = np.flatnonzero(~hot[index])
                owner = np.repeat(np.arange(n), size)[rare]
                key = np.lexsort((index[rare], owner))
                owner, word = owner[key], index[rare][key]
                new = np.ones(len(key), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])
                head = np.flatnonzero(new)
                where = pa.array(np.searchsorted(owner[head], np.arange(n + 1)), pa.int32())
                yield pa.record_batch([
                    b.column(0).slice(part.start, n), b.column(1).slice(part.start, n), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(symbols)), pa.array(size + 1, pa.int64()),
                    pa.array(per(hot.astype(np.int64)) + (v.end > 0), pa.int64()), pa.array(per(log) + end), pa.array(per(inner).astype(np.float64)),
                    pa.ListArray.from_arrays(where, pa.array(_base.signed(w[word[head]]))), pa.ListArray.from_arrays(where, pa.array(np.diff(np.append(head, len(key))), pa.int32())),
                ], names=["rid", "doc_id", "symbols", "n", "known", "base", "inner", "rare", "times"])

    return _base.staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS), "hmm-texts")


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (SYMBOLS, STATES)


def lanes(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, long to short: their order, the first symbols' places, and how many run at each step."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    n = n[order]
    running = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    return order, off[:-1][order], running


def forward(m: Model, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence; all are at least one symbol long."""
    order, first, running = lanes(symbols, off)
    log = np.zeros(len(order))
    state = None
    pending = np.ones(len(order))
    for t, k in enumerate(running.tolist()):
        e = m.emit[symbols[first[:k] + t]]
        state = m.start * e if t == 0 else (state[:k] @ m.move) * e
        scale = state.sum(1)
        state /= scale[:, None]
        pending[:k] *= scale
        if t % 16 == 15:  # before the product of scales gets too small
            log += np.log10(pending)
            pending[:] = 1
    log += np.log10(pending)
    out = np.empty(len(order))
    out[order] = log
    return out


def transfers(m: Model, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(pieces, STATES, STATES): how a piece takes each state of its first symbol to those of its last, up to a factor."""
    out = np.empty((len(start), STATES, STATES))
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), 1024):
        at = order[a : a + 1024]
        n = size[at]
        running = np.searchsorted(-n, -np.arange(n[0]), "left")
        for t, k in enumerate(running.tolist()):
            e = m.emit[symbols[start[at[:k]] + t]]
            if t == 0:
                now = np.eye(STATES) * e[:, None, :]
            else:
                now[:k] = (now[:k].reshape(-1, STATES) @ m.move).reshape(k, STATES, STATES) * e[:, None, :]
                if t % 8 == 0:
                    now[:k] /= now[:k].sum((1, 2), keepdims=True)
        out[at] = now / now.sum((1, 2), keepdims=True)
    return out


def joined(m: Model, symbols: np.ndarray, cut: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """before, after: for each piece the forward state that the piece before it ends with, and the backward values at its own last
    symbol, as of the whole text."""
    before, after = np.zeros((len(first), STATES)), np.ones((len(first), STATES))
    at = np.append(np.flatnonzero(first), len(first))
    count = np.diff(at)
    many = np.flatnonzero(np.repeat(count > 1, count))
    if len(many):
        across = transfers(m, symbols, cut[:-1][many], np.diff(cut)[many])
        _, head, running = lanes(many, np.append(0, np.cumsum(count[count > 1])))
        ends, state = np.empty((len(many), STATES)), None
        for t, k in enumerate(running.tolist()):
            p = head[:k] + t
            if t:
                before[many[p]] = state[:k]
            prior = state[:k] @ m.move if t else np.broadcast_to(m.start, (k, STATES))
            state = np.einsum("ki,kij->kj", prior, across[p])
            state = state / state.sum(1, keepdims=True)
            ends[p] = state
        last = np.ones((len(many), STATES))
        for t in range(len(running) - 1, 0, -1):
            p = head[: running[t]] + t
            back = np.einsum("kij,kj->ki", across[p], last[p]) @ m.move.T
            last[p - 1] = back / back.sum(1, keepdims=True)
        after[many] = last / (ends * last).sum(1, keepdims=True)
    return before, after


def expected(m: Model, symbols: np.ndarray, off: np.ndarray, at_start: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """One expectation step: expected starts, moves and emissions, and log10 of the likelihood; of pieces with what joins them, also
    the moves into them."""
    order, first, running = lanes(symbols, off)
    alpha, scales = [], []
    into = np.zeros((len(order), STATES)) if before is None else before[order]
    prior = np.where(at_start[order][:, None], m.start, into @ m.move)
    state = prior
    for t, k in enumerate(running.tolist()):
        e = m.emit[symbols[first[:k] + t]]
        state = (prior[:k] if t == 0 else state[:k] @ m.move) * e
        scale = state.sum(1, keepdims=True)
        state = state / scale
        alpha.append(state)
        scales.append(scale)
    emits, moves = np.zeros((SYMBOLS, STATES)), np.zeros((STATES, STATES))
    beta = np.ones((len(order), STATES)) if after is None else after[order]
    starts = np.zeros(STATES)
    seen, weights = [], []
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        now = beta[:k]
        s = symbols[first[:k] + t]
        gamma = alpha[t] * now
        seen.append(s)
        weights.append(gamma)
        back = m.emit[s] * now / scales[t]
        if t:
            moves += alpha[t - 1][:k].T @ back
            beta[:k] = back @ m.move.T
        else:
            starts = gamma[at_start[order]].sum(0)
            moves += into[~at_start[order]].T @ back[~at_start[order]]
    if seen:
        s, g = np.concatenate(seen), np.concatenate(weights)
        for j in range(STATES):
            emits[:, j] = np.bincount(s, g[:, j], SYMBOLS)
    return starts, moves * m.move, emits, sum(float(np.log10(s).sum()) for s in scales)


def pieces(off: np.ndarray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts cut into pieces, and which pieces begin a text."""
    n = np.maximum(1, -(-np.diff(off) // most))
    start = np.repeat(off[:-1], n) + most * _base.ranges(np.zeros(len(n), np.int64), n)
    begin = np.zeros(len(start), bool)
    begin[np.cumsum(n) - n] = True
    return np.append(start, off[-1]), begin


def _columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64), off - off[0]


def unigram(table: np.ndarray) -> np.ndarray:
    return (table + 0.5) / (table.sum() + 0.5 * len(table))


def begin(sample: list[np.ndarray], overall: np.ndarray, seed: int = 1, rounds: int = 12) -> Model:
    """States from clusters of a bounded sample of texts: each text goes to the state whose unigrams suit it best."""
    rng = np.random.default_rng(seed)
    own = np.zeros((SYMBOLS, STATES))
    put = rng.integers(0, STATES, len(sample))
    lengths = [len(s) for s in sample]
    s, text = (np.concatenate(sample).astype(np.int64), np.repeat(np.arange(len(sample)), lengths)) if sample else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for _ in range(rounds):
        own = np.stack([np.bincount(s, put[text] == j, SYMBOLS) for j in range(STATES)], axis=1)
        emit = (own + 200 * overall[:, None]) / (own.sum(0) + 200)
        if sample:
            fit = np.stack([np.bincount(text, np.log(emit[s, j]), len(sample)) for j in range(STATES)], axis=1)
            put = fit.argmax(1)
    emit = (own + 200 * overall[:, None]) / (own.sum(0) + 200)
    share = (np.bincount(put, minlength=STATES) + 1) / (len(put) + STATES)
    return Model(share, 0.9 * np.eye(STATES) + 0.1 * share, emit)


def fit(texts: DataFrame, passes: int = PASSES, gain: float = GAIN) -> tuple[Model, list[float]]:
    """Baum-Welch over all training texts: tasks emit the sums of their own rows, Spark adds them up, the driver gets one row for
    each symbol and state. Also the log10 likelihood of a token before each pass."""
    spark = texts.sparkSession
    rows = texts.filter(~held_out()).select("symbols")
    table = np.zeros(SYMBOLS)

    def symbol_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS, np.int64)
        for b in batches:
            total += np.bincount(_columns(b.column(0))[0], minlength=SYMBOLS)
        yield pa.record_batch([pa.array(np.arange(SYMBOLS), pa.int32()), pa.array(total)], names=["k", "n"])

    for r in rows.mapInArrow(symbol_counts, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        table[r["k"]] = r["n"]
    overall = unigram(table)
    sample = _base.smallest(texts.filter(~held_out()).select("rid", "symbols"), START, "rid").toArrow().sort_by("rid").column("symbols")
    m = begin([x for c in sample.chunks for x in np.split(*(lambda s, o: (s, o[1:-1]))(*_columns(c)))] if len(sample) else [], overall)
    trace: list[float] = []
    while len(trace) < passes and (len(trace) < 2 or trace[-1] - trace[-2] >= gain):
        sent = spark.sparkContext.broadcast(m)  # SYMBOLS by STATES

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((SYMBOLS + STATES + 2, STATES))
            for b in batches:
                symbols, off = _columns(b.column(0))
                cut, first = pieces(off)
                before, after = joined(sent.value, symbols, cut, first)
                for part in _base.segments(np.diff(cut), TOKENS):
                    o = cut[part.start : part.stop + 1]
                    starts, moves, emits, log = expected(sent.value, symbols[o[0] : o[-1]], o - o[0], first[part], before[part], after[part])
                    sums[:SYMBOLS] += emits
                    sums[SYMBOLS : SYMBOLS + STATES] += moves
                    sums[-2] += starts
                    sums[-1, 0] += log
            yield pa.record_batch([pa.array(np.arange(len(sums)), pa.int32()), *(pa.array(sums[:, j]) for j in range(STATES))], names=["k", *(f"s{j}" for j in range(STATES))])

        schema = "k int, " + ", ".join(f"s{j} double" for j in range(STATES))
        got = rows.mapInArrow(step, schema).groupBy("k").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(STATES))).collect()
        sums = np.zeros((SYMBOLS + STATES + 2, STATES))
        for r in got:
            sums[r["k"]] = r[1:]
        emits, moves, starts = sums[:SYMBOLS], sums[SYMBOLS : SYMBOLS + STATES], sums[-2]
        trace.append(sums[-1, 0] / max(table.sum(), 1))
        m = Model((starts + 1) / (starts.sum() + STATES), (moves + 0.1) / (moves.sum(1, keepdims=True) + 0.1 * STATES), (emits + PRIOR * overall[:, None]) / (emits.sum(0) + PRIOR))
        sent.unpersist()
    return m, trace


def score(docs: DataFrame, passes: int = PASSES, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Null and empty texts have the end alone. A null id counts as an empty one. Rows with equal texts get equal scores. Without
    training texts nothing is known and the symbols are alike. An empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    _base.prepare(spark)
    training = docs.filter(~held_out())
    table = counts(training)
    v = vocabulary(table, training.count(), hot)
    texts = encoded(docs, spark.sparkContext.broadcast(v))  # its size is fixed by hot
    sent = spark.sparkContext.broadcast(fit(texts, passes)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbols, off = _columns(b.column(0))
            out = [np.zeros(0)]
            for part in _base.segments(np.diff(off), 4 * TOKENS):
                o = off[part.start : part.stop + 1]
                out.append(forward(sent.value, symbols[o[0] : o[-1]], o - o[0]))
            yield pa.record_batch([*b.columns[1:], pa.array(np.concatenate(out))], names=[*b.schema.names[1:], "path"])

    scored = texts.select("symbols", "rid", "doc_id", "n", "known", "base", "inner").mapInArrow(run, "rid long, doc_id long, n long, known long, base double, inner double, path double")
    rare = texts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("w"), F.col("x.times").alias("times"))
    rare = rare.join(table.select("w", "c"), "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("logs"))
    out = scored.join(rare, "rid", "left").withColumns({"more": F.coalesce("more", F.lit(0)), "logs": F.coalesce("logs", F.lit(0.0))})
    each = float(np.log10(v.tokens + 0.5 * (v.words + 1)))
    return out.select(
        "doc_id", held_out().alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.col("more")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n") * each).alias("base_score"), (F.col("path") + F.col("inner") + F.col("logs")).alias("score"),
    )
