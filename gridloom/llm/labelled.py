"""What the text classifiers share: the rows to learn from, and word and structure features of whole texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _base

#: At most so many labelled rows are learned from, those with the smallest hashes of their ids, and so many bytes of their texts.
ROWS, BYTES = 16_000, 128 << 20
FOLDS, HELD_OUT = 5, 0


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """text, label of a bounded sample of the labelled documents that are not held out: rows at most, as many as have size bytes
    together, one for each id (the least text of an id that several rows have; null counts as empty). All are in one partition."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != HELD_OUT))
    known = _base.smallest(known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), rows, "doc_id")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # rows of them at most
    return found.withColumn("_sum", F.sum(F.octet_length("text").cast("long")).over(before)).filter(F.col("_sum") <= size).select("text", "label")


PARAMETERS = "name string, kind string, shape array<int>, data binary"


def parameters(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Arrays of fixed size as rows of PARAMETERS."""
    rows = [(k, v.dtype.str, list(v.shape), np.ascontiguousarray(v).tobytes()) for k, v in arrays.items()]
    kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["name", "kind", "shape", "data"])


def learned(rows: DataFrame, learn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[str, np.ndarray]:
    """The arrays that learn makes of training_rows, which one task has all of: the driver has neither the texts nor what learning
    takes. None, if there are no rows."""
    got = rows.mapInArrow(learn, PARAMETERS).toArrow().to_pylist()
    return {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]).copy() for r in got}


PUNCTUATION = np.array([not (b > 127 or chr(b).isalnum() or b in b" \t\n\r\x0b\x0c") for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
LOWER = np.array([97 <= b <= 122 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
HIGH = np.arange(256) > 127
NEWLINE = np.arange(256) == 10
STATS = 14


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def text_features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: offsets into ids, ids (distinct hashed words, and hashed word shapes) and their counts, and STATS numbers each."""
    n = len(off) - 1
    starts, ends = _base.word_bounds(data, off)
    words, at = _base.words_of(data, off)
    length = ends - starts
    upper, lower, digit, punct = (_sums(t[data]) for t in (UPPER, LOWER, DIGIT, PUNCTUATION))
    inside = lambda c: c[ends] - c[starts]
    caps = (inside(upper) > 1) & (inside(lower) == 0)
    marks = inside(punct)
    tail = np.zeros(len(starts), bool)
    if len(starts):
        tail = (length > 2) & PUNCTUATION[data[ends - 1]] & (data[ends - 1] == data[np.maximum(ends - 2, 0)]) & (marks > 1)
    only = marks == length
    last = data[ends - 1].astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    last[~PUNCTUATION[last.astype(np.int64)]] = 0
    shape = np.minimum(length, 15).astype(np.uint64) // np.uint64(3) + np.uint64(8) * (caps + 2 * tail + 4 * only).astype(np.uint64) + np.uint64(256) * last
    doc = np.repeat(np.arange(n), np.diff(at))
    keys = np.concatenate([words % np.uint64(buckets // 2), np.uint64(buckets // 2) + _base.mix(shape + np.uint64(1)) % np.uint64(buckets // 2)])
    both = np.concatenate([doc, doc]).astype(np.uint64) * np.uint64(buckets) + keys
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(both)))
    owner = (both[first] // np.uint64(buckets)).astype(np.int64)
    ids = (both[first] % np.uint64(buckets)).astype(np.int64)
    where = np.searchsorted(owner, np.arange(n + 1))
    per = lambda c: c[off[1:]] - c[off[:-1]]
    of = lambda x: (c := _sums(x))[at[1:]] - c[at[:-1]]
    size, count_words = np.maximum(np.diff(off), 1), np.maximum(np.diff(at), 1)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[at[:-1][at[:-1] < len(words)]] = False  # a text's first word has none before it
    most = np.zeros(n)
    has = where[1:] > where[:-1]
    if has.any():
        is_word = np.where(ids < buckets // 2, count, 0)
        most[has] = np.maximum.reduceat(is_word, where[:-1][has])
    distinct = _sums(ids < buckets // 2)
    stats = np.stack([
        per(upper) / size, per(lower) / size, per(digit) / size, per(punct) / size, per(_sums(HIGH[data])) / size, per(_sums(NEWLINE[data])) / size,
        of(caps) / count_words, of(tail) / count_words, of(only) / count_words, of(same) / count_words, (distinct[where[1:]] - distinct[where[:-1]]) / count_words,
        most / count_words, of(length) / count_words, np.log1p(np.diff(off)),
    ], axis=1)
    return where, ids, count, stats


def features_by_parts(data: np.ndarray, off: np.ndarray, buckets: int, most: int) -> Iterator[tuple[slice, tuple]]:
    """text_features of runs of texts that have at most so many bytes together; a longer text is cut between words, and its parts'
    features are added up."""
    for part in _base.segments(np.diff(off), most):
        o = off[part.start : part.stop + 1]
        text = data[o[0] : o[-1]]
        yield part, text_features(text, o - o[0], buckets) if len(text) <= most else _long_features(text, buckets, most)


def _long_features(data: np.ndarray, buckets: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = _base.word_bounds(data, np.array([0, len(data)]))
    first = np.searchsorted(starts, np.arange(most, len(data), most))
    first = np.unique(first[first < len(starts)])
    cuts = np.concatenate([[0], starts[first], [len(data)]]).astype(np.int64)
    word = lambda i: _base.words_of(data[starts[i] : ends[i]], np.array([0, ends[i] - starts[i]]))[0][0]
    total, stats = np.zeros(buckets, np.int64), np.zeros(STATS)
    for a, b in zip(cuts[:-1], cuts[1:]):
        _, ids, count, one = text_features(data[a:b], np.array([0, b - a]), buckets)
        total[ids] += count
        words = max(1, int(count[ids < buckets // 2].sum()))
        stats += one[0] * np.array([max(1, b - a)] * 6 + [words] * (STATS - 6))
    ids = np.flatnonzero(total)
    is_word = total[: buckets // 2]
    words = max(1, int(is_word.sum()))
    stats[9] += sum(bool(word(i) == word(i - 1)) for i in first if i)  # equal words on both sides of a cut
    stats[:6] /= len(data)
    stats[6:] /= words
    stats[[10, 11, 13]] = (is_word > 0).sum() / words, is_word.max() / words, np.log1p(len(data))
    return np.array([0, len(ids)]), ids, total[ids], stats[None, :]
