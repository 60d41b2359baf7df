"""Exact removal of long repeated strings by prefix doubling over the positions that thinning leaves.

Doubling every byte position would move many times the input, so positions that cannot begin a repeated string go first:

1. Of each window of LENGTH bytes, the smallest hash of GRAM bytes. Equal windows choose equal ones, so a window whose choice is
   unique occurs once, and only some 2 in 300 positions are compared.
2. The block of all neighbouring windows that chose the same string. If the whole block occurs elsewhere, so do its windows.
3. Of blocks that occur once, and one of each kind of block that shares their choice: runs of STEP windows. If what all windows
   of a run share occurs once, so do they; if all that they cover occurs elsewhere, so do they.

On what is left, some STEP positions for each place where a repeated string begins or ends, ranks are doubled: a position has the
rank of its first quarter of LENGTH bytes and those at the three offsets that follow. Spark counts and sorts the pairs of ranks at
an offset of a quarter; pairs that occur once go, and the place of a pair in the order is its rank. The pairs of these ranks at
an offset of a half tell which strings of LENGTH bytes occur twice. First ranks, and what rounds 1 to 3 compare, are 61-bit
hashes modulo a prime, so a byte is removed only if all four quarters agree with those of another string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base

LENGTH = 400
#: Of the pipeline's stage: 50 words of four letters and a space have 250 bytes.
STAGE_LENGTH = 240
CHUNK = 1 << 18
#: Windows of a run in the third round.
STEP = 32
#: Bits for places in a part, which is a little longer than CHUNK.
PLACE = np.uint64((1 << 21) - 1)


def fingerprints(p: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of the strings of such lengths at such places, from the prefix sums p of their part."""
    return _base.mix(_base.span_hash(p, start, start + length))


def offsets(length: int) -> tuple[int, tuple[int, int, int, int]]:
    """A quarter of length, rounded up, and where four such strings begin that cover length."""
    q = -(-length // 4)
    return q, (0, q, length - 2 * q, length - q) if length > 2 else (0, 0, 0, length - q)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x)
    rows = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def parts(off: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Runs of texts as (first text, offsets, first byte of each in its text): whole short texts together, long ones in parts that
    overlap by less than a window, so that each window lies in exactly one part."""
    sizes = np.diff(off)
    for s in _base.segments(sizes, CHUNK):
        if s.stop - s.start > 1 or sizes[s.start] <= CHUNK:
            yield s.start, off[s.start : s.stop + 1], 0
        else:
            lo, hi = int(off[s.start]), int(off[s.stop])
            for at in range(lo, hi - length + 1, CHUNK):
                yield s.start, np.array([at, min(hi, at + CHUNK + length - 1)]), at - lo


def blocks(data: np.ndarray, off: np.ndarray, length: int = LENGTH):
    """Of all windows: text, first and last start of the neighbouring windows with the same least rank, that rank, the block's,
    and whether the block has that rank at several places, as it must to repeat itself."""
    out, gram = [], offsets(length)[0]
    for first, o, shift in parts(off, length):
        d = data[o[0] : o[-1]]
        o = o - o[0]
        sizes = np.maximum(np.diff(o) - length + 1, 0)
        at = _base.ranges(o[:-1], sizes)
        if not len(at):
            continue
        p = _base.prefix_hash(d, _base.BYTE)
        rank = fingerprints(p, np.arange(len(d) - gram + 1), gram)
        # the first of the least: its place stands in the low bits
        place = (sliding_min((rank & ~PLACE) | np.arange(len(rank), dtype=np.uint64), length - gram + 1)[at] & PLACE).astype(np.int64)
        least = rank[place]
        text = np.repeat(np.arange(len(sizes)), sizes)
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(at)) - 1
        p0, p1 = at[a], at[b]
        block = _base.mix(fingerprints(p, p0, p1 - p0 + length) + (p1 - p0).astype(np.uint64))
        begin = o[:-1][text[a]]
        out.append((first + text[a], p0 - begin + shift, p1 - begin + shift, place[a] - begin + shift, least[a], block, place[a] != place[b]))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.view(np.uint64), e.view(np.uint64), e.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def window_ranks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(4, windows): first ranks of the quarters of the windows at sorted starts."""
    q, at_quarter = offsets(length)
    out = np.empty((4, len(starts)), np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + CHUNK))
        lo = starts[at]
        p = _base.prefix_hash(data[lo : starts[to - 1] + length], _base.BYTE)
        for k, o in enumerate(at_quarter):
            out[k, at:to] = fingerprints(p, starts[at:to] - lo + o, q)
        at = to
    return out


def merged(spans: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte runs that windows with starts from lo to hi cover, joined where they touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(map(tuple, spans)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def some_of(rows: list[np.ndarray], length: int, data: np.ndarray, off: np.ndarray, owner: np.ndarray):
    """Blocks (first, last, place) in runs of STEP windows, counted back from the place of their rank: text, first and last start,
    rank of what all windows of the full run share, and rank of the bytes that these windows cover."""
    p0, p1, place = (x.astype(np.int64) for x in rows[:3])
    lo, hi = (place - p1) // STEP, (place - p0) // STEP
    each = np.repeat(np.arange(len(p0)), hi - lo + 1)
    j = _base.ranges(lo, hi - lo + 1)
    a, b = np.maximum(p0[each], place[each] - STEP * j - STEP + 1), np.minimum(p1[each], place[each] - STEP * j)
    begin = off[:-1][owner[each]]
    core = begin + place[each] - STEP * j
    shared, cover = np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
    order = np.argsort(begin + a, kind="stable")
    at = 0
    while at < len(order):
        start = begin[order[at]] + a[order[at]]
        to = at + int(np.searchsorted((begin + a)[order[at:]], start + CHUNK))
        o = order[at:to]
        p = _base.prefix_hash(data[start : (begin + b)[o].max() + length], _base.BYTE)
        shared[o] = _base.mix(fingerprints(p, core[o] - start, length - STEP + 1) + j[o].astype(np.uint64))
        cover[o] = _base.mix(fingerprints(p, begin[o] + a[o] - start, b[o] - a[o] + length) + (place[each[o]] - a[o]).astype(np.uint64))
        at = to
    return owner[each], a, b, shared, cover, each


def settle(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One round. found: k1, k2, p0, p1, place, g, b, again, alone. Returns the windows that occur twice as whole blocks (k1, k2,
    p0, p1), and of each rank g that is left undecided one block of each kind b; alone there means that it occurs once. Last the staged tables that both read."""
    shared = _base.staged(found.groupBy("g").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).filter("n > 1").select("g"), f"{name}-ranks")
    left = _base.staged(found.join(_base.sized(shared), "g", "left_semi"), f"{name}-shared")
    kinds = _base.staged(left.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.max("alone").alias("alone"), F.min(F.struct("k1", "k2", "p0", "p1", "place")).alias("one")), f"{name}-kinds")
    twice = _base.staged(kinds.filter("n > 1").select("g", "b"), f"{name}-whole")
    whole = left.filter("alone").join(_base.sized(twice), ["g", "b"], "left_semi").select("k1", "k2", "p0", "p1")
    asks = F.col("alone") & (F.col("n") == 1)
    mixed = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.max(asks).alias("asks"), F.max(F.col("again") & asks).alias("inner"), F.max("again").alias("again"))
    mixed = _base.staged(mixed.filter("inner or kinds > 1 and asks").select("g", F.col("again").alias("direct")), f"{name}-mixed")
    return whole, kinds.join(_base.sized(mixed), "g").select("one.*", asks.alias("alone"), "direct"), [shared, left, kinds, twice, mixed]


def per_text(chosen: DataFrame, name: str) -> DataFrame:
    return _base.staged(chosen.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("p0", "p1", "place", "alone"))).alias("at")), name, "at")


def entries(b: pa.RecordBatch):
    """Of a batch of (k1, k2, text, at): bytes, offsets, the text of each entry, and the entries' columns."""
    data, off = _base.texts_of(b.column(2))
    at = b.column(3)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(at.offsets.to_numpy()))
    cut = slice(at.offsets[0].as_py(), at.offsets[-1].as_py())
    return data, off, owner, [x.to_numpy(zero_copy_only=False)[cut] for x in at.values.flatten()]


def reranked(positions: DataFrame, left: str, right: str, rank: str, name: str) -> DataFrame:
    """left, right, rank of the pairs of ranks that occur more than once: their places in the order of all such pairs. Staged."""
    pairs = positions.groupBy(left, right).agg(F.sum("n").alias("n")).filter("n > 1").select(left, right)
    return _base.staged(pairs.orderBy(left, right).select(left, right, F.monotonically_increasing_id().alias(rank)), name)


def doubled(positions: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """positions: a, b, c, d (ranks of the quarters), n, alone and others, staged, and dropped here. Those that are alone and whose whole
    strings occur more than once; and the staged tables that this reads. Hot pairs are counted before the shuffle, and joined by what has one
    row for each pair."""
    known = positions.filter("a is not null")
    first, second = reranked(known, "a", "b", "r", "repeat-double"), reranked(known, "c", "d", "s", "repeat-double")
    halves = known.join(_base.sized(first), ["a", "b"]).join(_base.sized(second), ["c", "d"]).drop("a", "b", "c", "d")
    halves = _base.staged(halves, "repeat-halves")
    _base.drop(first, second, positions)
    twice = _base.staged(halves.groupBy("r", "s").agg(F.sum("n").alias("n")).filter("n > 1").select("r", "s"), "repeat-twice")
    return halves.filter("alone").join(_base.sized(twice), ["r", "s"], "left_semi"), [halves, twice]


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k1, k2, spans: for each text with repeated windows, the byte runs that they cover. Staged."""
    spark = docs.sparkSession
    _base.prepare(spark)
    keyed = docs.select(*_base.text_key(), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.octet_length("text") >= length)
    block = "k1 long, k2 long, p0 int, p1 int, place int, g long, b long, again boolean, alone boolean"
    names = [x.split()[0] for x in block.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, p0, p1, place, g, cover, again = blocks(*_base.texts_of(b.column(2)), length)
            yield pa.record_batch([b.column(0).take(text), b.column(1).take(text), *(pa.array(x, pa.int32()) for x in (p0, p1, place)), pa.array(_base.signed(g)), pa.array(_base.signed(cover)), pa.array(again), pa.array(np.ones(len(g), bool))], names=names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, owner, rows = entries(b)
            for s in _base.segments(np.diff(rows[:2], axis=0)[0] // STEP + 2, CHUNK // 16):
                text, p0, p1, shared, cover, each = some_of([x[s] for x in rows], length, data, off, owner[s])
                yield pa.record_batch([b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), pa.array(p0, pa.int32()), pa.array(p1, pa.int32()), pa.array(rows[2][s][each], pa.int32()), pa.array(_base.signed(shared)), pa.array(_base.signed(cover)), pa.array(np.zeros(len(p0), bool)), pa.array(rows[3][s][each].astype(bool))], names=names)

    def rank_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, owner, rows = entries(b)
            for s in _base.segments(rows[1].astype(np.int64) - rows[0] + 1, CHUNK):
                p0, n = rows[0][s].astype(np.int64), rows[1][s].astype(np.int64) - rows[0][s] + 1
                text = np.repeat(owner[s], n)
                p, alone = _base.ranges(p0, n), np.repeat(rows[3][s].astype(bool), n)
                by = np.lexsort((p, text))
                text, p, alone = text[by], p[by], alone[by]
                ranks = window_ranks(data, off[:-1][text] + p, length)
                # what a text repeats itself is settled here: runs of such windows, and each string once for the other texts
                order = np.lexsort((*ranks, text))
                by_rank = ranks[:, order]
                new = np.ones(len(p), bool)
                new[1:] = (by_rank[:, 1:] != by_rank[:, :-1]).any(0) | (text[order][1:] != text[order][:-1])
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(p)))
                own = np.empty(len(p), bool)
                own[order] = np.repeat(count > 1, count)
                first = order[head]
                yield rows_of(b, text[first], p[first], p[first], alone[first] & (count == 1), ranks[:, first], np.minimum(count, 2))
                run = np.ones(len(p), bool)
                run[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1]) | (p[1:] != p[:-1] + 1)
                lo = np.flatnonzero(run)
                hi = np.append(lo[1:], len(p)) - 1
                lo, hi = lo[own[lo]], hi[own[lo]]
                yield rows_of(b, text[lo], p[lo], p[hi], np.ones(len(lo), bool), None, np.full(len(lo), 2))

    def rows_of(b: pa.RecordBatch, text, p0, p1, alone, ranks, n) -> pa.RecordBatch:
        four = [pa.nulls(len(text), pa.int64())] * 4 if ranks is None else [pa.array(_base.signed(r)) for r in ranks]
        return pa.record_batch([b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), pa.array(p0, pa.int32()), pa.array(p1, pa.int32()), pa.array(alone), pa.array(n, pa.int32()), *four], names=["k1", "k2", "p0", "p1", "alone", "n", *"abcd"])

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [[{"p0": lo, "p1": hi} for lo, hi in merged(np.array([(s["p0"], s["p1"]) for s in x]), length)] for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(runs, pa.list_(pa.struct([("p0", pa.int32()), ("p1", pa.int32())])))], names=["k1", "k2", "spans"])

    found = _base.staged(keyed.mapInArrow(find, block), "repeat-blocks")
    whole, chosen, used = settle(found, "repeat-1")
    whole, chosen = _base.staged(whole, "repeat-runs"), _base.staged(chosen, "repeat-chosen")
    _base.drop(found, *used)
    # of equal texts one stands for all: a text that occurs twice has no block that occurs once
    texts = keyed.join(_base.sized(_base.staged(chosen.select("k1", "k2").distinct(), "repeat-keys")), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    texts = _base.staged(texts, "repeat-texts")
    parts_of = texts.join(_base.sized(per_text(chosen.filter("not direct"), "repeat-split")), ["k1", "k2"]).select("k1", "k2", "text", "at")
    found = _base.staged(parts_of.mapInArrow(split, block), "repeat-parts")
    whole_2, chosen_2, used = settle(found, "repeat-2")
    whole_2, chosen_2 = _base.staged(whole_2, "repeat-runs"), _base.staged(chosen_2, "repeat-chosen")
    _base.drop(found, *used)
    last = chosen.filter("direct").unionByName(chosen_2).select("k1", "k2", "p0", "p1", "place", "alone")
    last = texts.join(_base.sized(per_text(last, "repeat-last")), ["k1", "k2"]).select("k1", "k2", "text", "at")
    windows = _base.staged(last.mapInArrow(rank_windows, "k1 long, k2 long, p0 int, p1 int, alone boolean, n int, a long, b long, c long, d long"), "repeat-windows")
    _base.drop(chosen, chosen_2, texts)
    own = _base.staged(windows.filter("a is null").select("k1", "k2", "p0", "p1"), "repeat-runs")
    single, used = doubled(windows)
    out = whole.unionByName(whole_2).unionByName(single.select("k1", "k2", "p0", "p1")).unionByName(own)
    out = out.groupBy("k1", "k2").agg(F.collect_list(F.struct("p0", "p1")).alias("spans"))
    out = _base.staged(out.mapInArrow(join_runs, "k1 long, k2 long, spans array<struct<p0:int,p1:int>>"), "repeat-spans", "spans")
    _base.drop(whole, whole_2, own, *used)
    return out


def with_spans(docs: DataFrame, name: str, length: int = LENGTH) -> DataFrame:
    """docs with a column of that name: the byte runs [p0, p1) that are repeated, null if there are none."""
    k1, k2 = _base.text_key()
    a, b = _base.fresh(docs, "k1_", "k2_")
    found = spans(docs, length)
    found = _base.sized(found).withColumnsRenamed({"k1": a, "k2": b, "spans": name})
    return docs.withColumns({a: k1, b: k2}).join(found, [a, b], "left").drop(a, b)


def remaining(text: str | None, runs: list[dict] | None) -> bytes:
    data = (text or "").encode()
    at, out = 0, []
    for r in runs or ():
        out.append(data[at : r["p0"]])
        at = r["p1"]
    return b"".join([*out, data[at:]])


def report(docs: DataFrame, length: int = LENGTH, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; n_bytes is the size before. With text also that
    column, what is left (as in cut, but empty for null).

    Removed is each byte covered by a string of length bytes that also starts elsewhere, in the same row or another. Null counts
    as empty; texts shorter than length keep all; equal rows lose all if long enough; null and repeated ids are rows like
    others; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for whole, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = len((whole or "").encode())
                kept = remaining(whole, runs)
                rows.append((n, n - len(kept), len(runs or ()), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if text else ""))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([b.column(0), *map(pa.array, columns, types)][: len(names)], names=names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * text]
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "spans", length).select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * text)


def cut(docs: DataFrame, length: int = STAGE_LENGTH) -> DataFrame:
    """docs with the repeated bytes gone from text; a character that loses some of its bytes goes too. Null stays null, and a text
    of which nothing is left is empty."""
    (name,) = _base.fresh(docs, "spans_")
    rows = with_spans(docs, name, length).select(*(F.col(f"`{c}`") for c in docs.columns), name)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns
            text, runs = columns[text_at].to_pylist(), columns.pop().to_pylist()
            columns[text_at] = pa.array([t if not r else remaining(t, r).decode(errors="ignore") for t, r in zip(text, runs)], pa.string())
            yield pa.record_batch(columns, names=b.schema.names[:-1])

    return rows.mapInArrow(run, docs.schema)
