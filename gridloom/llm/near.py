"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has BANDS * ROWS coordinates. In round i each shingle falls into one hashed bin, and a bin that was empty before
keeps the least hash that falls into it; after as many rounds as there are bins, round T + j puts every shingle into bin j, so
that each coordinate fills. Texts that agree on all coordinates of a band are candidates; links are confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base

WIDTH, BANDS, ROWS = 5, 30, 5
#: In hundredths: of the query, and of the pipeline's stage.
LINK, STAGE_LINK = 85, 80
CHUNK = 1 << 20
#: Pairs that may be verified one by one, for each row of the buckets; before that, pivots join what they can.
PAIRS_PER_ROW = 4
#: Links that one task joins into components; more are joined by many.
ALONE = 16_384
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
POLY = np.uint64(0x9DDFEA08EB382D69)


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Owners and hashes of the distinct shingles of texts, by text; fewer words than width are one shingle."""
    words, at = _base.words_of(data, off)
    count = np.diff(at)
    n = len(count)
    hashes = [np.zeros(0, np.uint64)]
    owners = [np.zeros(0, np.int64)]
    for k in range(1, width + 1):
        mine = count == k if k < width else count >= k
        if not mine.any():
            continue
        size = np.where(mine, count - k + 1, 0)
        start = _base.ranges(at[:-1], size)
        h = np.zeros(len(start), np.uint64)
        for j in range(k):
            h = h * POLY + words[start + j]
        hashes.append(_base.mix(h + np.uint64(k)))
        owners.append(np.repeat(np.arange(n), size))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def sketches(owner: np.ndarray, h: np.ndarray, n: int, bins: int = BANDS * ROWS) -> np.ndarray:
    """(n, bins) coordinates of the sets; a row of an empty set keeps NONE."""
    out = np.full(n * bins, NONE, np.uint64)
    for i in range(2 * bins):
        if not len(h):
            break
        x = _base.mix(h ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(1)
        to = owner * bins + ((x % np.uint64(bins)).astype(np.int64) if i < bins else i - bins)
        free = out[to] == NONE
        np.minimum.at(out, to[free], x[free])
        open_ = (out.reshape(n, bins) == NONE).any(axis=1)[owner]
        owner, h = owner[open_], h[open_]
    return out.reshape(n, bins)


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, t = sketch.shape
    by = sketch.reshape(n, t // rows, rows)
    out = np.repeat(np.arange(t // rows, dtype=np.uint64)[None] + np.uint64(1), n, axis=0)
    for j in range(rows):
        out = _base.mix(out * POLY + by[:, :, j])
    return out


def names_of(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[list, np.ndarray]:
    """128 bits for each set, None for an empty one; and the sizes."""
    size = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    out = np.zeros((n, 2), np.uint64)
    if len(h):
        has = size > 0
        for j, seed in enumerate((0x1234567, 0x7654321)):
            out[has, j] = _base.mix(np.add.reduceat(_base.mix(h ^ np.uint64(seed)), first[has]) + size[has].astype(np.uint64))
    raw = out.tobytes()
    return [raw[16 * i : 16 * i + 16] if s else None for i, s in enumerate(size.tolist())], size


def _sets(b: pa.RecordBatch, column: int, width: int):
    """Rows, owners and hashes of a batch's texts, some bytes at a time."""
    data, off = _base.texts_of(b.column(column))
    for part in _base.segments(np.diff(off), CHUNK):
        o = off[part.start : part.stop + 1]
        yield part, *shingles(data[o[0] : o[-1]], o - o[0], width)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, k1, k2 (of the text), n (set size), node (the set), bands, of each row. Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, owner, h in _sets(b, 3, width):
                n = part.stop - part.start
                node, size = names_of(owner, h, n)
                keys = bands(sketches(owner, h, n))
                keys = keys[size > 0]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]), pa.int32()), pa.array(_base.signed(keys.ravel())))
                yield pa.record_batch([*(b.column(i).slice(part.start, n) for i in range(3)), pa.array(size, pa.int64()), pa.array(node, pa.binary()), lists], names=["doc_id", "k1", "k2", "n", "node", "bands"])

    _base.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_base.text_key(), "text")
    return _base.staged(rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, node binary, bands array<long>"), "near-rows")


def full_sets(docs: DataFrame, keys: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, set for the texts with such keys (k1, k2). Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, owner, h in _sets(b, 2, width):
                n = part.stop - part.start
                node, size = names_of(owner, h, n)
                yield pa.record_batch([pa.array(node, pa.binary()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(_base.signed(h)))], names=["node", "set"])

    texts = docs.select(*_base.text_key(), "text").join(_base.sized(keys), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return _base.staged(texts.mapInArrow(run, "node binary, set array<long>"), "near-sets")


def may_link(link: int) -> Column:
    """What two sets have in common is at most what either shares with any other."""
    most = F.least("shared_a", "shared_b")
    return most * 100 >= (F.col("n_a") + F.col("n_b") - most) * link


def verified(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Staged."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return _base.staged(both.withColumn("common", common).filter(F.col("common") * 100 >= union * link).select("a", "b"), "near-links")


def components(links: DataFrame, alone: int = ALONE) -> DataFrame:
    """node, root: the least node that each linked node reaches. links: staged. Up to alone links one task joins them; more are
    joined by alternating large and small stars. Staged."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    if _base.rows(links) <= alone:
        return _base.staged(edges.coalesce(1).mapInArrow(_joined, "node binary, root binary"), "near-roots")
    edges = _base.staged(edges.distinct(), "near-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = _base.staged(large, "near-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = _base.staged(small.filter("u <> v").distinct(), "near-edges")
        # done once each node has one root, and no root has one itself
        twice = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        if twice.unionByName(new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi")).isEmpty():
            return _base.staged(new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "near-roots")
        edges = new


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = sorted(root)
    yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array([find(x) for x in nodes], pa.binary())], names=["node", "root"])


def linkable(sets: DataFrame, link: int) -> DataFrame:
    """node, shared: of the nodes that can be linked at all, how many shingles they share with some other candidate. A link needs
    link hundredths of the union, so of either set, in common. Staged."""
    named = sets.select(F.monotonically_increasing_id().alias("id"), "node", "set")
    tokens = named.select("id", F.explode("set").alias("h"))
    own = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id")).filter("m = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    own = _base.sized(_base.staged(own, "near-own"))
    out = named.select("id", "node", F.size("set").alias("n")).join(own, "id", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
    return _base.staged(out.filter(F.col("shared") * 100 >= F.col("n") * link).select("node", "shared"), "near-linkable")


def all_pairs(now: DataFrame, bands_of: DataFrame, each: tuple[str, ...], link: int) -> DataFrame:
    """The pairs of different components in a bucket, each in the first bucket that it shares."""
    nodes = _base.staged(now.select("node").distinct(), "near-nodes")
    bands_of = _base.staged(bands_of.join(_base.sized(nodes), "node", "left_semi"), "near-bands")
    now = now.join(bands_of, "node")
    left, right = (now.select(F.col("key").alias(f"key_{s}"), F.col("bands").alias(f"bands_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in each)) for s in "ab")
    common = F.filter(F.zip_with("bands_a", "bands_b", lambda a, b: F.when(a == b, a)), lambda v: v.isNotNull())
    pair = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & may_link(link)
    return left.join(right, (F.col("key_a") == F.col("key_b")) & pair & (F.get(common, F.lit(0)) == F.col("key_a")))


def links_of(docs: DataFrame, rows: DataFrame, link: int, width: int = WIDTH, alone: int = ALONE, per_row: int = PAIRS_PER_ROW) -> tuple[DataFrame, DataFrame | None]:
    """classes (node, n, least doc_id, number of rows, the row to keep: of the least doc_id, nulls last, the least text key) and the roots of those that are linked with others.

    Of texts that share a bucket, those with too many shingles of their own can have no link and go, which is exact. If the
    buckets still hold many pairs of different components, a pivot of each bucket is compared with the others, and what it
    links leaves, as long as many are linked; at last all pairs that are left are compared, but for those whose sizes or shared
    shingles rule out a link.
    So no pair that shares a bucket goes unlinked, and a large group of near copies costs some comparisons for each member."""
    classes = _base.staged(rows.filter("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("k1", "k2", "bands")).alias("one"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("keep")), "near-classes")
    member = classes.select(F.explode("one.bands").alias("key"), "node", "n")
    keys = _base.staged(member.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "near-keys")
    shared = _base.staged(member.join(_base.sized(keys), "key", "left_semi"), "near-buckets")
    wanted = classes.join(_base.sized(_base.staged(shared.select("node").distinct(), "near-nodes")), "node", "left_semi").select("one.k1", "one.k2")
    every = full_sets(docs, _base.staged(wanted, "near-wanted"), width)
    # twice, as what only dropped texts had in common with a text is then its own
    some = linkable(every, link)
    first = _base.staged(every.join(_base.sized(some.select("node")), "node", "left_semi"), "near-sets")
    can = linkable(first, link)
    buckets = _base.staged(shared.join(_base.sized(can), "node"), "near-buckets")
    sets = _base.staged(first.join(_base.sized(can.select("node")), "node", "left_semi"), "near-sets")
    _base.drop(keys, shared, every, first)
    links = roots = tested = None
    turn, useful = 0, True
    now = buckets.withColumn("root", F.col("node"))
    each = ("node", "n", "root", "shared")
    while True:
        # of each bucket with several components: how many pairs of different ones
        sizes = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count(F.lit(1)).alias("roots"))
        mixed = _base.staged(sizes.filter("roots > 1").select("key", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs")), "near-mixed")
        total = mixed.agg(F.sum("pairs")).first()[0]
        if not total:
            break
        now = _base.staged(now.join(_base.sized(mixed.select("key")), "key", "left_semi"), "near-open")
        last = total <= per_row * _base.rows(buckets) or not useful
        if last:
            pairs = all_pairs(now, classes.select("node", "one.bands"), each, link)
        else:
            # first texts with few shingles of their own, then others
            own = ((F.col("n") - F.col("shared")) / F.col("n") if turn == 0 else F.lit(0.0)).alias("own")
            first = now.groupBy("key").agg(F.min(F.struct(own, F.xxhash64(F.lit(turn), "node").alias("h"), *each)).alias("p"))
            pairs = now.select("key", *(F.col(c).alias(f"{c}_b") for c in each)).join(first, "key")
            pairs = pairs.select(*(F.col(f"p.{c}").alias(f"{c}_a") for c in each), *(f"{c}_b" for c in each)).filter((F.col("root_a") != F.col("root_b")) & may_link(link))
        pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        pairs = pairs if last else pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = _base.staged(pairs, "near-pairs")
        new = verified(pairs, sets, link)
        if _base.rows(new):
            links = new if links is None else _base.staged(links.unionByName(new), "near-links")
            roots = components(links, alone)
        if last:
            break
        turn, useful = turn + 1, 0 < _base.rows(pairs) <= 5 * _base.rows(new)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if roots is not None:
            now = now.drop("root").join(_base.sized(roots), "node", "left").select("key", "node", "n", "shared", F.coalesce("root", "node").alias("root"))
    _base.drop(sets)
    return classes, roots


def components_of(docs: DataFrame, link: int = LINK, width: int = WIDTH) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id for each row, and whether it is its component's row to keep (or equal to it)."""
    signed = signatures(docs, width)
    classes, roots = links_of(docs, signed, link, width)
    rows = _base.staged(signed.drop("bands"), "near-rows")
    named = classes.select("node", "least", "rows", "keep")
    if roots is not None:
        of = roots.join(named.select("node", "least", "keep"), "node").groupBy("root").agg(F.min("least").alias("component"), F.min("keep").alias("best"))
        linked = _base.staged(roots.join(of, "root").select("node", "component", "best"), "near-components")
        named = named.join(_base.sized(linked), "node", "left")
    else:
        named = named.withColumns({"component": F.lit(None).cast("long"), "best": F.lit(None).cast(classes.schema["keep"].dataType)})
    shared = _base.staged(named.filter("rows > 1 or best is not null").select("node", F.coalesce("component", "least").alias("component"), F.coalesce("best", "keep").alias("keep")), "near-shared")
    _base.drop(signed, classes)
    out = rows.select("doc_id", "k1", "k2", "n", "node").join(_base.sized(shared), "node", "left")
    first = F.col("keep").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("k1") == F.col("keep.k1")) & (F.col("k2") == F.col("keep.k2")))
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, link: int = LINK, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Null texts and texts without words have no shingles and are linked with nothing; fewer words than width are one shingle.
    A null id counts as the largest; rows with one id are rows of their own, all kept if the id is the component's; an empty
    table gives no rows; other columns are not read."""
    out = components_of(docs, link, width)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, link: int = STAGE_LINK, width: int = WIDTH) -> DataFrame:
    """The rows of docs that are kept, one of each group, with all columns. Of equal rows one is kept, of rows without shingles all."""
    of = components_of(docs, link, width)
    of = _base.staged(of, "near-of")
    lose = of.filter(~F.col("first")).select("doc_id", "k1", "k2").distinct()
    name, a, b, x, y = _base.fresh(docs, "id_", "k1_", "k2_", "l1_", "l2_")
    lose = _base.sized(_base.staged(lose, "near-lose")).select(F.col("doc_id").alias(name), F.col("k1").alias(x), F.col("k2").alias(y))
    k1, k2 = _base.text_key()
    keyed = docs.withColumns({a: k1, b: k2})
    out = keyed.join(lose, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_anti")
    again = of.filter("n_shingles > 0").groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2").distinct()
    again = _base.staged(again, "near-again")
    if _base.rows(again):
        some = _base.sized(again.select(F.col("k1").alias(a), F.col("k2").alias(b)))
        out = out.join(some, [a, b], "left_anti").unionByName(out.join(some, [a, b], "left_semi").dropDuplicates(["doc_id", a, b]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
