"""What the operators of this subpackage share: tables, the shared folder, text keys and word hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that goes to Python: bounds a worker's memory when texts are long.
ARROW_ROWS = 1000
#: A table is broadcast only if it was counted and has at most so many rows of a few numbers each.
BROADCAST_ROWS = 500_000
#: What separates words: ASCII white space, which is also what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Arrow batches small enough for whole long texts; workers find this package wherever they start."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where the session names none and nothing runs elsewhere."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str, items: str | None = None) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage and outlives lost executors. Counts the rows, and the
    items of a column of arrays, as it writes them; rows() and sized() have the counts."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    more = F.sum(F.size(items)) if items else F.max(F.lit(0))
    df.observe(seen, F.count(F.lit(1)).alias("n"), more.alias("m")).write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    got = seen.get
    out._staged_rows, out._staged_items, out._staged_at = int(got["n"]), int(got["m"] or 0), at
    _WRITTEN.append(out)
    return out


#: Staged tables of this driver, in the order of their making.
_WRITTEN: list[DataFrame] = []


def drop(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing reads any more: what followed from them is written itself."""
    for df in tables:
        if at := getattr(df, "_staged_at", None):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gone = {id(df) for df in tables}
    _WRITTEN[:] = [df for df in _WRITTEN if id(df) not in gone]


def written() -> int:
    return len(_WRITTEN)


def drop_since(mark: int) -> None:
    """Deletes what was staged since written() was mark, as what was made from it is itself written."""
    drop(*_WRITTEN[mark:])


def rows(df: DataFrame) -> int:
    n = getattr(df, "_staged_rows", None)
    return df.count() if n is None else n


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of narrow rows: broadcast where its rows, and the items of its arrays if it has such, are within limit; else
    left to a shuffled join."""
    return F.broadcast(df) if rows(df) + getattr(df, "_staged_items", 0) <= limit else df


def smallest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the smallest hashes of their keys. A first cut by the hash leaves some 4 n rows, so that tasks do not
    each send n rows to one; where repeated keys leave it short, all rows are ordered."""
    h = F.xxhash64(*keys)
    total = rows(df)
    if total > 8 * n:
        near = df.filter(h < F.lit(-(1 << 63) + (4 * n << 64) // total))
        df = near if near.limit(n).count() == n else df
    return df.orderBy(h, *keys).limit(n)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_key(text: str = "text") -> list[Column]:
    """128 bits that stand for a text (null as empty), whatever its row's id is."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Modulus of the rolling hash, a prime: modulo a power of two, long strings of two letters collide whatever the base is.
PRIME = (1 << 61) - 1
#: Base of the rolling hash, its inverse, and a value below 2**31 for each byte.
BASE = 0x9E3779B97F4A7C15 % PRIME
UNBASE = pow(BASE, -1, PRIME)
BYTE = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(33)) | np.uint64(1)
#: The same with A-Z as a-z.
BYTE_LOWER = BYTE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Bytes hashed at once; longer texts go in parts.
PART = 1 << 18
_POWERS: list[np.ndarray] = []
_P, _S61, _S31, _S30 = np.uint64(PRIME), np.uint64(61), np.uint64(31), np.uint64(30)
_M31, _M30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it: by halves, as 2**61 is 1."""
    a1, a0, b1, b0 = a >> _S31, a & _M31, b >> _S31, b & _M31
    mid = a1 * b0 + a0 * b1
    return reduced(a1 * b1 * np.uint64(2) + (mid >> _S30) + ((mid & _M30) << _S31) + a0 * b0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i from 0 to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size, both = max(PART + 4096, 1 << int(n).bit_length()), []
        for base in (BASE, UNBASE):
            x = np.ones(1, np.uint64)
            while len(x) < size:
                x = np.concatenate([x, times(x, np.uint64(pow(base, len(x), PRIME)))])
            both.append(x)
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """P with P[i] the hash of data[:i] before it is shifted."""
    up, _ = powers(len(data) + 1)
    up, v = up[: len(data)], values[data]
    mid = (up >> _S31) * v
    x = reduced((mid >> _S30) + ((mid & _M30) << _S31) + (up & _M31) * v)
    high, low = np.cumsum(x >> _S31, dtype=np.uint64), np.cumsum(x & _M31, dtype=np.uint64)
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = reduced((high >> _S30) + ((high & _M30) << _S31) + low)
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], wherever they stand, from its P."""
    _, down = powers(len(p))
    return times(reduced(p[end] + (_P - p[start])), down[start])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if len(off) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[off[0] : off[-1]], off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word never crosses an offset."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True  # a text begins or ends here
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z as a-z, and the n + 1 offsets of each text's words."""
    starts, ends = word_bounds(data, off)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in parts of some PART bytes, always of whole words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PART, "right")))
        lo, hi = starts[at], ends[to - 1]
        p = prefix_hash(data[lo:hi], BYTE_LOWER)
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix(span_hash(p, s, e) ^ ((e - s).astype(np.uint64) << _S61))
        at = to
    return out, np.searchsorted(starts, off)


def segments(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows whose lengths sum to at most most, or single longer rows."""
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield slice(at, len(lengths))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts) + np.repeat(starts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
