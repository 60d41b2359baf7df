"""Sharding by Karmarkar-Karp differencing: partial partitions of indivisible groups, combined oppositely ordered."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _base

SHARDS = 24
#: Groups that one task differences, and partial partitions that one task combines.
GROUPS, FAN_IN = 20_000, 512
#: Rows of one numbering task.
ROWS = 20_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sums: one partial partition in each row, its parts from large to small. Combines the two with the largest spread until
    one is left. Returns for each row the final part that each of its parts went to, and the final sums."""
    n, k = sums.shape
    if not n:
        return np.zeros((0, k), np.int64), np.zeros(k, sums.dtype)
    node = np.zeros((2 * n - 1, k), sums.dtype)
    node[:n] = sums
    children, order = np.zeros((n - 1, 2), np.int64), np.zeros((n - 1, k), np.int64)
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    for m in range(n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = node[a] + node[b][::-1]
        o = np.argsort(-both, kind="stable")
        node[n + m] = s = both[o]
        children[m], order[m] = (a, b), o
        heapq.heappush(heap, (-int(s[0] - s[-1]), n + m))
    goes = np.zeros((2 * n - 1, k), np.int64)
    goes[-1] = np.arange(k)
    for m in range(n - 2, -1, -1):
        (a, b), o, g = children[m], order[m], goes[n + m]
        goes[a][o] = g
        goes[b][k - 1 - o] = g
    return goes[:n], node[-1]


def _groups(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "h"], ascending=[False, True], kind="stable")
        sums = np.zeros((len(pdf), k), np.int64)
        sums[:, 0] = pdf["bytes"]
        goes, _ = difference(sums)
        return pd.DataFrame({"h": pdf["h"], "node": pdf["node"], "part": goes[:, 0].astype(np.int32), "bytes": pdf["bytes"]})

    return run


def _partials(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(pdf["node"].unique())
        sums = np.zeros((len(nodes), k), np.int64)
        sums[np.searchsorted(nodes, pdf["node"]), pdf["part"]] = pdf["bytes"]
        by = np.argsort(-sums, axis=1, kind="stable")
        goes, _ = difference(np.take_along_axis(sums, by, 1))
        to = np.zeros_like(goes)
        np.put_along_axis(to, by, goes, 1)
        return pd.DataFrame({"node": np.repeat(nodes, k), "part": np.tile(np.arange(k, dtype=np.int32), len(nodes)), "up_node": np.repeat(nodes // FAN_IN, k), "up_part": to.ravel().astype(np.int32), "bytes": sums.ravel()})

    return run


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """groups: h long, bytes long, one row each. Returns h, shard. Groups are differenced in tasks of some GROUPS by their
    hash; what they come to is combined by the same rule, FAN_IN at a time, until one partition is left."""
    _base.prepare(groups.sparkSession)
    n = groups.count()
    nodes = max(1, -(-n // GROUPS))
    placed = _base.staged(
        groups.withColumn("node", F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(nodes))).groupBy("node").applyInPandas(_groups(shards), "h long, node long, part int, bytes long"), "shard-groups")
    sums = placed.groupBy("node", "part").agg(F.sum("bytes").alias("bytes"))
    out = placed.select("h", "node", "part")
    while True:
        up = _base.staged(sums.withColumn("up", F.floor(F.col("node") / FAN_IN)).groupBy("up").applyInPandas(_partials(shards), "node long, part int, up_node long, up_part int, bytes long"), "shard-parts")
        out = out.join(up.select("node", "part", "up_node", "up_part"), ["node", "part"]).select("h", F.col("up_node").alias("node"), F.col("up_part").alias("part"))
        nodes = -(-nodes // FAN_IN)
        if nodes <= 1:
            return out.select("h", F.col("part").alias("shard"))
        sums = up.groupBy(F.col("up_node").alias("node"), F.col("up_part").alias("part")).agg(F.sum("bytes").alias("bytes"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs; rows with equal texts share a shard.

    Size is the text's UTF-8 bytes and 8 more. A null text counts as an empty one; null and repeated ids are rows like others;
    an empty table gives no rows; other columns are not read. Slots count each shard's rows from 0: a row's place within its
    (shard, chunk of ids), after the rows of earlier chunks, so that no task numbers a whole shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _base.staged(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "shard-rows")
    groups = _base.staged(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-sums")
    chunks = max(1, -(-rows.count() // (ROWS * shards)))
    chunk = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id"), F.col("size")), F.lit(chunks))
    placed = _base.staged(rows.join(assign(groups, shards), "h").select("doc_id", "size", "text_crc32", "shard", chunk.alias("chunk")), "shard-placed")
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("place", F.row_number().over(within).cast("long") - 1)
    return numbered.join(counts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot"))


def shard_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of shard() with the law that holds: sizes of shards are near equal."""
    none = F.lit(None).cast("int")
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard"))
