"""Hierarchical multi-length packing: context-size tiers, whole documents first, gaps of long windows from shorter tiers."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm import _base

#: Context sizes, long to short. All are powers of two, so a full sequence of any tier has no padding.
TIERS = (2048, 1024, 512, 256)
#: Ids of documents that are packed together, and ids of a step group.
BLOCK, STEP = 1 << 21, 16 * 2048
#: The id after each document.
END = 1
#: Characters that the tokenizer gets at once.
PIECE = 1 << 16

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType()),
])


@lru_cache(maxsize=2)
def encoder(ranks: str):
    """The byte-level vocabulary of a rank file, with its special token read as such: the ids of the tokenizer of the same name."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": 50256})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def parts(text: str, most: int = PIECE) -> Iterator[str]:
    """text in parts of some most characters, cut before a single space between two other characters, where a token ends anyway."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(" ", at + 1, at + most)
        while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:  # none: look on
            cut = text.find(" ", at + most)
            while cut > 0 and (text[cut - 1].isspace() or cut + 1 >= len(text) or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut <= at:
                break
        yield text[at:cut]
        at = cut
    yield text[at:]


def ids_of(text: str | None, ranks: str) -> np.ndarray:
    e = encoder(ranks)
    ids = [e.encode_to_numpy(p, allowed_special="all") for p in parts(text)] if text else []
    return np.concatenate([*ids, np.array([END])]).astype("<u4")


class Packer:
    """Packs the documents of one task, block by block; what does not fill a window waits for the next block.

    Pieces wait in stacks by length; a bit mask of the lengths at hand finds the longest that fits a gap."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> None:
        self.tiers, self.step = tiers, step
        self.stacks: dict[int, list] = {}
        self.mask = 0
        self.next = 0
        self.done: list[tuple[int, list]] = []  # (tokens, pieces) of each sequence

    def push(self, piece: tuple) -> None:
        """piece: (document, start, length)."""
        self.stacks.setdefault(piece[2], []).append(piece)
        self.mask |= 1 << piece[2]

    def pop(self, length: int) -> tuple:
        stack = self.stacks[length]
        piece = stack.pop()
        if not stack:
            self.mask ^= 1 << length
        return piece

    def longest(self, most: int) -> int:
        """The largest length at hand that is at most most, or 0."""
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.mask & ((1 << (most + 1)) - 1) else 0

    def add(self, doc: object, n: int) -> None:
        """Routes a document: whole windows of the longest tier, and the rest to the tier that holds it."""
        top = self.tiers[0]
        for start in range(0, n - n % top, top):
            self.done.append((top, [(doc, start, top)]))
        if n % top:
            self.push((doc, n - n % top, n % top))

    def shortest(self, beyond: int) -> int:
        rest = self.mask >> (beyond + 1)
        return (rest & -rest).bit_length() + beyond if rest else 0

    def fill(self) -> None:
        """Full windows, long tiers first: each opens with the longest piece of its tier; gaps take whole pieces of shorter tiers,
        best fit, and last a cut of the shortest piece that is too long. A window that can't be filled goes back."""
        for i, tier in enumerate(self.tiers):
            under = self.tiers[i + 1] if i + 1 < len(self.tiers) else 0
            while (n := self.longest(tier)) > under:
                pieces, gap = [self.pop(n)], tier - n
                while gap:
                    if k := self.longest(gap):
                        pieces.append(self.pop(k))
                        gap -= k
                    elif k := self.shortest(gap):
                        doc, start, _ = self.pop(k)
                        pieces.append((doc, start, gap))
                        self.push((doc, start + gap, k - gap))
                        gap = 0
                    else:
                        break
                if gap:
                    return self.back(pieces)
                self.done.append((tier, pieces))

    def back(self, pieces: list) -> None:
        for p in pieces:
            self.push(p)

    def finish(self) -> None:
        """The last pieces, less than a window together, in sequences whose sizes are powers of two."""
        rest = [self.pop(n) for n in sorted(self.stacks, reverse=True) for _ in range(len(self.stacks[n]))]
        total = sum(p[2] for p in rest)
        while total:
            room = min(self.tiers[0], 1 << (total.bit_length() - 1))
            total -= room
            pieces, size = [], room
            while room:
                doc, start, n = rest.pop(0)
                pieces.append((doc, start, min(n, room)))
                if n > room:
                    rest.insert(0, (doc, start + room, n - room))
                room -= pieces[-1][2]
            self.done.append((size, pieces))

    def take(self) -> list[tuple[int, int, list]]:
        """(sequence, step group, pieces) of what is full: each tier's sequences go, long first, to the step group with the fewest ids."""
        out, self.done = self.done, []
        out.sort(key=lambda s: -s[0])
        groups = [(0, g) for g in range(max(1, -(-sum(s[0] for s in out) // self.step)))]
        rows = []
        for size, pieces in out:
            load, g = heapq.heappop(groups)
            heapq.heappush(groups, (load + size, g))
            rows.append((self.next, self.next_group + g, pieces))
            self.next += 1
        self.next_group += len(groups)
        return rows

    next_group = 0


def pack(docs: DataFrame, ranks: str | None = None, tiers: tuple[int, ...] = TIERS, block: int = BLOCK) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Each task packs its own documents, so no row is shuffled; sequence and group numbers begin with the task's. Only the ids of
    one block and of what waits are in memory. Null and empty texts have the end id alone; null and repeated ids are documents
    like others; a text of any length is cut into windows; an empty table gives no rows; other columns are not read."""
    ranks = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        packer = Packer(tiers)
        held: dict[int, tuple] = {}  # (doc_id, ids) by a number of the task's own
        seen = size = 0

        def out() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in SCHEMA]
            for seq, group, pieces in packer.take():
                offset, tier = 0, min(t for t in (*tiers[::-1], 1 << 31) if t >= sum(p[2] for p in pieces))
                for doc, start, n in pieces:
                    doc_id, ids = held[doc]
                    for c, x in zip(cols, (doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + seq, offset, tier, base + group)):
                        c.append(x)
                    offset += n
            waiting = {p[0] for stack in packer.stacks.values() for p in stack}
            for d in held.keys() - waiting:
                del held[d]
            return pa.record_batch([pa.array(c, pa.int32() if f.name == "tier" else pa.int64()) for c, f in zip(cols, SCHEMA)], names=SCHEMA.names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py(), ranks)
                held[seen] = (doc_id, ids)
                packer.add(seen, len(ids))
                seen, size = seen + 1, size + len(ids)
                if size >= block:
                    packer.fill()
                    yield out()
                    size = 0
        packer.fill()
        packer.finish()
        yield out()

    _base.prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
