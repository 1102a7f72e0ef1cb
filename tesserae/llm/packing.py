"""Packing of documents into token sequences, balanced by attention cost."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session
from .tokens import ByteBpe, loaded

#: Tokens that are packed together; a task holds no more ids than these and one document's.
GROUP_TOKENS = 4_000_000
SCHEMA = "doc_id {id}, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"
NAMES = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]


def cost(length: int, limit: int) -> float:
    """Linear work plus quadratic attention of a piece, in units of its length."""
    return length + length * length / limit


class Rooms:
    """Sequences by the room they have: a heap of (cost, sequence) for each room, and a tree of the least cost above each."""

    def __init__(self, limit: int) -> None:
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(limit + 1)]
        self.base = 1 << limit.bit_length()
        self.none = (math.inf, -1, -1)
        self.least = [self.none] * (2 * self.base)

    def _changed(self, room: int) -> None:
        heap, at = self.heaps[room], room + self.base
        self.least[at] = (*heap[0], room) if heap else self.none
        while at > 1:
            at >>= 1
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def add(self, room: int, load: float, i: int) -> None:
        heapq.heappush(self.heaps[room], (load, i))
        if self.heaps[room][0] == (load, i):
            self._changed(room)

    def take(self, n: int) -> tuple[float, int]:
        """The sequence of least cost that has room for n tokens; if there is none, that of least cost at all."""
        at = n + self.base
        found = self.least[at]
        while at > 1:
            if at % 2 == 0:
                found = min(found, self.least[at + 1])
            at >>= 1
        if found is self.none:
            found = self.least[1]
        load, i, room = found
        heapq.heappop(self.heaps[room])
        self._changed(room)
        return load, i


def plan(lengths: list[int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of given lengths.

    Whole sequences are cut from long documents. What remains goes, in descending order of
    cost, to the sequence of least cost that has room; where none has, the document is cut. The capacities add up to the tokens there are: all sequences are
    full, but the last tokens get sequences whose lengths are powers of two.
    """
    pieces, rest, seq = [], [], 0
    for doc, n in enumerate(lengths):
        for at in range(0, n - n % limit, limit):
            pieces.append((doc, at, limit, seq, 0))
            seq += 1
        if n % limit:
            rest.append((n % limit, doc, n - n % limit))
    total = sum(r[0] for r in rest)
    sizes = [limit] * (total // limit) + [1 << b for b in range(limit.bit_length()) if total % limit >> b & 1]
    filled = [0] * len(sizes)
    open_ = Rooms(limit)
    for i, size in enumerate(sizes):
        open_.add(size, 0.0, i)
    rest.sort(key=lambda r: (-cost(r[0], limit), r[1]))
    for n, doc, at in rest:
        while n:
            load, i = open_.take(n)
            take = min(n, sizes[i] - filled[i])
            pieces.append((doc, at, take, seq + i, filled[i]))
            filled[i], n, at = filled[i] + take, n - take, at + take
            if filled[i] < sizes[i]:
                open_.add(sizes[i] - filled[i], load + cost(take, limit), i)
    return pieces


def _packed(limit: int, path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(ByteBpe, path)
        first = TaskContext.get().partitionId() << 40
        group, held, kind = [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal first, group, held
            lengths = [len(ids) for _, ids in group]
            pieces = sorted(plan(lengths, limit))
            own = [group[d][1][at : at + n] for d, at, n, *_ in pieces]
            sizes = dict.fromkeys((p[3] for p in pieces), 0)
            for p in pieces:
                sizes[p[3]] += p[2]
            long = lambda x: pa.array(x, pa.int64())
            size = [p[2] for p in pieces]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(np.concatenate(own).view("<i4")))
            out = pa.RecordBatch.from_arrays([
                pa.array([group[d][0] for d, *_ in pieces], kind), long([p[1] for p in pieces]), long(size), ids,
                long([zlib.crc32(x) for x in own]), long([lengths[p[0]] for p in pieces]), long([first + p[3] for p in pieces]),
                long([p[4] for p in pieces]), long([sizes[p[3]] for p in pieces])], NAMES)
            first, group, held = first + len(sizes), [], 0
            return out

        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(codec.ids(text or ""), np.array([end], "<u4"))
                group.append((doc, ids))
                held += len(ids)
                if held >= GROUP_TOKENS:
                    yield flush()
        if group:
            yield flush()

    return run


def pack(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``limit`` tokens; one row per piece.

    A row has the piece's own ids (and a CRC of them as little-endian unsigned 32-bit
    integers); the pieces of a sequence in order of offset are the sequence.
    Each input partition packs its own documents in groups of about 4 million tokens, so
    nothing is shuffled and a task's memory is bounded; a group ends with at most 11 short
    sequences, whose lengths are powers of two. A null or empty text is the end token
    alone. Repeated rows are packed each; null ids are kept; an empty table gives none.
    """
    session(docs)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if id_col != "doc_id":
        return picked.mapInArrow(_packed(limit, tokenizer, end), SCHEMA.format(id=kind)).withColumnRenamed("doc_id", id_col)
    return picked.mapInArrow(_packed(limit, tokenizer, end), SCHEMA.format(id=kind))
