"""A stream of the objects of a pack that is still being received."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import git

SCHEMA = "hash string, kind string, size bigint, data binary, at bigint"
#: Bytes of a partition, about; and bytes that are inflated at once.
SPLIT, STEP = 4 << 20, 1 << 16
#: Bytes before the first object.
FIRST = 12


def header(f: BinaryIO, at: int) -> tuple[int, int | bytes | None, int] | None:
    """Kind, base (a place, or a hash) and start of the data of the object at a place; None if it isn't all there."""
    f.seek(at)
    head, n = f.read(64), 1
    try:
        while head[n - 1] >= 0x80:
            n += 1
        code, base = head[0] >> 4 & 7, None
        if code == git.OFFSET_DELTA:
            back, n = head[n] & 0x7F, n + 1
            while head[n - 1] >= 0x80:
                back, n = (back + 1 << 7) | head[n] & 0x7F, n + 1
            base = at - back
        elif code == git.NAMED_DELTA:
            base, n = head[n : n + 20], n + 20
    except IndexError:
        return None
    return (code, base, at + n) if n <= len(head) else None


def inflated(f: BinaryIO, at: int, keep: bool = True) -> tuple[bytes, int] | None:
    """The data that begins at a place, if it is kept, and the place after it; None if it isn't all there."""
    f.seek(at)
    stream, out = zlib.decompressobj(), []
    while not stream.eof:
        piece = f.read(STEP)
        if not piece:
            return None
        got = stream.decompress(piece)
        at += len(piece) - len(stream.unused_data)
        if keep:
            out.append(got)
    return b"".join(out), at


def object_at(f: BinaryIO, at: int) -> tuple[str, bytes]:
    """Kind and data of the object at a place; a delta's bases come from before it in the pack."""
    deltas = []
    while True:
        code, base, start = header(f, at)
        data, _ = inflated(f, start)
        if base is None:
            kind = git.KINDS[code]
            for delta in reversed(deltas):
                data = git._patched(data, delta)
            return kind, data
        if isinstance(base, bytes):
            raise ValueError("a delta names its base by hash; ask for packs with offsets")
        deltas.append(data)
        at = base


class PackStream(DataSourceStreamReader):
    """Offsets are places in the file after whole objects: nothing is read twice, nothing half."""

    def __init__(self, path: str) -> None:
        self.path, self.at, self.seen, self.cuts = path, FIRST, 0, []

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": FIRST}

    def latestOffset(self) -> dict:  # noqa: N802
        """The place after the last whole object; the driver looks for ends only and keeps no data."""
        if not os.path.exists(self.path) or os.path.getsize(self.path) < FIRST:
            return {"at": FIRST}
        with open(self.path, "rb") as f:
            magic, version, count = struct.unpack(">4sII", f.read(FIRST))
            if magic != b"PACK" or version not in (2, 3):
                raise ValueError("no pack of version 2 or 3")
            while self.seen < count:
                head = header(f, self.at)
                end = head and inflated(f, head[2], keep=False)
                if not end:
                    break
                self.seen, self.at = self.seen + 1, end[1]
                if self.at - (self.cuts[-1] if self.cuts else FIRST) >= SPLIT:
                    self.cuts.append(self.at)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        places = [start["at"], *(c for c in self.cuts if start["at"] < c < end["at"]), end["at"]]
        return [InputPartition((a, b)) for a, b in zip(places, places[1:], strict=False) if a < b]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, end = partition.value
        with open(self.path, "rb") as f:
            while at < end:
                kind, data = object_at(f, at)
                yield git._named(kind, data), kind, len(data), data, at
                at = inflated(f, header(f, at)[2], keep=False)[1]

    def commit(self, end: dict) -> None:
        pass


class GrowingPack(DataSource):
    """``spark.readStream.format("growing_pack").load(path)``: objects of a pack as soon as they are whole, each once.

    The path is one that all executors can open. A restart goes on after the last object that its checkpoint knows. Packs have
    deltas by offset, as a fetch gives them by default.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_pack"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PackStream:  # noqa: N802
        return PackStream(self.options["path"])
