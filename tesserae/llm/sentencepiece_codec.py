"""SentencePiece encoding and decoding by a max-plus parallel scan over chunks of giant documents.

A unigram model takes the segmentation of the best sum of scores. Each chunk of a giant document yields a matrix of
best scores from every boundary state (how far the last piece of the chunk before reaches in) to every other; the
matrices combine associatively, which gives the best scores ahead of each chunk, and each chunk is then traced
back alone for every state at its end; a walk over these few states picks the path.

The vocabulary here is of a BPE model, whose ids follow the order of merges and no sum of scores. It serves as a unigram model by a
fixed rule (``unigram``): a piece's score falls with the logarithm of its rank. Nothing is trained.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session
from .tokens import vocabulary

#: Characters of a chunk, and chunks whose matrices are multiplied by one task.
CHUNK, BLOCK = 50_000, 64
#: Characters of text whose ids a task holds as Python numbers.
SLICE = 1 << 20
SPACE = "▁"
UNIGRAM, BPE, NORMAL, BYTE = 1, 2, 1, 6
#: Scores are whole numbers, -SCALE * ln(rank + 2) rounded, so that sums of 32-bit floats are exact.
SCALE = 4
NONE = -np.inf


def unigram(path: str) -> bytes:
    """A model file as a unigram model: a BPE model's pieces keep their ids and get scores by rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type == BPE:
        model.trainer_spec.model_type = UNIGRAM
        for rank, piece in enumerate(x for x in model.pieces if x.type == NORMAL):
            piece.score = -round(SCALE * math.log(rank + 2))
    return model.SerializeToString()


class Codec:
    """A unigram model with its pieces, or a model as its file has it."""

    def __init__(self, path: str, as_unigram: bool = True) -> None:
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = unigram(path) if as_unigram else f.read()
        self.sp = sp.SentencePieceProcessor(model_proto=raw)
        model = pb.ModelProto()
        model.ParseFromString(raw)
        self.scans = model.trainer_spec.model_type == UNIGRAM
        normal = [x for x in model.pieces if x.type == NORMAL]
        self.pieces = {x.piece: (i, x.score) for i, x in enumerate(model.pieces) if x.type == NORMAL}
        self.reach = max((len(x.piece) for x in normal), default=1)
        self.unknown = min((x.score for x in normal), default=0.0) - 10.0
        self.bytes = {int(x.piece[3:5], 16): i for i, x in enumerate(model.pieces) if x.type == BYTE} if model.trainer_spec.byte_fallback else {}
        self.scores = np.array([x.score for x in model.pieces])
        self.scores[self.sp.unk_id()] = self.unknown
        for b, i in self.bytes.items():  # an unknown character counts once, by its first byte
            self.scores[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown
        self.crossed = any(SPACE in x.piece.lstrip(SPACE) for x in normal)
        spec = model.normalizer_spec
        self.plain = spec.name == "identity" and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces

    def ids_of(self, char: str) -> list[int]:
        """The ids of a character without a piece."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.sp.unk_id()]

    def arcs(self, text: str, at: int) -> Iterator[tuple[int, int, float]]:
        """Pieces that start at a place: (end, id, score); -1 for a character without one."""
        single = False
        for size in range(1, min(self.reach, len(text) - at) + 1):
            got = self.pieces.get(text[at : at + size])
            if got:
                single = single or size == 1
                yield at + size, got[0], got[1]
        if not single:
            yield at + 1, -1, self.unknown


def forward(c: Codec, text: str, start: dict[int, float], border: int) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
    """Best scores of the places reached by pieces that begin before ``border``, and the piece that ends there; of equal ones the longest."""
    best, back = dict(start), {}
    for at in range(min(start, default=border), border):
        if at in best:
            for end, i, score in c.arcs(text, at):
                if end not in best or best[at] + score > best[end]:
                    best[end], back[end] = best[at] + score, (at, i)
    return best, back


def traced(c: Codec, text: str, back: dict[int, tuple[int, int]], end: int) -> tuple[int, list[int]]:
    """The place where the path to ``end`` begins, and its ids."""
    out: list[list[int]] = []
    while end in back:
        at, i = back[end]
        out.append([i] if i >= 0 else c.ids_of(text[at]))
        end = at
    return end, [x for ids in reversed(out) for x in ids]


def anchors(c: Codec, text: str, n: int) -> tuple[int, int] | None:
    """The first and the last place that no piece crosses, beyond the reach of what enters: before a space that follows no space."""
    if c.crossed:
        return None
    first = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(text, c.reach - 1, n + 1)
    last = text.rfind(SPACE, 0, n + 1)
    while last > 0 and text[last - 1] == SPACE:
        last -= 1
    return (first.start(), last) if first and last >= first.start() else None


def middle(c: Codec, text: str, a: int, b: int) -> list[int]:
    """The ids between two anchors, by the library, which sets a space before a text itself."""
    return c.sp.encode(text[a + 1 : b]) if b > a else []


def matrix(c: Codec, text: str, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """A chunk's matrix, from a state at its beginning to one at its end, and the ids between its anchors if it has some.

    ``text`` is the chunk's n characters and what a piece may reach beyond.
    """
    r = c.reach
    out = np.full((r, r), NONE)
    ends = range(n, min(n + r, len(text) + 1))
    found = anchors(c, text, n)
    if found is None:
        for h in range(min(r, n + 1)):
            best, _ = forward(c, text, {h: 0.0}, n)
            for e in ends:
                out[h, e - n] = best.get(e, NONE)
        return out, None
    a, b = found
    ahead = {a: 0.0}  # best scores from each place to the first anchor
    for at in range(a - 1, -1, -1):
        ahead[at] = max((score + ahead[e] for e, _, score in c.arcs(text[:a], at) if e in ahead), default=NONE)
    ids = np.array(middle(c, text, a, b), np.int64)
    best, _ = forward(c, text, {b: 0.0}, n)
    head, tail = np.array([ahead.get(h, NONE) for h in range(r)]), np.array([best.get(n + k, NONE) for k in range(r)])
    out[:] = head[:, None] + c.scores[ids].sum() + tail[None, :]
    return out, ids


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def paths(c: Codec, text: str, n: int, ahead: np.ndarray, ids: np.ndarray | None) -> tuple[list[int], list[int], list[list[int]]]:
    """For each state at a chunk's end the state at its beginning, the ids that all have, and those after them.

    ``ahead`` holds the best scores of the states at its beginning.
    """
    r = c.reach
    start = {h: x for h, x in enumerate(ahead.tolist()) if x > NONE}
    if ids is None:
        best, back = forward(c, text, start, n)
        got = [traced(c, text, back, n + k) if n + k in best else (0, []) for k in range(r)]
        return [g[0] for g in got], [], [g[1] for g in got]
    a, b = anchors(c, text, n)
    entry, head = traced(c, text, forward(c, text, start, a)[1], a)
    best, back = forward(c, text, {b: 0.0}, n)
    return [entry] * r, [*head, *ids.tolist()], [traced(c, text, back, n + k)[1] if n + k in best else [] for k in range(r)]


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def pieces_of(c: Codec, text: str, chunk: int) -> list[tuple[str, int]]:
    """Chunks of an escaped text, each with what a piece may reach beyond it, and their own lengths."""
    own, size = escaped(text), max(chunk, 2 * c.reach)
    return [(own[a : a + size + c.reach], min(size, len(own) - a)) for a in range(0, len(own), size)]


def scanned(c: Codec, text: str, chunk: int = CHUNK) -> list[int]:
    """The ids of a text by the scan, all in one place; unknown characters in a row are one id where the model has no bytes."""
    ahead, got, out, state = np.r_[0.0, np.full(c.reach - 1, NONE)], [], [], 0
    for t, n in pieces_of(c, text, chunk):
        m, ids = matrix(c, t, n)
        got.append(paths(c, t, n, ahead, ids))
        ahead = (ahead[:, None] + m).max(axis=0)
    for entry, head, tails in reversed(got):
        out.append([*head, *tails[state]])
        state = entry[state]
    return _merged(c, np.array([x for ids in reversed(out) for x in ids], "<u4")).tolist()


def _merged(c: Codec, ids: np.ndarray) -> np.ndarray:
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == c.sp.unk_id()) & (ids[:-1] == c.sp.unk_id())
    return ids if c.bytes else ids[~again]


_codecs: dict[tuple, Codec] = {}


def codec(path: str, as_unigram: bool = True) -> Codec:
    if (path, as_unigram) not in _codecs:
        _codecs[path, as_unigram] = Codec(path, as_unigram)
    return _codecs[path, as_unigram]


def _cut(path: str, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            for uid, t in zip(b["uid"].tolist(), b["t"].tolist(), strict=True):
                parts = pieces_of(c, t, chunk)
                yield pd.DataFrame({"uid": uid, "k": range(len(parts)), "block": [k // BLOCK for k in range(len(parts))], "t": [x for x, _ in parts], "n": [n for _, n in parts]})

    return run


def _matrices(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            got = [matrix(c, t, n) for t, n in zip(b["t"].tolist(), b["n"].tolist(), strict=True)]
            yield b[["uid", "k", "block"]].assign(m=[m.tobytes() for m, _ in got], ids=[None if i is None else i.tobytes() for _, i in got])

    return run


def _read(m: bytes) -> np.ndarray:
    x = np.frombuffer(m)
    return x.reshape(math.isqrt(len(x)), -1)


def _product(rows: pd.DataFrame) -> pd.DataFrame:
    """The product of a block's matrices."""
    whole = None
    for m in rows.sort_values("k")["m"]:
        whole = _read(m) if whole is None else combine(whole, _read(m))
    return rows[["uid", "block"]].iloc[:1].assign(m=whole.tobytes())


def _ahead(order: str):
    """Best scores before each matrix of a run, from those before the first (``first``, or the state 0 alone)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        size = len(_read(rows["m"].iat[0]))
        now = np.frombuffer(rows["first"].iat[0]) if "first" in rows else np.r_[0.0, np.full(size - 1, NONE)]
        out = []
        for m in rows["m"]:
            out.append(now.tobytes())
            now = (now[:, None] + _read(m)).max(axis=0)
        return rows[["uid", order]].assign(ahead=out)

    return run


def _paths(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        raw = lambda ids: np.array(ids, "<u4").tobytes()
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                entry, head, tails = paths(c, r.t, r.n, np.frombuffer(r.ahead), None if r.ids is None else np.frombuffer(r.ids, np.int64))
                rows.append((r.uid, r.k, entry, raw(head), [raw(x) for x in tails]))
            yield pd.DataFrame(rows, columns=["uid", "k", "entry", "head", "tails"])

    return run


def _walked(path: str):
    """From a document's end back over the states between its chunks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        for entry, head, tails in rows.sort_values("k", ascending=False)[["entry", "head", "tails"]].itertuples(index=False):
            out.append(head + tails[state])
            state = int(entry[state])
        ids = np.frombuffer(b"".join(reversed(out)), "<u4")
        return pd.DataFrame({"uid": rows["uid"].iloc[:1], "ids": [_merged(codec(path), ids).view("<i4")], "n_chunks": [len(rows)]})

    return run


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded text: ids as Python numbers are many times as large as their text."""
    sizes = np.cumsum(pc.utf8_length(b.column("t")).to_numpy(zero_copy_only=False)) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), b.num_rows]
    return (b.slice(i, j - i) for i, j in zip(edges, edges[1:], strict=False) if j > i)


def _described(path: str, as_unigram: bool, names: list[str]):
    """Ids of the texts that have none yet, by the library, and the texts that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, as_unigram)
        for b in (x for whole in batches for x in _slices(whole)):
            texts, known = b.column("t").to_pylist(), b.column("ids")
            fresh = iter(c.sp.encode([t for t, i in zip(texts, known.is_null().to_pylist(), strict=True) if i], num_threads=1))
            ids = [x.values.to_pylist() if x.is_valid else next(fresh) for x in known]
            sizes = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.array(i, "<u4") for i in ids])
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(sizes, sizes[1:], strict=False)]
            decoded = c.sp.decode(ids)
            yield pa.RecordBatch.from_arrays([
                b.column("doc"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(np.diff(sizes), pa.int64()),
                pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view("<i4"))), pa.array(crc, pa.int64()), b.column("n_chunks"),
                pa.array(decoded, pa.string()), pa.array([d == t for d, t in zip(decoded, texts, strict=True)], pa.bool_())], names)

    return run


COLUMNS = ["doc", "n_bytes", "n_tokens", "ids", "ids_crc32", "n_chunks", "decoded", "round_trip"]


def encode_documents(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, as_unigram: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode them again: id, n_bytes, n_tokens, ids, ids_crc32, n_chunks, decoded, round_trip.

    decoded is the text of the ids; ids_crc32 is over little-endian unsigned 32-bit ids; round_trip says whether decoding
    gives the text back (not so for a text that holds the space mark itself). Ids are those of the model as a
    unigram model (``unigram``); with ``as_unigram`` False a BPE model's own, by the library without a scan. Texts of over
    ``chunk`` characters are split and go through the scan, with or without spaces in them; shorter ones are one chunk, for
    which the library is the scan. A null text is an empty one, with no ids; ids may be of any
    type, null or repeated, and each row stays one; an empty table gives none; other columns are ignored.
    """
    session(docs)
    path = model or vocabulary("piece_bpe_32k.model")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc {kind}, n_bytes bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint, n_chunks int, decoded string, round_trip boolean"
    text = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    c = Codec(path, as_unigram)
    none = text.withColumns({"ids": F.lit(None).cast("array<int>"), "n_chunks": F.lit(1)})
    described = lambda d: d.select("doc", "t", "ids", "n_chunks").mapInArrow(_described(path, as_unigram, COLUMNS), schema).withColumnRenamed("doc", id_col)
    if not (c.scans and c.plain):
        return described(none)
    long = F.char_length("t") > chunk
    giant = cut(text.where(long).withColumn("uid", F.monotonically_increasing_id()), "sp-giant")
    chunks = cut(giant.select("uid", "t").mapInPandas(_cut(path, chunk), "uid bigint, k int, block int, t string, n int").repartition("uid", "k"), "sp-chunks")
    matrices = cut(chunks.mapInPandas(_matrices(path), "uid bigint, k int, block int, m binary, ids binary"), "sp-matrices")
    blocks = matrices.groupBy("uid", "block").applyInPandas(_product, "uid bigint, block int, m binary")
    firsts = blocks.groupBy("uid").applyInPandas(_ahead("block"), "uid bigint, block int, ahead binary").withColumnRenamed("ahead", "first")
    ahead = matrices.join(firsts, ["uid", "block"]).groupBy("uid", "block").applyInPandas(_ahead("k"), "uid bigint, k int, ahead binary")
    known = matrices.select("uid", "k", "ids").join(ahead, ["uid", "k"])
    found = chunks.select("uid", "k", "t", "n").join(known, ["uid", "k"]).mapInPandas(_paths(path), "uid bigint, k int, entry array<int>, head binary, tails array<binary>")
    whole = found.groupBy("uid").applyInPandas(_walked(path), "uid bigint, ids array<int>, n_chunks int")
    return described(none.where(~long)).unionByName(described(giant.join(whole, "uid")))


def _decoded(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        size = c.sp.get_piece_size()

        def text(ids) -> str | None:
            if ids is None:
                return None
            own = [-1 if i is None or i != i else int(i) for i in ids]
            return c.sp.decode(own) if all(0 <= i < size for i in own) else None

        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "text": [text(x) for x in b["ids"].tolist()]})

    return run


def decode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of stored ids: id, text.

    No ids are an empty text. Null ids, and ids of which one is null or not in the model, have a
    null text; repeated rows keep a row each; an empty table gives none; other columns are ignored.
    """
    session(docs)
    path = model or vocabulary("piece_bpe_32k.model")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return rows.mapInPandas(_decoded(path), f"doc {kind}, text string").withColumnRenamed("doc", id_col)
