"""Tokenizers behind a cache of pieces: each distinct piece of text is encoded once.

A text is cut where no token can cross; the pieces that the cache lacks are joined to one
text, encoded by the library in one call, and dealt back by the byte length of each token.
Whatever the cutting rule isn't proven for goes to the library whole.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np

#: Entries of a worker's cache; pieces beyond are encoded again when they recur.
CACHE_SIZE = 300_000


def vocabulary(name: str) -> str:
    """The path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """Cached encoding; subclasses say how to cut and how to encode."""

    def __init__(self) -> None:
        self.cache: dict[str, object] = {}

    def cut(self, text: str) -> list[str] | None:
        """The pieces of a text, or None if it must be encoded whole."""
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text by the library."""
        raise NotImplementedError

    def many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the joined pieces, bytes of each id, bytes of each piece."""
        raise NotImplementedError

    def keep(self, ids: np.ndarray) -> object:
        """What the cache holds for a piece."""
        raise NotImplementedError

    def fill(self, pieces: list[str]) -> None:
        """Make sure that all the pieces are in the cache."""
        missing = list(set(pieces) - self.cache.keys())
        if not missing:
            return
        if len(self.cache) + len(missing) > CACHE_SIZE:
            self.cache.clear()
            missing = list(set(pieces))
        ids, id_bytes, piece_bytes = self.many(missing)
        ends, wanted = np.cumsum(id_bytes), np.cumsum(piece_bytes)
        at = np.searchsorted(ends, wanted)
        if len(missing) and (at >= len(ends)).any() or not np.array_equal(ends[at], wanted):
            for p in missing:  # a token crossed a border, so the joined text is of no use
                self.cache[p] = self.keep(self.many([p])[0])
            return
        starts = np.concatenate(([0], at[:-1] + 1))
        for p, i, j in zip(missing, starts.tolist(), (at + 1).tolist(), strict=True):
            self.cache[p] = self.keep(ids[i:j])

    def batches(self, texts: list[str]) -> list[list[str] | None]:
        """Cut texts and fill the cache for them."""
        cuts = [self.cut(t) for t in texts]
        every: set[str] = set()
        for c in cuts:
            if c:
                every.update(c)
        self.fill(list(every))
        return cuts


class ByteBpe:
    """byte_bpe_50k: ids as the tokenizers library gives them.

    The rank file holds the same vocabulary and merges, and its library is three times as
    fast; texts with characters not compared in the tests go to the tokenizers library.
    """

    unsafe = re.compile(r"<\|endoftext\|>|[^\n\t\r\x20-\x7e¡-ɏ‐-‧€]")

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or vocabulary("byte_bpe_50k.json")
        self.full = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.unsafe.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


class WordBpe(Pieces):
    """word_bpe_49k: lower case, white space dropped; the cache holds token counts."""

    #: No normal form changes these characters, and lower case maps each by itself.
    unsafe = re.compile(r"<\|(?:start|end)oftext\|>|[^\t\n\r\x20-\x7e¡-įı-ɏ‐-‧€]")

    def __init__(self, path: str | None = None) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path or vocabulary("word_bpe_49k.json"))
        chars = _byte_chars()
        vocab = self.full.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = sum(c in chars for c in token.removesuffix("</w>"))

    def cut(self, text: str) -> list[str] | None:
        return None if self.unsafe.search(text) else text.lower().split()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.int64)

    def many(self, pieces):
        ids = np.array(self.full.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.int64)
        return ids, self.lengths[ids], np.array([len(p.encode()) for p in pieces], np.int64)

    def keep(self, ids: np.ndarray) -> int:
        return len(ids)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        get = self.cache.__getitem__
        cuts = self.batches(texts)
        return [len(self.whole(t)) if c is None else sum(map(get, c)) for t, c in zip(texts, cuts, strict=True)]


_loaded: dict[tuple, object] = {}


def loaded(kind: type, path: str | None = None):
    """The worker's own instance, which outlives a task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
