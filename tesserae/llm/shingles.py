"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

from .suffix_dedup import _TABLE, _both_powers, _mixed

#: Tab, line feed, vertical tab, form feed and carriage return become spaces; A-Z lower case.
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + bytes(range(0x09, 0x0E)), bytes(range(0x61, 0x7B)) + b" " * 5)
#: Bytes of a word that is hashed by a sum over its bytes.
SUMMED = 64
_ODD = np.random.default_rng(31).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts: list[str | None], fold: bytes = _FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has. What ``fold`` maps to a space ends words."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]).translate(fold), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    inside = data != 32
    edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _both_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:-1], out=sums[1:])
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD[63])
    # the sum over bytes has equal values for some pairs of long regular words, whatever the factors
    for i in np.flatnonzero(ends - starts > SUMMED).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    borders = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, borders))))
    return hashes, counts


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words.

    A text of fewer words is one run; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    out = [np.zeros(0, np.uint64)] * len(texts)
    firsts = np.cumsum(counts) - counts
    long = np.flatnonzero(counts >= words)
    if len(long):
        n = len(hashes) - words + 1
        runs = np.zeros(n, np.uint64)
        for j in range(words):
            runs += hashes[j : j + n] * _ODD[j % 60]
        runs = _mixed(runs + np.uint64(words))
        for i in long.tolist():
            out[i] = np.unique(runs[firsts[i] : firsts[i] + counts[i] - words + 1])
    for i in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        own = hashes[firsts[i] : firsts[i] + counts[i]]
        out[i] = _mixed((own * _ODD[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))
    return out
