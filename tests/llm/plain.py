"""Brute-force versions of the operators, and small documents with awkward cases."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, doc string, t string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int, str | None]]:
    """Random prose with exact and near copies, shared passages and lines, periodic junk, nulls and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "an", "é", "ou", "st", "ß", "in", "re"]) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, lines = prose(60), [prose(6) for _ in range(4)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "ONE", "two words", "Two  words", "a b c", "junk " * 80, "x" * 500, passage]
    base = prose(120)
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            w = base.split(" ")
            for _ in range(r.choice([1, 2, 3, 5, 8])):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(prose(r.randint(1, 30)) + " " + passage + " " + prose(r.randint(1, 30)))
        elif kind == 3:
            at = r.randrange(2)
            texts.append("\n".join([prose(5), *lines[at : at + 3], "", prose(4)]))
        elif kind == 4:
            texts.append((prose(2) + " ") * r.randint(10, 60))
        else:
            texts.append("\n".join(prose(r.randint(3, 12)) for _ in range(r.randint(1, 12))))
    texts.append(texts[-1])
    return list(enumerate(texts))


def frame(spark, rows, partitions: int = 3):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}" if i is not None else None, len(t or ""), "s", "x", "d", "t") for i, t in rows], SCHEMA).repartition(partitions)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    parent = {i: i for i in ids}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows, k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(list(sets), links).items()}


def suffix_rows(rows, length: int) -> dict[int, tuple]:
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def without_lines(rows, run: int) -> dict[int, tuple]:
    seen: set[tuple] = set()
    out = {}
    for i, t in sorted(rows):
        if t is None:
            out[i] = None, 0, 0
            continue
        lines = t.split("\n")
        full = [j for j, x in enumerate(lines) if x.strip(" \t\r")]
        bare = [lines[j].strip(" \t\r") for j in full]
        gone: set[int] = set()
        for s in range(len(bare) - run + 1):
            key = tuple(bare[s : s + run])
            if key in seen:
                gone.update(full[s : s + run])
            seen.add(key)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone), len(lines), len(gone)
    return out
