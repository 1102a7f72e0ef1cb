"""Exact substring dedup by enhanced suffix arrays over buckets of shared fingerprints."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, keyed, partitions, session

#: Bytes of a fingerprint.
GRAM = 32
#: Windows of a piece at most; longer runs of one fingerprint, as in periodic text, are split.
MOST_WINDOWS = 512
#: Bytes of text that are fingerprinted at once, and of pieces in a suffix array.
TEXT_BYTES, ARRAY_BYTES = 4 << 20, 2 << 20
#: Text for which there is a bucket of fingerprints, so that a bucket is as large at any input.
BUCKET_TEXT = 4 << 20
#: A fingerprint with more different pieces than this is dealt by its windows instead, and one
#: with more in a batch passes the buckets by.
HOT_PIECES, MANY_PIECES = 1 << 15, 16
#: Entries of the list of such fingerprints, which bounds its broadcast to 16 MB.
HOT_KEYS = 1 << 21

_rng = np.random.default_rng(23)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _cache:
        _cache.clear()
        _cache[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    up, down = _cache[size]
    return up[:n], down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n bytes."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    up, down = _both_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:-1], out=sums[1:])
    return _mixed((sums[n:] - sums[:-n]) * down[: len(data) - n + 1])


def window_minima(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each w consecutive values, and its leftmost place."""
    have, out, at = 1, h, np.arange(len(h), dtype=np.int32)

    def joined(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        later = out[b] < out[a]
        return np.where(later, out[b], out[a]), np.where(later, at[b], at[a])

    while have * 2 <= w:
        out, at = joined(slice(0, len(out) - have), slice(have, None))
        have *= 2
    n = len(h) - w + 1
    return joined(slice(0, n), slice(w - have, w - have + n))


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of ``length`` bytes in runs of one fingerprint.

    Of each run its fingerprint, a hash of its bytes, first start, windows, and whether the
    fingerprint has several places in it.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    up, down = _both_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:-1], out=sums[1:])
    # contents by mixed words of 8 bytes: sums over single bytes agree for some regular texts, whatever the factors
    words = np.zeros(len(data) - 6, np.uint64)
    np.cumsum(_mixed(np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))) * up[: len(data) - 7], out=words[1:])
    hashed = lambda a, b: _mixed((words[b - 7] - words[a]) * down[a] + (b - a).astype(np.uint64))
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    least, place = window_minima(grams, length - GRAM + 1)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(least)))
    more = (place[starts] != place[starts + sizes - 1]).astype(np.int64)
    if (sizes > MOST_WINDOWS).any():
        parts = -(-sizes // MOST_WINDOWS)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + sizes, parts)
        starts = np.repeat(starts, parts) + at * MOST_WINDOWS
        sizes = np.minimum(MOST_WINDOWS, ends - starts)
        more = np.repeat(more, parts)
    return least[starts], hashed(starts, starts + sizes + length - 1), starts, sizes, more


def _firsts(h: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of fingerprint and content, oldest first, and whether each is the first of its content."""
    order = np.lexsort((start, doc, content, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (content[order][1:] != content[order][:-1])
    return order, new


def _by_bucket(kind: int, where: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    order = np.argsort(where, kind="stable")
    blank = (b"",) * (4 - len(columns))
    return [(int(where[p[0]]), kind, *(c[p].tobytes() for c in columns), *blank) for p in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(p)]


def _fingerprints(length: int, buckets: int):
    """Runs by the bucket of their fingerprint, as packed arrays of a batch.

    Kind 0: a fingerprint, its content's hash and place. Of equal contents of a batch only
    the oldest is sent; the others are spans that repeat it (kind 1). A fingerprint with many
    contents in the batch sends its places through any bucket (kind 2) and only its number
    of contents to its own (kind 3), so frequent ones don't fill a bucket.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal held, size
            h, content, doc, start, n, more = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            order, new = _firsts(h, content, doc, start)
            again = order[~new]
            order = order[new]
            where = (h % np.uint64(buckets)).astype(np.int64)
            place = start << 16 | n << 1 | more
            border = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            count = np.diff(np.append(border, len(order)))
            many = np.repeat(count > MANY_PIECES, count)
            one, several, marked = order[~many], order[many], border[count > MANY_PIECES]
            rows = _by_bucket(0, where[one], h[one], content[one], doc[one], place[one])
            rows += _by_bucket(1, doc[again] % buckets, doc[again], start[again], (start + n)[again] + length - 1)
            rows += _by_bucket(2, doc[several] % buckets, h[several], doc[several], place[several])
            rows += _by_bucket(3, where[order[marked]], h[order[marked]], count[count > MANY_PIECES])
            return pd.DataFrame(rows, columns=["bucket", "kind", "w", "x", "y", "z"])

        for b in batches:
            for doc, text in zip(b["doc"].tolist(), b["t"].tolist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                for s in range(0, len(data) - length + 1, TEXT_BYTES):  # a giant text in parts that overlap by length - 1
                    h, content, at, n, more = runs(data[s : s + TEXT_BYTES + length - 1], length)
                    held.append((h, content, np.full(len(h), doc, np.int64), at + s, n, more))
                    size += min(len(data) - s, TEXT_BYTES)
                    if size >= 4 * TEXT_BYTES:
                        yield flush()
        if held:
            yield flush()

    return run


#: Kinds of a bucket's results: a span that repeats another, a place to compare, a hot fingerprint.
SPAN, PLACE, HOT = 0, 1, 2


def _met(length: int):
    """Of equal contents all but the oldest are repeats; fingerprints with several contents are to be compared."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda kind, c, t=np.int64: np.frombuffer(b"".join(rows.loc[rows["kind"] == kind, c]), t)
        h, content, doc, place = read(0, "w", np.uint64), read(0, "x", np.uint64), read(0, "y"), read(0, "z")
        marked, marks = read(3, "w", np.uint64), read(3, "x")
        order, new = _firsts(h, content, doc, place)
        again, order = order[~new], order[new]
        every, back = np.unique(np.concatenate((h[order], marked)), return_inverse=True)
        count = np.bincount(back, np.concatenate((np.ones(len(order), np.int64), marks)), len(every)).astype(np.int64)
        needed = order[(count[back[: len(order)]] > 1) | (place[order] & 1 > 0)]
        hot = np.flatnonzero(count > HOT_PIECES)
        start = place >> 16
        out = [
            (SPAN, np.concatenate((doc[again], read(1, "w"))), np.concatenate((start[again], read(1, "x"))),
             np.concatenate((start[again] + (place[again] >> 1 & 0x7FFF) + length - 1, read(1, "y")))),
            (PLACE, np.concatenate((doc[needed], read(2, "x"))), np.concatenate((h[needed].view(np.int64), read(2, "w"))), np.concatenate((place[needed], read(2, "y")))),
            (HOT, np.zeros(len(hot), np.int64), every[hot].view(np.int64), count[hot])]
        return pd.concat([pd.DataFrame({"kind": k, "doc": d, "a": a, "b": b}) for k, d, a, b in out])

    return run


def _pieces(length: int, hot: np.ndarray):
    """The bytes of the places, under their fingerprint; of a hot one the hashes of its windows, without bytes.

    Of equal ones of a batch all but the oldest repeat it, and travel as spans (end given).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key, docs, starts, data, done = [], [], [], [], []
            seen: set = set()
            for i in np.argsort(b["doc"].to_numpy(), kind="stable").tolist():
                doc, text = int(b["doc"].iat[i]), b["t"].iat[i].encode()
                h, place = np.asarray(b["h"].iat[i], np.int64), np.asarray(b["place"].iat[i], np.int64)
                order = np.argsort(place, kind="stable")
                heated = np.isin(h[order], hot)
                for x, y, split in zip(h[order].tolist(), place[order].tolist(), heated.tolist(), strict=True):
                    s, n = y >> 16, y >> 1 & 0x7FFF
                    piece = text[s : s + n + length - 1]
                    each = [(piece, x, s, s + len(piece), piece)]
                    if split:
                        whole = gram_hashes(np.frombuffer(piece, np.uint8), length).view(np.int64).tolist()
                        each = [(w, w, s + j, s + j + length, b"") for j, w in enumerate(whole)]
                    for same, k, first, end, held in each:
                        if same in seen:
                            done.append((doc, first, end))
                        else:
                            seen.add(same)
                            key.append(k)
                            docs.append(doc)
                            starts.append(first)
                            data.append(held)
            yield pd.DataFrame({
                "key": key + [d[0] for d in done], "doc": docs + [d[0] for d in done], "start": starts + [d[1] for d in done],
                "end": [0] * len(key) + [d[2] for d in done], "piece": data + [None] * len(done)})

    return run


def enhanced_suffix_array(text: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes that begin at ``starts`` and their common prefixes with the one before.

    Suffix i ends at ends[i]; comparison goes to ``depth`` bytes or a little more. Ranks
    of 8-byte words are doubled until they cover the depth.
    """
    n = len(text)
    at = np.arange(n)
    word = np.zeros(n, np.uint64)
    for j in range(8):
        inside = at + j < ends
        word |= np.where(inside, text[np.minimum(at + j, n - 1)], 0).astype(np.uint64) << np.uint64(56 - 8 * j)
    ranks, have = [], 8
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64) + 1
    ranks.append((8, rank))
    while have < depth:
        after = np.where(at + have < ends, rank[np.minimum(at + have, n - 1)], 0)
        rank = np.unique(rank << 32 | after, return_inverse=True)[1].astype(np.int64) + 1
        have *= 2
        ranks.append((have, rank))
    sa = starts[np.lexsort((ends[starts] - starts, rank[starts]))]  # of suffixes that differ in NULs at the end alone the shorter one first
    a, b = sa[1:].copy(), sa[:-1].copy()
    common = np.zeros(len(a), np.int64)
    for size, r in reversed(ranks):
        alive = (a + common + size <= ends[a]) & (b + common + size <= ends[b])
        same = alive & (r[np.minimum(a + common, n - 1)] == r[np.minimum(b + common, n - 1)])
        common += np.where(same, size, 0)
    for _ in range(7):
        alive = (a + common < ends[a]) & (b + common < ends[b])
        common += alive & (text[np.minimum(a + common, n - 1)] == text[np.minimum(b + common, n - 1)])
    return sa, np.concatenate(([0], common))


def longest_earlier(age: list[int], common: list[int]) -> list[int]:
    """For each entry of an interval the longest prefix it shares with an older entry of it.

    A stack scan over the interval tree: walking up from an entry, the nearest older one on
    either side in suffix order shares the longest prefix, so one pass each way suffices.
    common[i] is the prefix that entries i - 1 and i share.
    """
    best = [0] * len(age)
    for way in (range(len(age)), range(len(age) - 1, -1, -1)):
        stack: list[list[int]] = []  # [age, common prefix with the entry above it on the stack]
        link = 0
        for k, i in enumerate(way):
            link = 0 if not k else common[i] if way.step > 0 else common[i + 1]
            while stack and stack[-1][0] > age[i]:
                link = min(link, stack.pop()[1])
            if stack:
                best[i] = max(best[i], link)
            stack.append([age[i], link])
    return best


def repeats(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, start, end) that repeat an older occurrence among the pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), sizes)
    ends = (first + sizes)[piece]
    at = np.arange(len(text))
    heads = at[at + length <= ends]
    none = np.zeros(0, np.int64)
    if not len(heads):
        return none, none, none
    # to the end of the longest piece: the test for left extension needs common prefixes that are exact
    sa, common = enhanced_suffix_array(text, ends, heads, int(sizes.max()))
    joined = common >= length
    opening = np.flatnonzero(~joined)  # intervals of suffixes that share at least `length` bytes
    sizes_of = np.diff(np.append(opening, len(sa)))
    left = np.where(sa == first[piece[sa]], -1 - piece[sa], text[np.maximum(sa - 1, 0)].astype(np.int64))
    low, high = np.minimum.reduceat(left, opening), np.maximum.reduceat(left, opening)
    # an interval whose occurrences all extend to the left by one byte is part of a longer repeat
    maximal = np.flatnonzero((sizes_of > 1) & (low != high))
    own_doc, own_start = docs[piece[sa]], starts[piece[sa]] + sa - first[piece[sa]]
    out_at, out_len = [], []
    pairs = opening[maximal[sizes_of[maximal] == 2]]
    if len(pairs):
        newer = (own_doc[pairs + 1] > own_doc[pairs]) | ((own_doc[pairs + 1] == own_doc[pairs]) & (own_start[pairs + 1] > own_start[pairs]))
        out_at.append(np.where(newer, pairs + 1, pairs))
        out_len.append(common[pairs + 1])
    for k in maximal[sizes_of[maximal] > 2].tolist():
        i, n = int(opening[k]), int(sizes_of[k])
        order = np.lexsort((own_start[i : i + n], own_doc[i : i + n]))
        age = np.empty(n, np.int64)
        age[order] = np.arange(n)
        inner = common[i : i + n]
        if (inner[1:] == inner[1]).all():
            best = np.where(age > 0, inner[1], 0)
        else:
            best = np.array(longest_earlier(age.tolist(), inner.tolist()))
        hit = np.flatnonzero(best >= length)
        out_at.append(i + hit)
        out_len.append(best[hit])
    if not out_at:
        return none, none, none
    where, size = np.concatenate(out_at), np.concatenate(out_len)
    return own_doc[where], own_start[where], own_start[where] + size


def interval_tree(common: list[int], length: int) -> tuple[list[list[int]], list[int]]:
    """The intervals of suffixes that share at least ``length`` bytes: [prefix, first, last, parent], and the deepest one of each suffix (-1: none).

    A stack scan over the common prefixes of neighbours; an interval is closed where a shorter prefix follows, and
    its parent is what is then open.
    """
    nodes: list[list[int]] = []
    deepest = [-1] * len(common)
    stack: list[int] = []
    for i in range(1, len(common) + 1):
        now, first, last = (common[i] if i < len(common) else 0), i - 1, -1
        while stack and nodes[stack[-1]][0] > now:
            last = stack.pop()
            nodes[last][2] = i - 1
            first = nodes[last][1]
            if stack and nodes[stack[-1]][0] >= now:
                nodes[last][3], last = stack[-1], -1
        if now >= length and (not stack or nodes[stack[-1]][0] < now):
            nodes.append([now, first, -1, -1])
            stack.append(len(nodes) - 1)
        if last >= 0 and stack:
            nodes[last][3] = stack[-1]
        if i < len(common) and stack:
            deepest[i] = stack[-1]
            if deepest[i - 1] < 0 or nodes[deepest[i - 1]][0] < now:
                deepest[i - 1] = stack[-1]
    return nodes, deepest


def maximal_repeats(pieces: list[bytes], copies: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Maximal repeats of ``length`` bytes or more among distinct pieces: (group, parent, size, piece, offset).

    A walk over the interval tree of an enhanced suffix array keeps the intervals whose occurrences can't all be extended
    to the left. Each occurrence stands once, in its deepest group; a group's occurrences are its own and those of the groups
    below it. A piece that has several copies itself is a group of its whole length.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), sizes)
    ends = (first + sizes)[piece]
    at = np.arange(len(text))
    sa, common = enhanced_suffix_array(text, ends, at[at + length <= ends], int(sizes.max()))
    nodes, deepest = interval_tree(common.tolist(), length)
    left = np.where(sa == first[piece[sa]], -1 - piece[sa], text[np.maximum(sa - 1, 0)].astype(np.int64))
    changes = np.cumsum(np.concatenate(([0], left[1:] != left[:-1])))
    diverse = [changes[j] > changes[i] for _, i, j, _ in nodes]

    def kept(k: int) -> int:
        while k >= 0 and not diverse[k]:
            k = nodes[k][3]
        return k

    out, whole = [], len(nodes)
    for x, k in enumerate(deepest):
        own, offset = int(piece[sa[x]]), int(sa[x] - first[piece[sa[x]]])
        k = kept(k)
        if offset == 0 and copies[own] > 1 and (k < 0 or nodes[k][0] < sizes[own]):
            out.append((whole + own, k, int(sizes[own]), own, 0))
        elif k >= 0:
            out.append((k, kept(nodes[k][3]), nodes[k][0], own, offset))
    used = {r[0] for r in out}
    for k in {r[1] for r in out} - used:  # groups that have occurrences below them only
        while k >= 0 and k not in used:
            used.add(k)
            i = int(sa[nodes[k][1]])
            up = kept(nodes[k][3])
            out.append((k, up, nodes[k][0], -1, i))
            k = up
    return out


def _places(length: int):
    """All runs of windows of one fingerprint; the bytes of each content go with its first place in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: set[int] = set()
            for doc, text in zip(b["doc"].tolist(), b["t"].tolist(), strict=True):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                for s in range(0, len(data) - length + 1, TEXT_BYTES):
                    h, content, at, n, more = runs(data[s : s + TEXT_BYTES + length - 1], length)
                    fresh = [c not in seen and not seen.add(c) for c in content.tolist()]
                    yield pd.DataFrame({
                        "key": h.view(np.int64), "content": content.view(np.int64), "doc": doc, "start": at + s, "more": more > 0,
                        "piece": [raw[s + a : s + a + k + length - 1] if f else None for a, k, f in zip(at.tolist(), n.tolist(), fresh, strict=True)]})

    return run


def repeat_groups(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeat groups with all their occurrences: key, group, parent, size, id, start.

    The strings of a group are equal over ``size`` bytes and can't all be extended to the left. Within a fingerprint
    groups are nodes of an interval tree: an occurrence stands in its deepest group, and belongs to the ones above it
    (``parent``, -1 at the top) too, so the table grows with the text and not with its repeats' squares. A passage that spans
    several fingerprints has a group under each. Copies of a run are joined back after the arrays, which see each
    content once. A group that has occurrences below it only has a row with null id and start. Null texts and
    texts shorter than ``length`` have no groups; rows of one id are documents of their own.
    """
    session(docs)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.octet_length("t") >= length)
    rows = cut(text.withColumn("doc", F.monotonically_increasing_id()), "repeat-docs")
    places = cut(rows.select("doc", "t").mapInPandas(_places(length), "key bigint, content bigint, doc bigint, start bigint, more boolean, piece binary"), "repeat-places")
    contents = places.groupBy("key", "content").agg(F.max("piece").alias("piece"), F.count("*").alias("copies"), F.bool_or("more").alias("more"))
    some = contents.groupBy("key").agg(F.sum("copies").alias("n"), F.bool_or("more").alias("any")).where("n > 1 or any").select("key")  # also what recurs within a run

    def found(p: pd.DataFrame) -> pd.DataFrame:
        got = maximal_repeats(p["piece"].tolist(), p["copies"].tolist(), length)
        content = p["content"].to_numpy()
        out = pd.DataFrame(got, columns=["group", "parent", "size", "own", "offset"]).astype("int64")
        return out.drop(columns="own").assign(key=p["key"].iloc[0], content=np.where(out["own"] >= 0, content[np.maximum(out["own"], 0)], 0), real=out["own"] >= 0)

    groups = cut(contents.join(some, "key").groupBy("key").applyInPandas(found, "key bigint, group bigint, parent bigint, size bigint, content bigint, offset bigint, real boolean"), "repeat-groups")
    every = groups.where("real").join(places.select("key", "content", "doc", "start"), ["key", "content"]).join(rows.select("doc", "id"), "doc")
    upper = groups.where("not real").select("key", "group", "parent", "size", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), F.lit(None).cast("long").alias("start"))
    return every.select("key", "group", "parent", "size", "id", (F.col("start") + F.col("offset")).alias("start")).unionByName(upper).withColumnRenamed("id", id_col)


def united(spans: pd.DataFrame) -> pd.DataFrame:
    """Spans of each document united where they touch or overlap."""
    if spans.empty:
        return spans
    doc, start, end = (spans[c].to_numpy(np.int64) for c in ("doc", "start", "end"))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    lift = np.cumsum(fresh) * (end.max() + 1)  # keeps the running end of one document from the next
    reach = np.maximum.accumulate(end + lift) - lift
    first = np.flatnonzero(np.concatenate(([True], fresh[1:] | (start[1:] > reach[:-1]))))
    return pd.DataFrame({"doc": doc[first], "start": start[first], "end": reach[np.append(first[1:], len(doc)) - 1]})


def _spans(length: int):
    """Rows of a partition come sorted by key, then age; keys are taken together up to some size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, starts, data, size, last, window = [], [], [], 0, None, None
        for b in batches:
            ready = b["piece"].isna()
            out = [b.loc[ready, ["doc", "start", "end"]]]
            windows = []
            for k, d, s, p in b.loc[~ready, ["key", "doc", "start", "piece"]].itertuples(index=False):
                if not len(p):  # a window of a hot fingerprint: the key is its hash
                    if window == k:
                        windows.append((d, s, s + length))
                    window = k
                    continue
                if k != last and size >= ARRAY_BYTES:
                    out.append(pd.DataFrame(dict(zip(("doc", "start", "end"), repeats(data, np.array(docs), np.array(starts), length), strict=True))))
                    docs, starts, data, size = [], [], [], 0
                last, size = k, size + len(p)
                docs.append(d)
                starts.append(s)
                data.append(p)
            out.append(pd.DataFrame(windows, columns=["doc", "start", "end"]))
            yield united(pd.concat(out))
        if data:
            yield united(pd.DataFrame(dict(zip(("doc", "start", "end"), repeats(data, np.array(docs), np.array(starts), length), strict=True))))

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans united where they touch or overlap."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _of_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def repeated_spans(text: DataFrame, length: int) -> DataFrame:
    """Byte spans of texts (doc, t, other columns) that repeat an earlier start: (doc, spans), unmerged.

    Every window of ``length`` bytes belongs to its least fingerprint (of 32 bytes), so
    equal windows share one. Runs of windows with one fingerprint are told apart by a hash of
    their bytes: equal ones repeat the oldest, and a fingerprint with one content is
    done. The bytes of the others' oldest meet by fingerprint, and an enhanced
    suffix array over them gives maximal repeats with all occurrences. A fingerprint with
    over 32,768 contents is dealt by hashes of whole windows instead.
    """
    spark = session(text)
    size = text.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(64, 2 * partitions(spark), math.ceil(size / BUCKET_TEXT))
    found = cut(
        text.where(F.octet_length("t") >= length).select("doc", "t")
        .mapInPandas(_fingerprints(length, buckets), "bucket int, kind int, w binary, x binary, y binary, z binary")
        .groupBy("bucket").applyInPandas(_met(length), "kind int, doc bigint, a bigint, b bigint"), "suffix-places")
    # at most HOT_KEYS fingerprints of 8 bytes
    hot = found.where(F.col("kind") == HOT).orderBy(F.desc("b"), "a").limit(HOT_KEYS).select("a").toPandas()["a"].to_numpy(np.int64)
    places = found.where(F.col("kind") == PLACE).groupBy("doc").agg(F.collect_list("a").alias("h"), F.collect_list("b").alias("place"))
    # all columns of the text stay, so that its exchange is the one that the result's join uses again
    pieces = text.join(places, "doc").mapInPandas(_pieces(length, hot), "key bigint, doc bigint, start bigint, end bigint, piece binary")
    compared = pieces.repartition("key").sortWithinPartitions("key", "doc", "start").mapInPandas(_spans(length), "doc bigint, start bigint, end bigint")
    same = found.where(F.col("kind") == SPAN).select("doc", F.col("a").alias("start"), F.col("b").alias("end"))
    return _of_document(same.unionByName(compared))


def _results(text: bool, carry: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, t, spans in zip(b["doc"].tolist(), b["t"].tolist(), b["spans"].tolist(), strict=True):
                data = (t or "").encode()
                cuts = merged(*np.array([(s["start"], s["end"]) for s in spans], np.int64).T) if spans is not None and len(spans) else []
                if text:  # only whole characters go
                    cuts = [(s, e) for s, e in ((_whole(data, s), _whole(data, e, back=True)) for s, e in cuts) if s < e]
                kept = b"".join(data[i:j] for i, j in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(data)], strict=True))
                out.append((doc, len(data), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(kept).hexdigest(), kept.decode() if text else None))
            yield pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).assign(**{f"c{i}": b[f"c{i}"].array for i in range(carry)})

    return run


def _whole(data: bytes, at: int, back: bool = False) -> int:
    """The nearest border of a character at or after a place, or at or before it."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += -1 if back else 1
    return at


def dedup(docs: DataFrame, length: int = 100, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier means a smaller document id, or the same document and an earlier start. Returns
    id, n_bytes, n_removed, n_spans, kept_sha256 and the columns of ``carry``; with ``keep_text``
    also the kept text, from which only whole characters are removed. A null text is an empty one; texts
    shorter than ``length`` lose nothing; an empty table gives none. Rows of one id are documents of their
    own, in the order of their texts; rows of null ids too, and come last; other columns are ignored.
    """
    extra = {f"c{i}": c for i, c in enumerate(carry)}
    own = f"c{len(carry)}"  # the id travels as one more carried column
    text = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), *(F.col(c).alias(k) for k, c in extra.items()))).withColumnRenamed("id", own)
    kinds = dict(text.dtypes)
    schema = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string" + "".join(f", {k} {kinds[k]}" for k in [*extra, own])
    out = text.join(repeated_spans(text, length), "doc", "left").mapInPandas(_results(keep_text, len(carry) + 1), schema)
    out = out.withColumn("doc", F.nullif(own, F.lit(NO_ID))).drop(own)
    return (out if keep_text else out.drop("kept")).withColumnsRenamed({"doc": id_col, "kept": text_col} | extra)
