"""Self join of documents by the Jaccard similarity of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, connected_components, cut, keyed, partitions, session
from .shingles import shingle_sets
from .suffix_dedup import _mixed

#: Signatures of a bucket of the index, about.
SIGNATURES = 1 << 20
#: Counters of the frequency sketch; it is broadcast, at 4 bytes each.
COUNTERS = 1 << 20
#: A token is frequent if its counter exceeds the mean by this and so many times the mean's square root.
FREQUENT, TIMES_ROOT = 32, 4
#: Tokens of a combination.
COMBINE = 2
#: Members of a posting list that are compared in all pairs; others first with one of them.
ALL_PAIRS = 8
#: Bits of a set's parity bitmap at least; a bitmap has two to four bits for each token.
BITS = 1024
#: Words of bitmaps that are compared at once.
WORDS = 1 << 21
#: Text that is indexed at once, in characters, and members of a block.
TEXT, BLOCK = 8 << 20, 1024
_ODDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    for b in batches:
        size = np.cumsum([len(t or "") for t in b["t"]]) // TEXT
        for _, part in b.groupby(size):
            yield part["doc"].to_numpy(np.int64), part["known"].to_numpy(bool), shingle_sets(part["t"].tolist(), words)


def _bitmap(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens falls on it. Halves combined by XOR are the bitmap of half the length."""
    bits = max(BITS, 2 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _described(words: int):
    """Each set's size, digest and bitmap, and the partition's frequency sketch in 16 slices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.int64)
        for docs, known, sets in _sets(batches, words):
            every = np.concatenate([*sets, np.zeros(0, np.uint64)])
            counts += np.bincount((every % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            yield pd.DataFrame({
                "part": -1, "doc": docs, "known": known, "n": [len(s) for s in sets],
                "d1": [int(_mixed(s).sum().view(np.int64)) for s in sets],
                "d2": [int(np.bitwise_xor.reduce(_mixed(s + _ODDS[0]), initial=np.uint64(0)).view(np.int64)) for s in sets],
                "bits": [_bitmap(s) for s in sets]})
        own = counts.astype(np.min_scalar_type(int(counts.max())))  # most partitions count to 255 or 65,535
        yield pd.DataFrame({"part": range(16), "doc": 0, "known": False, "n": 0, "d1": 0, "d2": 0, "bits": [c.tobytes() for c in np.split(own, 16)]})

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // 16, np.int64)
    for b in rows["bits"]:
        total += np.frombuffer(b, f"u{len(b) * 16 // COUNTERS}")
    return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})


@cache
def _classes(n: int, num: int, den: int, k: int) -> tuple[bool, bool]:
    """Whether the frequent tokens of a set of n tokens are indexed singly, and in runs of k."""
    fits = [-(-num * m // den) > (k - 1) * (m * (den - num) // num + 1) for m in range(-(-num * n // den), n * den // num + 1)]
    return not all(fits), any(fits)


def signatures(s: np.ndarray, counts: np.ndarray, high: float, num: int, den: int) -> np.ndarray:
    """What a set is indexed by; two sets of similarity num / den or more share one.

    Tokens are ordered by their counters, the rarest first; those above ``high`` are frequent.
    Sets that similar share at least c = ceil(t n) tokens, so the first shared one is among
    the first n - c + 1; if it is rare, it is indexed by itself. Otherwise all shared
    tokens are frequent, and the extended prefix of the frequent ones is indexed by runs of
    k in that order: at most d = n (1 - t) / t tokens are in one of the two sets alone, and
    as many borders part the first (k - 1)(d + 1) + 1 shared tokens, so k of these stand side by
    side in both sets, before what else the set has alone. A set has a number of runs in proportion to its size. Where a set of a
    size within reach has too few tokens for that, as those of one token have, single
    frequent tokens are indexed too.
    """
    n = len(s)
    need = -(-num * n // den)
    order = np.lexsort((s, counts))
    s, n_rare = s[order], int((counts <= high).sum())
    rare, often = s[:n_rare], s[n_rare:]
    if n_rare > n - need:
        return _mixed(rare[: n - need + 1])
    out = [_mixed(rare)]
    singly, in_runs = _classes(n, num, den, COMBINE)
    if singly:
        out.append(_mixed(often[: len(often) - need + 1]))
    if in_runs:
        # u tokens of this set alone leave (n - u) / t - n at most to the other one alone
        ends = [(COMBINE - 1) * (u + (n - u) * den // num - n - n_rare + 1) + 1 + u - n_rare for u in (n_rare, n - need)]
        head = often[: max(ends)]
        runs = len(head) - COMBINE + 1
        if runs > 0:
            out.append(_mixed(sum((head[j : j + runs] * _ODDS[j] for j in range(COMBINE)), np.uint64(1))))
    return np.concatenate(out)


def _groups(sig: np.ndarray) -> Iterator[np.ndarray]:
    """The entries of each signature that several have."""
    order = np.argsort(sig, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(sig[order]) != 0))) if len(sig) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(sig)))
    several = sizes > 1
    return (order[a : a + n] for a, n in zip(starts[several].tolist(), sizes[several].tolist(), strict=True))


def _indexed(words: int, num: int, den: int, sketch: np.ndarray, buckets: int):
    """Signatures by bucket. A batch's long posting lists send one member on and are linked to it here."""
    mean = float(sketch.mean())
    high = mean + FREQUENT + TIMES_ROOT * mean**0.5

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, _, sets in _sets(batches, words):
            seen: dict[bytes, int] = {}
            sig, doc, size = [], [], []
            for d, s in zip(docs.tolist(), sets, strict=True):
                if not len(s) or seen.setdefault(s.tobytes(), d) != d:
                    continue  # equal sets are one class already
                got = signatures(s, sketch[(s % np.uint64(COUNTERS)).astype(np.int64)], high, num, den)
                sig.append(got)
                doc.append(np.full(len(got), d, np.int64))
                size.append(np.full(len(got), len(s), np.int64))
            if not sig:
                continue
            sig, doc, size = np.concatenate(sig), np.concatenate(doc), np.concatenate(size)
            stay, big, a, b = np.ones(len(sig), bool), np.zeros(len(sig), np.int64), [], []
            member_sig, member_doc = [], []
            for g in _groups(sig):
                if len(g) > ALL_PAIRS:
                    head = g[np.argmin(doc[g])]
                    stay[g], stay[head], big[head] = False, True, 1
                    rest = g[g != head]
                    near = rest[np.minimum(size[rest], size[head]) * den >= np.maximum(size[rest], size[head]) * num]
                    a.append(np.full(len(near), doc[head]))
                    b.append(doc[near])
                    member_sig.append(sig[rest])
                    member_doc.append(doc[rest])
            sig, doc, size, big = sig[stay], doc[stay], size[stay], big[stay]
            where = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            rows = [(int(where[p[0]]), 0, sig[p].tobytes(), doc[p].tobytes(), (size[p] << 1 | big[p]).tobytes())
                    for p in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(p)]
            if a:
                at = int(where[0])
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
                rows.append((at, 1, pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), b""))
                rows.append((at, 2, np.concatenate(member_sig).tobytes(), np.concatenate(member_doc).tobytes(), b""))
            yield pd.DataFrame(rows, columns=["bucket", "kind", "x", "y", "z"])

    return run


def _candidates(num: int, den: int):
    """Pairs of a bucket's posting lists: all of short ones; of long ones a star, and their members."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda kind, c, t=np.int64: np.frombuffer(b"".join(rows.loc[rows["kind"] == kind, c]), t)
        sig, doc, size = read(0, "x", np.uint64), read(0, "y"), read(0, "z")
        big, size = size & 1, size >> 1
        a, b, member_sig, member_doc = [read(1, "x")], [read(1, "y")], [read(2, "x", np.uint64)], [read(2, "y")]
        lone = np.flatnonzero(big)  # a long list of one batch is one also where no other has its signature
        member_sig.append(sig[lone])
        member_doc.append(doc[lone])
        for g in _groups(sig):
            if len(g) > ALL_PAIRS or big[g].any():
                i, j = np.full(len(g), g[np.argmin(doc[g])]), g
                member_sig.append(sig[g])
                member_doc.append(doc[g])
            else:
                i, j = (g[k] for k in np.triu_indices(len(g), 1))
            near = (np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num) & (doc[i] != doc[j])
            a.append(np.minimum(doc[i], doc[j])[near])
            b.append(np.maximum(doc[i], doc[j])[near])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        members = np.unique(np.stack([np.concatenate(member_sig).view(np.int64), np.concatenate(member_doc)], 1), axis=0)
        return pd.DataFrame({"member": np.repeat([False, True], [len(pairs), len(members)]), "x": np.r_[pairs[:, 0], members[:, 0]], "y": np.r_[pairs[:, 1], members[:, 1]]})

    return run


def _folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one length at a shorter one, as 64-bit words."""
    x = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)
    while x.shape[1] * 8 > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _possible(na, nb, differ, num: int, den: int) -> np.ndarray:
    """Whether sizes and differing bits, each of at least one differing token, allow the similarity."""
    return (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (differ * (den + num) <= (den - num) * (na + nb))


def _filtered(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for (la, lb), g in p.groupby([p["xa"].map(len), p["xb"].map(len)]):
                x, y = _folded(g["xa"].tolist(), min(la, lb)), _folded(g["xb"].tolist(), min(la, lb))
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                yield g.loc[_possible(g["na"].to_numpy(), g["nb"].to_numpy(), differ, num, den), ["a", "b"]]

    return run


def _pairs_across(rows: pd.DataFrame, num: int, den: int, nearest: bool) -> list[np.ndarray]:
    """Pairs of a posting list's two blocks that lie in different components and may be similar.

    With ``nearest`` only each left row's most similar one by bitmap. Role 2 stands on both sides. Two strays meet
    from both sides, so one of the ways counts.
    """
    out = []
    rows = rows.assign(size=rows["bits"].map(len))
    for la, left in rows[rows["role"] != 1].groupby("size"):
        for lb, right in rows[rows["role"] != 0].groupby("size"):
            if max(la, lb) > 2 * min(la, lb):
                continue  # sizes too far apart
            x, y = _folded(left["bits"].tolist(), min(la, lb)), _folded(right["bits"].tolist(), min(la, lb))
            n, doc, root, stray = (right[c].to_numpy()[None, :] for c in ("n", "doc", "root", "stray"))
            step = max(1, WORDS // y.size)
            for at in range(0, len(x), step):
                m, d, r = (left[c].to_numpy()[at : at + step, None] for c in ("n", "doc", "root"))
                differ = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                good = (root != r) & _possible(m, n, differ, num, den)
                if nearest:
                    best = np.where(good, differ / (m + n), np.inf).argmin(axis=1)
                    i = np.flatnonzero(good[np.arange(len(best)), best])
                    j = best[i]
                else:
                    i, j = np.nonzero(good & (~stray | (doc > d)))
                out.append(np.stack([np.minimum(d[i, 0], doc[0, j]), np.maximum(d[i, 0], doc[0, j])], 1))
    return out


def _across(num: int, den: int, nearest: bool):
    """Rows come sorted by block pair; a pair's rows may run over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def flush() -> pd.DataFrame:
            found = [np.zeros((0, 2), np.int64)]
            for _, g in pd.concat(held).groupby(["sig", "i", "j"], sort=False):
                found += _pairs_across(g, num, den, nearest)
            pairs = np.unique(np.concatenate(found), axis=0)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        for b in batches:
            key = list(zip(b["sig"], b["i"], b["j"], strict=True))
            edge = next((k for k in range(len(key) - 1, -1, -1) if key[k] != key[-1]), -1) + 1
            if edge or (last is not None and key[0] != last):
                if edge:
                    held.append(b.iloc[:edge])
                yield flush()
                held = []
            held.append(b.iloc[edge:])
            last = key[-1]
        if held:
            yield flush()

    return run


def _verified(words: int, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                p = b.iloc[at : at + 200]
                texts = list(dict.fromkeys([*p["ta"], *p["tb"]]))
                sets = dict(zip(texts, shingle_sets(texts, words), strict=True))
                good = []
                for x, y in zip(p["ta"], p["tb"], strict=True):
                    s, t = sets[x], sets[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(both * den >= num * (len(s) + len(t) - both))
                yield p.loc[good, ["a", "b"]]

    return run


def _contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots (rep, root) after further links, from the components of the roots that they join."""
    end = lambda c: roots.select(F.col("rep").alias(c), F.col("root").alias(f"r{c}"))
    joined = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = connected_components(joined)
    old = roots.join(up.withColumnRenamed("id", "root"), "root", "left").select("rep", F.coalesce("component_id", "root").alias("root"))
    new = up.join(roots, up["id"] == roots["rep"], "left_anti").select(F.col("id").alias("rep"), F.col("component_id").alias("root"))
    return cut(old.unionByName(new), "shingle-roots")


def join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of num / den or more.

    Words are the runs between ASCII white space, A-Z in lower case; a set holds the distinct
    runs of ``words`` words, of a shorter text the whole sequence. Returns id, n_shingles and
    component_id (smallest id reachable by links, itself included). Null texts and texts
    without words have empty sets and link with nothing; null ids neither. An id is one node
    whatever its rows are: each keeps its row and its n_shingles, a link of one is a link of all, and all
    have one component. An empty table gives no rows; other columns are ignored.

    Equal sets are one class from the start. Token-combination prefixes index each class:
    rare tokens singly, frequent ones in pairs (see ``signatures``). A short posting list
    gives all its pairs; a long one pairs its members with one of them. Pairs that pass the
    size and bitmap bounds are verified on the texts. Long lists whose members
    are then in one component are done; in others each member is tried with its nearest one
    of another component, and then all pairs across components that are left, in
    blocks, so that no link that would join components is lost.
    """
    spark = session(docs)
    rows = keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")))
    text = rows.select("doc", (F.col("id") != NO_ID).alias("known"), "t")
    facts = cut(text.mapInPandas(_described(words), "part int, doc bigint, known boolean, n bigint, d1 bigint, d2 bigint, bits binary"), "shingle-facts")
    slices = facts.where("part >= 0").groupBy("part").applyInPandas(_summed, "part int, bits binary").toPandas().sort_values("part")
    sketch = np.frombuffer(b"".join(slices["bits"]), np.uint32) if len(slices) else np.zeros(COUNTERS, np.uint32)
    facts = facts.where("part < 0").drop("part")
    # a set has about so many signatures, and a bucket is one group
    buckets = max(64, 2 * partitions(spark), (facts.agg(F.sum("n")).first()[0] or 0) * (den - num) // den // SIGNATURES)
    classes = cut(facts.where("n > 0 and known").groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep"), F.first("bits").alias("bits")), "shingle-classes")
    text_of = text.where("known")
    found = cut(
        text.where("t is not null and known").mapInPandas(_indexed(words, num, den, sketch, buckets), "bucket int, kind int, x binary, y binary, z binary")
        .groupBy("bucket").applyInPandas(_candidates(num, den), "member boolean, x bigint, y bigint"), "shingle-pairs")
    # every indexed document's class
    own = cut(facts.where("n > 0 and known").join(classes, ["n", "d1", "d2"]).select("doc", "rep", "n", classes["bits"]), "shingle-own")
    classes_of = own.select("doc", "rep", "n", "bits")

    def named(pairs: DataFrame) -> DataFrame:
        side = lambda c: classes_of.select(F.col("doc").alias(c), F.col("rep").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").where("ra <> rb")
        near = near.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb", "xa", "xb")
        return near.mapInPandas(_filtered(num, den), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = (
            text_of.select(F.col("doc").alias("a"), F.col("t").alias("ta")).join(pairs, "a")
            .join(text_of.select(F.col("doc").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb"))
        return cut(both.mapInPandas(_verified(words, num, den), "a bigint, b bigint"), name)

    links = verified(cut(named(found.where("not member").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()), "shingle-near"), "shingle-links")
    members = cut(found.where("member").select(F.col("x").alias("sig"), F.col("y").alias("doc")).join(own.select("doc", "rep"), "doc").select("sig", "rep"), "shingle-members")
    facts_of = classes.select("rep", "n", "bits")
    roots = connected_components(links).withColumnsRenamed({"id": "rep", "component_id": "root"})
    for nearest in (True, False):
        # first each document with its nearest one elsewhere, which joins most that can be joined; then all that is left
        placed = members.join(roots, "rep", "left").select("sig", "rep", F.coalesce("root", "rep").alias("root"))
        parts = placed.groupBy("sig", "root").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who"))
        open_lists = (
            parts.groupBy("sig").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("size"), F.sum("who").alias("who"), F.count("*").alias("roots"))
            .where("roots > 1").groupBy("who", "size").agg(F.min(F.struct("sig", "main", "n")).alias("l")).select("l.*", "size"))
        in_blocks = lambda c: F.ceil(c / BLOCK).cast("int")
        blocks = cut(open_lists.select("sig", "main", in_blocks(F.col("size") - F.col("n")).alias("lefts"), in_blocks(F.col("size")).alias("rights")), "shingle-open")
        if blocks.isEmpty():
            break
        dealt = cut(placed.join(blocks, "sig").distinct(), "shingle-dealt").join(facts_of, "rep")
        own = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
        dealt = dealt.withColumns({"stray": F.col("root") != F.col("main"), "l": own("lefts"), "r": own("rights")})
        # members of a list's largest component stand on the right only, as they need no pairs among themselves
        at = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
        every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        left = F.transform(every("rights"), lambda j: at(F.col("l"), j, F.when(j == F.col("r"), 2).otherwise(0)))
        right = F.transform(every("lefts"), lambda i: at(i, F.col("r"), F.lit(1)))
        places = F.when(F.col("stray"), F.concat(left, F.filter(right, lambda x: x["i"] != F.col("l")))).otherwise(right)
        more = (
            dealt.select("sig", F.explode(places).alias("p"), F.col("rep").alias("doc"), "n", "bits", "root", "stray").select("sig", "p.*", "doc", "n", "bits", "root", "stray")
            .repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInPandas(_across(num, den, nearest), "a bigint, b bigint").distinct())
        late = verified(cut(more, "shingle-across"), "shingle-late")
        if not late.isEmpty():
            roots = _contracted(roots, late)
    groups = roots.withColumnRenamed("root", "component")
    final = cut(classes.join(groups, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component")), "shingle-components")
    out = facts.select("doc", "known", "n", "d1", "d2").join(final, ["n", "d1", "d2"], "left").select("doc", "known", "n", F.when(F.col("known"), F.coalesce("component", "doc")).alias("component"))
    if rows.where("doc <> id").isEmpty():  # rows are ids
        return out.select(F.when(F.col("known"), F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return _by_id(cut(out.join(rows.select("doc", "id"), "doc"), "shingle-rows")).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _by_id(rows: DataFrame) -> DataFrame:
    """Components of rows (id, known, n, component) as components of ids: those that rows of one id lie in are one, named by its least id."""
    known = rows.where("known")
    low = known.groupBy("id").agg(F.min("component").alias("low"))
    up = connected_components(known.join(low, "id").where("component <> low").select(F.col("low").alias("a"), F.col("component").alias("b")))
    roots = cut(known.join(up.withColumnsRenamed({"id": "component", "component_id": "root"}), "component", "left").select("id", "component", F.coalesce("root", "component").alias("root")), "shingle-id-roots")
    names = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    of = roots.select("component", "root").distinct().join(names, "root").drop("root")
    return rows.join(of, "component", "left").select(F.when(F.col("known"), F.col("id")).alias("id"), "n", "component_id")
