"""The trie of the conversations' common prefixes, merged from partial tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, session

#: Partial tries that a round of the tree merge brings together.
FAN = 32
#: Rows of one key from which a join may send them by broadcast, and how many such keys there are at most, by partition.
HEAVY_ROWS, HEAVY_KEYS = 1000, 4
#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
KEY = ("depth", "k1", "k2")


def spread(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns in range partitions by conversation and turn, written once: part, conv, turn, a, b, words.

    A turn is 120 bits of the MD5 of its role and text from here on. Rows of one conversation, or equal ones,
    may lie in several parts, which hold them in order.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("bigint")
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    rows = rows.select("conv", "turn", half(1).alias("a"), half(16).alias("b"), "words", F.monotonically_increasing_id().alias("salt"))
    ranged = rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "a", "b", "salt")
    return cut(ranged.select(F.spark_partition_id().alias("part"), "conv", "turn", "a", "b", "words"), "turns")


def blocks(turns: DataFrame, heads: str | None, base: str | None) -> DataFrame:
    """One row for each conversation and part that holds turns of it.

    ``before``: turns in earlier parts; ``h``: turns that go, ``k``: turns that come from ``base`` instead; ``length``:
    turns after that.
    """
    counts = turns.groupBy("conv", "part").agg(F.count("*").alias("n"))
    own, up = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumns({
        "before": F.coalesce(F.sum("n").over(up), F.lit(0)), "total": F.sum("n").over(own), "first": F.min("part").over(own), "final": F.max("part").over(own),
        "h": F.expr(heads or "0").cast("bigint"), "base": F.expr(base or "conv")})
    bases = found.where("part = first").select(F.col("conv").alias("base"), F.col("total").alias("there"))
    found = found.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    return cut(found.withColumn("length", F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).drop("there", "n"), "blocks")


def rebuilt(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations and a textless one at depth 0: conv, part, depth, words, h1, h2, ends, whole.

    h1 and h2 are hashes of a turn at its depth. ``whole``: all of the conversation lies in one part.
    """
    place = F.row_number().over(Window.partitionBy("part", "conv").orderBy(F.asc_nulls_first("turn"), "a", "b"))
    numbered = lambda of: turns.join(of, ["part", "conv"]).withColumn("pos", F.col("before") + place)
    own = numbered(found).where("pos > h").withColumn("depth", F.col("k") + F.col("pos") - F.col("h"))
    wanted = found.where("part = first")
    asked = wanted.where("k > 0").select("base", "conv", "first", "final", "k", "length")
    # the few turns that others take over: at most as many as the longest head, and only of conversations that are a base
    lent = numbered(found.where("conv = base")).where(F.col("pos") <= F.lit(wanted.agg(F.max("k")).first()[0] or 0))
    heads = asked.join(lent.select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "a", "b", "words"), "base").where("depth <= k")
    keep = [F.col(c) for c in ("conv", "part", "depth", "a", "b", "words", "length")]
    whole = (F.col("first") == F.col("final")).alias("whole")
    rows = own.select(*keep, whole).unionByName(heads.withColumn("part", F.col("first")).select(*keep, whole))
    rows = rows.select("conv", "part", "depth", "words", F.xxhash64("depth", "a", "b").alias("h1"), F.xxhash64("b", "depth", "a", F.lit(1)).alias("h2"), (F.col("depth") == F.col("length")).alias("ends"), "whole")
    zero = F.lit(0).cast("bigint")
    roots = wanted.select("conv", "part", zero.alias("depth"), zero.alias("words"), zero.alias("h1"), zero.alias("h2"), (F.col("length") == 0).alias("ends"), whole)
    return rows.unionByName(roots)


def partial_tries(rows: DataFrame) -> DataFrame:
    """Node tables of the parts: part, key, parent's key, words, n, conv (smallest member), ends (ascending).

    A prefix is named by the exclusive or of the hashes of its turns at their depths, in two times 64 bits. It is
    associative, so that a conversation in several parts carries one pair of numbers from part to part.
    """
    up = Window.partitionBy("part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({"k1": F.bit_xor("h1").over(up), "k2": F.bit_xor("h2").over(up)})
    split = rows.where("not whole").groupBy("conv", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most the first and the last conversation of each part are split, so these are two rows a part
    carried = split.select("conv", "part", F.bit_xor("x1").over(ahead).alias("c1"), F.bit_xor("x2").over(ahead).alias("c2"))
    keyed = running.join(F.broadcast(carried), ["conv", "part"], "left").withColumns({c: F.col(c).bitwiseXOR(F.coalesce(o, F.lit(0))) for c, o in (("k1", "c1"), ("k2", "c2"))})
    return cut(
        keyed.groupBy("part", *KEY).agg(
            F.first("words").alias("words"), F.first(F.col("k1").bitwiseXOR(F.col("h1"))).alias("p1"), F.first(F.col("k2").bitwiseXOR(F.col("h2"))).alias("p2"),
            F.count("*").alias("n"), F.min("conv").alias("conv"), F.sort_array(F.collect_list(F.when(F.col("ends"), F.col("conv")))).alias("ends")), "partial-tries")


def merged(parts: DataFrame) -> DataFrame:
    """One node table from many: groups of ``FAN`` parts, then groups of such groups, until one is left."""
    last, level = parts.agg(F.max("part")).first()[0] or 0, parts.drop("ends")
    while True:
        level = level.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", *KEY).agg(
            F.first("words").alias("words"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.sum("n").alias("n"), F.min("conv").alias("conv"))
        last //= FAN
        if not last:
            return level.drop("part")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the lists of each key; they come in order, and only the state of one hash is held."""
    key, state = None, None
    for b in batches:
        done = []
        for depth, k1, k2, ids in zip(b["depth"].tolist(), b["k1"].tolist(), b["k2"].tolist(), b["ids"].tolist(), strict=True):
            if (depth, k1, k2) == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, k1, k2), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=[*KEY, "digest"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "digest"])


def end_digests(parts: DataFrame) -> DataFrame:
    """Digest of all that end at a node, ascending: lists of parts follow each other, as parts are ranges of conversations."""
    lists = parts.where(F.size("ends") > 0).select(*KEY, "part", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids"))
    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInPandas(_digests, "depth bigint, k1 bigint, k2 bigint, digest string")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a table of unique keys, whatever part of the rows has one key.

    Keys with more rows than a ``HEAVY_KEYS``-th part of a partition's are so few by their number (at most
    HEAVY_KEYS for each partition), that their table rows are broadcast; the others are shuffled. ``rows`` must be a written table.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("_rows"))
    limit = max(HEAVY_ROWS, rows.count() // (HEAVY_KEYS * partitions(rows.sparkSession)))
    heavy = cut(counts.where(F.col("_rows") > limit).select(*on, F.lit(True).alias("_heavy")), "heavy")
    if heavy.isEmpty():
        return rows.join(table, on, "left")
    tagged = rows.join(F.broadcast(heavy), on, "left")
    theirs = table.join(F.broadcast(heavy), on).drop("_heavy")
    return tagged.where("_heavy").drop("_heavy").join(F.broadcast(theirs), on, "left").unionByName(tagged.where("_heavy is null").drop("_heavy").join(table, on, "left"))


def rolled_up(shared: DataFrame) -> DataFrame:
    """Sums over subtrees from rows (conv, depth, up, leaves, saved), where (up, depth - 1) is the parent: conv, depth, leaves, saved.

    By doubling: after a round each node has the sum of what lies less than 2^r below, and points 2^r upwards;
    rounds grow with the logarithm of the depth.
    """
    deepest, step = shared.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        below = shared.where(F.col("depth") >= step).select(F.col("up").alias("conv"), (F.col("depth") - step).alias("depth"), "leaves", "saved")
        gained = below.groupBy("conv", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sums = shared.join(gained, ["conv", "depth"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
        sums = sums.drop("more_leaves", "more_saved")
        if step * 2 <= deepest:
            sums = cut(sums.withColumnsRenamed({"depth": "at", "conv": "own"}).withColumns({"conv": F.col("up"), "depth": F.col("at") - step}), "sums")
            there = shared.select("conv", "depth", F.col("up").alias("next"))
            moving = looked_up(sums.where("depth >= 0"), there, ["conv", "depth"]).withColumn("up", F.col("next")).drop("next")
            sums = moving.unionByName(sums.where("depth < 0")).drop("conv", "depth").withColumnsRenamed({"at": "depth", "own": "conv"})
        shared = cut(sums, "rollup")
        step *= 2
    return shared.select("conv", "depth", "leaves", "saved")


def prefix_trie(turns: DataFrame, heads: str | None = None, base: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node of depth d is a distinct sequence of the first d turns (role, text), the root has none; its members are
    the conversations that begin with it. ``saved_tokens`` sums over its subtree the words of each node's
    last text times its members but one; ``ends_sha256`` is the digest of the ascending ids that end there, joined
    by commas. With ``heads`` and ``base``, SQL over ``conv``, a conversation's first turns are first replaced by those
    of another one (``conv - base`` need not exist; a base must be its own base).

    Range partitions give partial tries, locally combined; hash-keyed rounds merge them, summing members; end lists of the
    partitions follow each other into one digest. Leaves and savings then go upwards, by doubling; nodes with one
    member need no step, as their subtree is one conversation. Nothing is gathered by conversation or by node, so that a
    conversation or a first turn may hold any part of the rows; a node's end list is read as a stream.

    Turns are in the order of ``turn`` (null first); those with the same one in that of their digests. Null roles
    and texts are empty; rows without a conversation's id take no part; a repeated row is a turn of its own. An empty
    table has no nodes, not even a root.
    """
    session(turns)
    ranged = spread(turns, id_col, turn_col, role_col, text_col)
    parts = partial_tries(rebuilt(ranged, blocks(ranged, heads, base)))
    nodes = cut(merged(parts), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.sum((F.col("n") == 1).cast("bigint")).alias("single"))
    nothing = hashlib.sha256().hexdigest()
    nodes = cut(
        nodes.join(children, [*KEY], "left").join(end_digests(parts), [*KEY], "left")
        .fillna(0, ["n_children", "single"]).fillna(nothing, ["digest"]), "trie")
    names = {"conv": "own", "depth": "at", "k1": "_k1", "k2": "_k2"}
    below = cut(nodes.where("depth > 0").withColumnsRenamed(names).withColumns({"depth": F.col("at") - 1, "k1": F.col("p1"), "k2": F.col("p2")}), "children")
    above = looked_up(below, nodes.select(*KEY, F.col("conv").alias("up")), [*KEY])
    facts = ("conv", "depth", "up", "n", "words", "n_children", "single", "digest")
    above = above.drop(*KEY).withColumnsRenamed({"own": "conv", "at": "depth"}).select(*facts)
    tree = cut(above.unionByName(nodes.where("depth = 0").withColumn("up", F.lit(None).cast("bigint")).select(*facts)), "tree")
    shared = tree.where("n > 1").select("conv", "depth", "up", (F.col("single") + (F.col("n_children") == 0).cast("bigint")).alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    return tree.join(rolled_up(cut(shared, "shared")), ["conv", "depth"], "left").select(
        F.col("conv").alias(id_col), "depth", F.col("up").alias(f"parent_{id_col}"), F.col("n").alias("n_convs"), F.col("n_children").cast("bigint"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.col("digest").alias("ends_sha256"))
