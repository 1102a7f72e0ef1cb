"""Renames by similarity between the deleted and the added files of a change (C14)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import written

#: The least score of a rename, and the bytes of a block without a line's end.
LEAST, BLOCK = 60, 64
#: Candidates of an added file that take part in the assignment, the best first: the limit of rename detection.
CANDIDATES = 256
#: Contents with a block up to which it counts as rare, and equal contents in a part when their pairs are made.
RARE, PART = 16, 512


def name_score(a: str, b: str) -> int:
    """0 to 100: how much of the directories agrees from the left and from the right, and of the file names from the right."""

    def common(x: str, y: str) -> int:
        return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    (da, fa), (db, fb) = ((p[: p.rfind("/") + 1], p[p.rfind("/") + 1 :]) for p in (a, b))
    longest, name = max(len(da), len(db)), max(len(fa), len(fb))
    left, right = (100, 100) if not longest else (common(da, db) * 100 // longest, common(da[::-1], db[::-1]) * 100 // longest)
    file = common(fa[::-1], fb[::-1]) * 100 // name if name else 100
    return ((left + right) * 25 + file * 50) // 100


def blocks(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (blob, one: the least blob of equal content) and the weights of each content's distinct blocks: one, size, block, bytes. Both written.

    A block is a line, cut at 64 bytes. Texts aren't shuffled: a row becomes hashes and lengths where it is read.
    """
    each = contents.where("data is not null and octet_length(data) > 0").withColumn("digest", F.unhex(F.sha2("data", 256)))
    named = each.groupBy("blob").agg(F.min("digest").alias("digest"))
    members = written(named.select("blob", "digest", F.min("blob").over(Window.partitionBy("digest")).alias("one")))
    text = F.decode("data", "ISO-8859-1")  # a character for each byte
    cut = F.regexp_extract_all(text, F.lit(rf"[^\n]{{0,{BLOCK - 1}}}\n|[^\n]{{1,{BLOCK}}}"), 0)
    hashed = each.select("digest", F.octet_length("data").alias("size"), F.transform(cut, lambda b: F.struct(F.xxhash64(b).alias("block"), F.length(b).cast("tinyint").alias("n"))).alias("b"))
    flat = hashed.select("digest", "size", "b.block", "b.n").dropDuplicates(["digest"])
    found = flat.join(members.where("blob = one").select("digest", "one"), "digest").select("digest", "one", "size", F.explode(F.arrays_zip("block", "n")).alias("b"))
    sums = found.groupBy("digest", "one", "size", F.col("b.block").alias("block")).agg(F.sum("b.n").alias("bytes"))
    return members.select("blob", "one"), written(sums.select("one", "size", "block", "bytes"))


def similar(old: DataFrame, new: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs of contents that share enough: from, to, shared (bytes in common), size (of the larger one). Inputs: blob, data.

    Equal contents of a side are compared as one, and their pairs made last. Weighted prefixes: blocks in order of their frequency,
    rarest first; two contents of which ``least`` percent of the larger one agree share a block among those that make up the rest
    of either. Only these meet, so that a line which all files hold makes no pairs of files that have nothing else in common. All
    pairs are then compared by all their blocks.
    """
    (from_members, old_blocks), (to_members, new_blocks) = blocks(old), blocks(new)
    sides = old_blocks, new_blocks
    rate = max(0, least - 1)  # of 99 parts of the content, those that must agree where the names do
    often = sides[0].select("block").unionByName(sides[1].select("block")).groupBy("block").agg(F.count("*").alias("often"))
    often = written(often.where(F.col("often") > RARE))  # the others count as equally rare, so few blocks are joined
    order = Window.partitionBy("one").orderBy("often", "block").rowsBetween(Window.unboundedPreceding, -1)

    def prefix(side: DataFrame) -> DataFrame:
        ranked = side.join(often, "block", "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
        return ranked.where(F.col("before") * 99 <= F.col("size") * (99 - rate)).select("one", "size", "block")

    a, b = (prefix(s).withColumnsRenamed({"one": n, "size": f"s_{n}"}) for s, n in zip(sides, ("from", "to"), strict=True))
    fits = F.least("s_from", "s_to") * 99 >= F.greatest("s_from", "s_to") * rate
    pairs = written(a.join(b, "block").where(fits).select("from", "to", F.greatest("s_from", "s_to").alias("size")).distinct())
    x, y = (s.select(F.col("one").alias(n), "block", F.col("bytes").alias(f"b_{n}")) for s, n in zip(sides, ("from", "to"), strict=True))
    shared = pairs.join(x, "from").join(y, ["to", "block"]).groupBy("from", "to", "size").agg(F.sum(F.least("b_from", "b_to")).alias("shared"))
    return expanded(written(shared.where(F.col("shared") * 99 >= F.col("size") * rate)), from_members, to_members)


def expanded(pairs: DataFrame, from_members: DataFrame, to_members: DataFrame) -> DataFrame:
    """Pairs (from, to, shared, size) of what stands for equal contents as pairs of the contents (blob, one).

    Members are dealt into parts of about ``PART``; a pair of parts is a task's work, and only the last join, after which nothing is shuffled, makes all pairs.
    """

    def side(members: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
        parts = members.groupBy("one").agg(F.ceil(F.count("*") / PART).alias("parts"))
        dealt = members.join(parts, "one").select(F.col("one").alias(end), F.pmod(F.xxhash64("blob"), "parts").alias(f"p_{end}"), F.col("blob").alias(f"blob_{end}"))
        return parts.select(F.col("one").alias(end), F.col("parts").alias(f"n_{end}")), dealt

    (from_parts, from_dealt), (to_parts, to_dealt) = side(from_members, "from"), side(to_members, "to")
    every = lambda end: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{end}") - 1)).alias(f"p_{end}")
    met = pairs.join(from_parts, "from").join(to_parts, "to").select("from", "to", "shared", "size", "n_to", every("from")).select("from", "to", "shared", "size", "p_from", every("to"))
    out = met.join(from_dealt, ["from", "p_from"]).join(to_dealt, ["to", "p_to"])
    return out.select(F.col("blob_from").alias("from"), F.col("blob_to").alias("to"), "shared", "size")


def scored(pairs: DataFrame, gone: DataFrame, come: DataFrame, least: int = LEAST) -> DataFrame:
    """Candidates by path: from_path, to_path, score, with 99 parts of content and one of the names. ``gone``, ``come``: path, blob."""

    @F.pandas_udf("int")
    def names(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([name_score(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    every = pairs.join(gone.select(F.col("path").alias("from_path"), F.col("blob").alias("from")), "from").join(come.select(F.col("path").alias("to_path"), F.col("blob").alias("to")), "to")
    content = F.floor(F.col("shared") * 10_000 / F.col("size"))
    score = F.floor((content * 99 + names("from_path", "to_path") * 100) / 10_000).cast("int")
    good = every.select("from_path", "to_path", score.alias("score")).where(F.col("score") >= least)
    best = Window.partitionBy("to_path").orderBy(F.desc("score"), "from_path")
    return good.withColumn("place", F.row_number().over(best)).where(F.col("place") <= CANDIDATES).drop("place")


def assigned(candidates: DataFrame) -> DataFrame:
    """One partner for each path, by descending score, then by both paths: from_path, to_path, score.

    A pair that is the best one of both its paths is in what a sorted list would give; it is taken, all others of
    the two go, and so on. Rounds are as many as pairs wait for each other.
    """
    left, taken = written(candidates), None
    order = F.struct(F.negative("score").alias("s"), F.col("from_path").alias("f"), F.col("to_path").alias("t"))
    while not left.isEmpty():
        best = left.groupBy("from_path").agg(F.min(order).alias("m")).select("m.f", "m.t", F.negative("m.s").alias("score"))
        mine = left.groupBy("to_path").agg(F.min(order).alias("m")).select("m.f", "m.t")
        both = written(best.join(mine, ["f", "t"]).select(F.col("f").alias("from_path"), F.col("t").alias("to_path"), "score"))
        taken = both if taken is None else written(taken.unionByName(both))
        left = written(left.join(both.select("from_path"), "from_path", "left_anti").join(both.select("to_path"), "to_path", "left_anti"))
    return taken if taken is not None else candidates.limit(0)


def renames(gone: DataFrame, come: DataFrame, blobs: DataFrame, least: int = LEAST) -> DataFrame:
    """Deleted and added files (path, blob) that are one, moved and edited: from_path, to_path, score.

    ``blobs``: blob, data. Empty contents and those without data have no partner. Every pair that scores enough is found; of an
    added file the best ``CANDIDATES`` take part in the assignment.
    """
    data = lambda d: blobs.select("blob", "data").join(d.select("blob").distinct(), "blob", "left_semi")
    return assigned(scored(similar(data(gone), data(come), least), gone, come, least))
