"""Commit history: logs, version tags, submodules, release preparation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import web as W
from ..plans import graph
from . import changes

#: Beginnings of clauses that only say whom a change helps.
LOW_SIGNAL_STARTS = (
    "enabling operators to ", "enabling users to ", "enabling admins to ", "enabling teams to ",
    "which enables operators to ", "which enables users to ", "which enables admins to ", "which enables teams to ",
    "that enables operators to ", "that enables users to ", "that enables admins to ", "that enables teams to ",
    "allowing operators to ", "allowing users to ", "allowing admins to ", "allowing teams to ",
    "helping operators ", "helping users ", "helping admins ", "helping teams ",
    "making it easier for operators ", "making it easier for users ", "making it easier for admins ", "making it easier for teams ",
)
#: Fragments of such clauses.
LOW_SIGNAL_PARTS = (
    "reducing editing errors", "reducing configuration errors", "reducing operator errors", "reducing user errors",
    "reducing mistakes", "reducing confusion", "reducing friction",
    "improving usability", "improving operator confidence", "improving user confidence",
)


def log(commits: DataFrame, edges: DataFrame, release: DataFrame, base: DataFrame | None = None, limit: int | None = 100) -> DataFrame:
    """Commits that the release reaches and the base doesn't, in pre-order (A25, L11, L14): parents in order, the first ones to their end.

    ``edges``: sha, parent and, where a commit's parents have an order, ordinal. Without a limit all come, in no order.
    """
    chains = graph.Chains(edges, ordinal="ordinal" if "ordinal" in edges.columns else None)
    fence = chains.reached(base) if base is not None else None
    if limit is None:
        inside = chains.above(chains.reached(release, fence), fence).unionByName(release.select("node").distinct().join(chains.nodes, "node", "left_anti"))
        if base is not None:
            inside = inside.join(base, "node", "left_anti")
        return commits.join(inside.withColumnRenamed("node", "sha").distinct(), "sha")
    known = commits.select(F.col("sha").alias("node"))
    if base is not None:
        known = known.join(base, "node", "left_anti")
    first = chains.preorder(release, known, limit, fence)
    places = commits.sparkSession.createDataFrame(list(zip(first, range(len(first)), strict=True)), f"sha {commits.schema['sha'].dataType.simpleString()}, place int")
    return commits.join(F.broadcast(places), "sha").orderBy("place")  # as many rows as the limit


def projected(commits: DataFrame) -> DataFrame:
    """Short id, first line, author and RFC 3339 time."""
    return commits.select("sha", F.substring("sha", 1, 7).alias("short"), T.subject(F.col("message")).alias("summary"), "author", F.date_format("author_time", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"))


def with_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Commits with counts over their changed files."""
    sums = files.groupBy("sha").agg(F.count("*").alias("files_changed"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return commits.join(sums, "sha", "left").fillna(0, ["files_changed", "additions", "deletions"])


def patch_stats(lines: DataFrame) -> DataFrame:
    """Added and deleted lines by path (D07); rows: path, op (+, -, space), is_binary. Empty text patches go."""
    out = lines.groupBy("path").agg(F.count_if(F.col("op") == "+").alias("adds"), F.count_if(F.col("op") == "-").alias("deletes"), F.bool_or("is_binary").alias("is_binary"))
    return out.where((F.col("adds") + F.col("deletes") > 0) | F.col("is_binary"))


def version_tags(tags: DataFrame) -> DataFrame:
    """Tags that are versions, with their parts."""
    return tags.withColumn("v", W.version(F.col("name"))).where("v is not null")


def last_version_tag(tags: DataFrame, edges: DataFrame, head: DataFrame) -> DataFrame:
    """The best version tag of the first tagged commit in pre-order."""
    chains = graph.Chains(edges, ordinal="ordinal" if "ordinal" in edges.columns else None)
    tagged = version_tags(tags)
    first = chains.preorder(head, tagged.select(F.col("sha").alias("node")), 1)
    return tagged.where(F.col("sha").isin(first)).orderBy(F.desc("v"), "name").limit(1).select("name", "sha")


def module_urls(files: DataFrame, text: str = "text") -> DataFrame:
    """Submodule addresses by path from configuration files (A28): file, module_path, url. The last of a path wins."""
    lines = files.select("file", F.posexplode(F.split(text, "\n")).alias("n", "raw")).withColumn("l", T.stripped(F.col("raw")))
    w = Window.partitionBy("file").orderBy("n")
    lines = lines.withColumn("section", F.sum(F.col("l").startswith("[submodule ").cast("int")).over(w))
    here = Window.partitionBy("file", "section").orderBy("n")
    path = F.last(F.when(F.col("l").startswith("path = "), T.stripped(F.substring("l", 8, 10_000))), ignorenulls=True).over(here)
    got = lines.withColumn("module_path", path).where(F.col("l").startswith("url = ") & F.col("module_path").isNotNull())
    return got.groupBy("file", "module_path").agg(F.max_by(T.stripped(F.substring("l", 7, 10_000)), "n").alias("url"))


def resolved_refs(refs: DataFrame, urls: DataFrame) -> DataFrame:
    """References with the address of their commit (C18, C26): an exact hit, else the one of a unique prefix of 7 or more.

    Prefixes meet by their first seven characters, so no pair of rows is tried that doesn't share them.
    """
    asked = refs.withColumn("r", F.lower(T.stripped(F.col("ref")))).withColumn("head", F.substring("r", 1, 7))
    known = urls.select("sha", "url", F.substring("sha", 1, 7).alias("head"))
    hits = asked.where(F.length("r") >= 7).select("ref", "r", "head").distinct().join(known, "head").where(F.col("sha").startswith(F.col("r")))
    exact = F.max(F.when(F.col("sha") == F.col("r"), F.col("url")))
    one = hits.groupBy("ref").agg(exact.alias("exact"), F.min("url").alias("low"), F.max("url").alias("high"))
    return refs.join(one.select("ref", F.coalesce("exact", F.when(F.col("low") == F.col("high"), F.col("low"))).alias("url")), "ref", "left")


def recommended_sections(commits: DataFrame) -> DataFrame:
    """The headings that a set of summaries calls for, in order."""
    low = F.lower("summary")
    breaking = low.rlike(r"breaking|remove |drop |rename |path_patterns")
    fix = low.rlike(r"^fix[(:]| bug |middleware after rules")
    feature = ~fix & low.rlike(r"^feat[(:]")
    flags = commits.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("b", breaking), ("f", fix), ("n", feature), ("i", ~fix & ~feature))))
    heads = F.array_compact(F.array(*(F.when(F.col(c), F.lit(f"### {t}")) for c, t in (("b", "Breaking Changes"), ("f", "Bug Fixes"), ("n", "New Features")))))
    more = F.when(F.col("i") | (F.size(heads) == 0), F.array(F.lit("### Improvements"))).otherwise(F.array().cast("array<string>"))
    return flags.select(F.concat(heads, more, F.array(F.lit("### Full Changelog"))).alias("sections"))


def ordered_sections(sections: DataFrame, recommended: list[str]) -> DataFrame:
    """Recommended headings first, in their order, then the others as they came."""
    place = F.array_position(F.array(*map(F.lit, [r.removeprefix("### ") for r in recommended])), F.col("heading")) if recommended else F.lit(0)
    return sections.orderBy(F.when(place > 0, place).asc_nulls_last(), "ord")


def draft_fact(summary: Column, message: Column) -> Column:
    """The first paragraph that isn't the subject or trailers, as one sentence; else the bare subject."""
    lines = F.transform(F.split(message, "\n"), lambda l: T.stripped(F.regexp_replace(l, "^- ", "")))
    skip = lambda l: (l == summary) | l.rlike(r"^[A-Za-z-]+:")
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def step(s, l):
        ends = (l == "") & (F.size(s["kept"]) > 0)
        takes = ~s["done"] & ~ends & (l != "") & ~skip(l)
        return F.struct((s["done"] | ends).alias("done"), F.when(takes, F.array_append(s["kept"], l)).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate(lines, start, step, lambda s: s["kept"])
    sentence = lambda c: F.concat(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"\.$", ""), F.lit("."))
    bare = F.when(F.instr(summary, ": ") > 0, F.regexp_replace(summary, r"^.*?: ", "")).otherwise(summary)
    return F.when(F.size(kept) > 0, sentence(F.array_join(kept, " "))).otherwise(F.concat(F.regexp_replace(bare, r"\.$", ""), F.lit(".")))


def low_signal(summary: Column) -> Column:
    """Whether a clause of a summary only says whom it helps."""
    clauses = F.transform(F.split(F.lower(summary), ","), lambda c: F.regexp_replace(T.stripped(c), r"^((and )?(while )?)+", ""))
    said = lambda c: [c.startswith(x) for x in LOW_SIGNAL_STARTS] + [c.contains(x) for x in LOW_SIGNAL_PARTS]
    return F.exists(clauses, lambda c: reduce(or_, said(c)))


def changed_files(files: DataFrame) -> DataFrame:
    """Changed files with clean paths and their eight classes; those without a path go."""
    kept = files.where(F.coalesce("path", F.lit("")) != "").withColumn("path", P.clean(F.col("path")))
    return kept.withColumns(P.release_classes(F.col("path")))


def appended(values: Column, more: Column) -> Column:
    """A list and what it lacks of another one, in order."""
    return F.array_union(values, more)


def release_preparation(commits: DataFrame, files: DataFrame, tags: DataFrame, edges: DataFrame, head: DataFrame) -> dict[str, DataFrame]:
    """What release notes are written from (M22): the last version's tag, commits since, sections, candidates and file counts."""
    tag = last_version_tag(tags, edges, head)
    since = log(commits, edges, head, tag.select(F.col("sha").alias("node")), limit=None).withColumn("summary", T.subject(F.col("message")))
    own = files.join(since.select("sha"), "sha", "left_semi")
    return {"tag": tag, "commits": with_files(projected(since), own), "sections": recommended_sections(since), "candidates": candidates(since, own)}


def candidates(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Release-note candidates: section, fact and confidence of the commits that belong in the narrative."""
    classed = changed_files(files)
    signals = changes.operator_signals(classed, "sha")
    why = F.when(F.col("generated_only").isNull(), F.when(F.lower("summary").rlike("^chore[(:]"), "chore without changed-file evidence")).otherwise(changes.narrative_policy(F.col("summary")))
    told = commits.join(signals, "sha", "left").where(why.isNull())
    return told.select(
        "sha", F.translate(F.concat(F.lit("commit-"), F.substring("sha", 1, 12)), "/_", "--").alias("id"), changes.section(F.col("summary"), F.col("message")).alias("section"),
        T.label(T.release_scope(F.col("summary"))).alias("label"), draft_fact(F.col("summary"), F.col("message")).alias("fact"),
        F.when(F.col("generated_only").isNull(), "low").otherwise("medium").alias("confidence"))


def changed_paths(changed: DataFrame, modules: DataFrame) -> DataFrame:
    """Old and new paths and submodule paths, distinct and in order."""
    every = changed.select("path").unionByName(changed.select(F.col("old_path").alias("path"))).unionByName(modules.select("path"))
    return every.where("path is not null and path <> ''").distinct().orderBy("path")


def followed_refs(refs: DataFrame, most: int = 10) -> DataFrame:
    """Names with the hash that they lead to over symbolic references (H10): name, hash. Longer chains and cycles give none."""
    at = refs.select("name", F.coalesce("target", F.lit("")).alias("to"), "hash")
    found = at.where("hash is not null").select("name", "hash")
    waiting = at.where("hash is null").select("name", "to")
    out = found
    for _ in range(most):
        step = waiting.join(at.select(F.col("name").alias("to"), F.col("to").alias("next"), "hash"), "to")
        out = out.unionByName(step.where("hash is not null").select("name", "hash"))
        waiting = step.where("hash is null").select("name", F.col("next").alias("to"))
    return out
