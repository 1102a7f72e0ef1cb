"""Change views: the difference of two flat trees by path, status, counts, text and fingerprint, also over nested repositories.

A flat tree has a row per file: path, mode, blob. Blobs have blob, size and data (null beyond a cap).
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import web as W
from ..plans import graph
from ..plans.ranks import running
from . import changes
from . import renames as similarity

#: Mode of a submodule's entry, files of an excerpt, entries of a prompt's lists, focus paths.
GITLINK, EXCERPT_FILES, PROMPT_ENTRIES, FOCUS = "160000", 5, 128, 5
#: Modes of a directory, a file and an executable one.
DIRECTORY, FILE, EXECUTABLE = "40000", "100644", "100755"
#: Bytes of a worktree file, and of all of them, that a snapshot holds.
FILE_CAP, TOTAL_CAP = 8 << 20, 64 << 20
#: The two trees of each view, old and new.
PAIRS = {
    "staged": ("head", "index"), "uncommitted": ("head", "worktree"), "head": ("parent", "head"),
    "final_amended": ("parent", "index"), "amend_delta": ("head", "index"), "pull_request": ("origin", "head"),
}
_NO_END = "\0"


CHANGE = "path string, old_path string, status string, old_blob string, new_blob string, old_mode string, new_mode string, submodule boolean"


def tree_diff(old: DataFrame, new: DataFrame, renames: bool = True, blobs: DataFrame | None = None) -> DataFrame:
    """Changed paths of two flat trees with both sides (C14, M15): path, old_path, status, old_blob, new_blob, old_mode, new_mode, submodule.

    Renames are exact ones first, by path; with ``blobs`` (blob, data), then those by similarity.
    """
    a, b = (d.select("path", F.col("blob").alias(f"{s}_blob"), F.col("mode").alias(f"{s}_mode")) for d, s in ((old, "old"), (new, "new")))
    both = a.join(b, "path", "full_outer").where(~F.col("old_blob").eqNullSafe(F.col("new_blob")) | ~F.col("old_mode").eqNullSafe(F.col("new_mode")))
    out = both.select("path", F.lit(None).cast("string").alias("old_path"), _status(F.col("old_blob"), F.col("new_blob")).alias("status"), "old_blob", "new_blob", "old_mode", "new_mode")
    out = out.withColumn("submodule", F.coalesce(F.col("old_mode") == GITLINK, F.lit(False)) | F.coalesce(F.col("new_mode") == GITLINK, F.lit(False)))
    return renamed(out, blobs) if renames else out


def _status(old_blob: Column, new_blob: Column) -> Column:
    return F.when(old_blob.isNull(), "added").when(new_blob.isNull(), "deleted").otherwise("modified")


def pruned_diff(entries: DataFrame, old_root: str, new_root: str, renames: bool = True, blobs: DataFrame | None = None, few: int = 1000) -> DataFrame:
    """The same from the entries of tree objects (tree, name, mode, child), following only directories that differ (C14).

    A level a round: pairs of unequal trees under one path give the entries that differ; directories go to the next round, alone where
    the other side has none. Equal subtrees are never opened. Up to ``few`` trees are asked for by a filter that a scan of
    sorted entries can use, more by a join.
    """
    spark = entries.sparkSession
    level = spark.createDataFrame([("", old_root, new_root)], "prefix string, old string, new string").where("old is distinct from new")
    leaves = None
    while not level.isEmpty():
        wanted = level.select(F.explode(F.array_compact(F.array("old", "new"))).alias("tree")).distinct()
        trees = [r.tree for r in wanted.limit(few + 1).collect()]
        read = entries.where(F.col("tree").isin(trees)) if len(trees) <= few else entries
        side = lambda s: level.select("prefix", F.col(s).alias("tree")).where("tree is not null").join(read, "tree").select("prefix", "name", F.col("mode").alias(f"{s}_mode"), F.col("child").alias(f"{s}_blob"))
        both = side("old").join(side("new"), ["prefix", "name"], "full_outer")
        found = graph.written(both.where("not (old_blob <=> new_blob) or not (old_mode <=> new_mode)").withColumn("path", F.concat("prefix", "name")))
        is_dir = lambda s: F.coalesce(F.col(f"{s}_mode") == DIRECTORY, F.lit(False))
        file = lambda s, c: F.when(~is_dir(s), F.col(f"{s}_{c}")).alias(f"{s}_{c}")
        own = found.select("path", file("old", "blob"), file("new", "blob"), file("old", "mode"), file("new", "mode")).where("old_blob is not null or new_blob is not null")
        leaves = own if leaves is None else leaves.unionByName(own)
        level = found.select(F.concat("path", F.lit("/")).alias("prefix"), *(F.when(is_dir(s), F.col(f"{s}_blob")).alias(s) for s in ("old", "new"))).where("old is distinct from new")
    if leaves is None:
        return spark.createDataFrame([], CHANGE)
    link = lambda s: F.coalesce(F.col(f"{s}_mode") == GITLINK, F.lit(False))
    out = leaves.select("path", F.lit(None).cast("string").alias("old_path"), _status(F.col("old_blob"), F.col("new_blob")).alias("status"), "old_blob", "new_blob", "old_mode", "new_mode", (link("old") | link("new")).alias("submodule"))
    return renamed(out, blobs) if renames else out


def renamed(out: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Changes in which a deleted and an added file of equal content are one; with ``blobs`` also those of similar content."""
    place = lambda c: F.row_number().over(Window.partitionBy(c, "submodule").orderBy("path"))
    gone = out.where("status = 'deleted' and not submodule").select(F.col("path").alias("from"), F.col("old_blob").alias("blob"), F.col("old_mode").alias("from_mode"), place("old_blob").alias("k"))
    come = out.where("status = 'added' and not submodule").select("path", F.col("new_blob").alias("blob"), place("new_blob").alias("k"))
    moved = come.join(gone, ["blob", "k"]).select("path", "from", F.col("blob").alias("from_blob"), "from_mode")
    if blobs is not None:
        moved = graph.written(moved)
        rest = lambda d, own, c: graph.written(d.join(moved.select(F.col(own).alias(c)), c, "left_anti"))
        gone, come = rest(gone, "from", "from"), rest(come, "path", "path")
        regular = F.col("from_mode").isin(FILE, EXECUTABLE)
        if not gone.isEmpty() and not come.isEmpty():
            near = similarity.renames(gone.where(regular).select(F.col("from").alias("path"), "blob"), come.select("path", "blob"), blobs)
            more = near.join(gone, near["from_path"] == gone["from"]).select(F.col("to_path").alias("path"), "from", F.col("blob").alias("from_blob"), "from_mode")
            moved = moved.unionByName(more)
    named = out.join(moved, "path", "left").join(moved.select(F.col("from").alias("path")), "path", "left_anti")
    is_moved = F.col("from").isNotNull()
    return named.select(
        "path", F.col("from").alias("old_path"), F.when(is_moved, "renamed").otherwise(F.col("status")).alias("status"), F.coalesce("from_blob", "old_blob").alias("old_blob"), "new_blob",
        F.coalesce("from_mode", "old_mode").alias("old_mode"), "new_mode", "submodule")


def _lines(data: bytes | None) -> list[str]:
    text = (data or b"").decode(errors="replace")
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else [*lines[:-1], lines[-1] + _NO_END]


def _patch(path: str, old_path: str | None, a: bytes | None, b: bytes | None, old_mode: str | None, new_mode: str | None) -> tuple[str, int, int, bool]:
    """A file's unified diff, added and deleted lines, and whether it is binary."""
    before = old_path or path
    head = [f"diff --git a/{before} b/{path}"]
    if old_mode is None:
        head.append(f"new file mode {new_mode}")
    elif new_mode is None:
        head.append(f"deleted file mode {old_mode}")
    elif old_mode != new_mode:
        head += [f"old mode {old_mode}", f"new mode {new_mode}"]
    if old_path:
        head += [f"rename from {old_path}", f"rename to {path}"]
    names = "/dev/null" if old_mode is None else f"a/{before}", "/dev/null" if new_mode is None else f"b/{path}"
    if any(b"\0" in (x or b"")[:8000] for x in (a, b)):
        return "\n".join([*head, f"Binary files {names[0]} and {names[1]} differ"]) + "\n", 0, 0, True
    body = list(difflib.unified_diff(_lines(a), _lines(b), *names, lineterm=""))
    hunks = body[2:]
    adds, deletes = (sum(x.startswith(s) for x in hunks) for s in "+-")
    shown = [x.replace(_NO_END, "\n\\ No newline at end of file") if x.endswith(_NO_END) else x for x in body]
    return "\n".join([*head, *shown]) + "\n", adds, deletes, False


def _patches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            old, new = (None if pd.isna(x) else x for x in (r.old_mode, r.new_mode))
            a, c = (f"Subproject commit {h}\n".encode() if m == GITLINK and h else d for m, h, d in ((old, r.old_blob, r.old_data), (new, r.new_blob, r.new_data)))
            rows.append((r.path, *_patch(r.path, r.old_path, a, c, old, new)))
        yield pd.DataFrame(rows, columns=["path", "text", "adds", "deletes", "is_binary"])


class View:
    """The difference of two flat trees (M01, M03-M06, and M02 over the parts of ``united``)."""

    def __init__(self, old: DataFrame, new: DataFrame, blobs: DataFrame, renames: bool = True, history: DataFrame | None = None, similar: bool = True) -> None:
        self.changes = graph.written(tree_diff(old, new, renames, blobs if similar else None))
        self.blobs, self.history = blobs, history
        self._texts: DataFrame | None = None

    @classmethod
    def of(cls, kind: str, trees: dict[str, DataFrame], blobs: DataFrame, **options) -> View:
        """A named view over trees by name; a tree that isn't there is empty, as a root commit's parent is."""
        some = next(iter(trees.values())).limit(0)
        return cls(*(trees.get(n, some) for n in PAIRS[kind]), blobs, **options)

    @classmethod
    def united(cls, parts: list[tuple[str, View]]) -> View:
        """The views of components under their prefixes as one (M02, M07, D31); of a path in several the last component's holds."""
        out = cls.__new__(cls)
        rows = [v.changes.withColumns({"path": placed(F.col("path"), p), "old_path": placed(F.col("old_path"), p), "_k": F.lit(k)}) for k, (p, v) in enumerate(parts)]
        every = reduce(DataFrame.unionByName, rows)
        last = F.max_by(F.struct(*[c for c in every.columns if c not in ("path", "_k")]), "_k")
        out.changes = graph.written(every.groupBy("path").agg(last.alias("r")).select("path", "r.*"))
        out.blobs = reduce(DataFrame.unionByName, [v.blobs for _, v in parts]).dropDuplicates(["blob"])
        told = [v.history.withColumn("path", placed(F.col("path"), p)) for p, v in parts if v.history is not None]
        out.history, out._texts = (reduce(DataFrame.unionByName, told) if told else None), None
        return out

    def for_paths(self, paths: DataFrame) -> View:
        """Only changes whose old or new path is asked."""
        out = View.__new__(View)
        wanted = paths.select("path").distinct()
        hit = self.changes.join(wanted, "path", "left_semi").unionByName(self.changes.join(wanted.withColumnRenamed("path", "old_path"), "old_path", "left_semi").select(*self.changes.columns))
        out.changes, out.blobs, out._texts = hit.dropDuplicates(["path"]), self.blobs, None
        out.history = None if self.history is None else self.history.join(wanted, "path", "left_semi")
        return out

    def patches(self) -> DataFrame:
        """The change of each file with its unified diff, submodules as one line each (M13): adds text, adds, deletes, is_binary."""
        if self._texts is None:
            side = lambda s: self.blobs.select(F.col("blob").alias(f"{s}_blob"), F.col("data").alias(f"{s}_data"))
            rows = self.changes.join(side("old"), "old_blob", "left").join(side("new"), "new_blob", "left")
            made = rows.select("path", "old_path", "old_mode", "new_mode", "old_blob", "new_blob", "old_data", "new_data").mapInPandas(_patches, "path string, text string, adds bigint, deletes bigint, is_binary boolean")
            self._texts = graph.written(self.changes.join(made, "path"))
        return self._texts

    def paths(self) -> DataFrame:
        """Changed paths, both of a rename, in order."""
        return self.changes.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct().orderBy("path")

    def status(self) -> DataFrame:
        """A, D and M by path; a rename is a deletion and an addition."""
        letter = F.when(F.col("status") == "deleted", "D").when(F.col("status").isin("added", "renamed"), "A").otherwise("M")
        rows = F.array_compact(F.array(F.struct("path", letter.alias("status")), F.when(F.col("old_path").isNotNull(), F.struct(F.col("old_path").alias("path"), F.lit("D").alias("status")))))
        return self.changes.select(F.explode(rows).alias("r")).select("r.path", "r.status").orderBy("path")

    def stats(self) -> DataFrame:
        """Added and deleted lines by path, submodules with one line each."""
        return self.patches().select("path", "adds", "deletes", "is_binary").orderBy("path")

    def text(self, most_bytes: int = 200_000, most_lines: int = 5000) -> DataFrame:
        """One row: the diff in path order after the histories of moved submodules, within caps, and whether it was cut."""
        parts = self.patches().select(F.lit(1).alias("side"), "path", "text")
        if self.history is not None:
            parts = parts.unionByName(self.history.select(F.lit(0).alias("side"), "path", "text"))
        # each part has a line at least, so that the caps bound what meets in the one task
        first = parts.withColumn("text", F.substring("text", 1, most_bytes + 1)).orderBy("side", "path").limit(most_lines + 1)
        before = Window.orderBy("side", "path").rowsBetween(Window.unboundedPreceding, -1)
        within = first.withColumn("_sum", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("_sum") <= most_bytes)
        whole = within.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "path", "text"))), lambda x: x["text"]), "").alias("whole"))
        out = whole.withColumn("text", W.limited(F.col("whole"), most_bytes, most_lines))
        return out.select("text", (F.col("text") != F.col("whole")).alias("truncated"))

    def excerpt(self, most_bytes: int = 4000, most_lines: int = 80) -> DataFrame:
        """Changed lines of the first five text files, trimmed, within caps."""
        files = self.patches().where("not is_binary").orderBy("path").limit(EXCERPT_FILES)
        lines = F.filter(F.split("text", "\n"), lambda l: l.rlike(r"^(\+(?!\+\+ (b/|/dev/null))|-(?!-- (a/|/dev/null)))\s*\S"))
        shown = F.transform(lines, lambda l: F.concat(F.substring(l, 1, 1), F.lit(" "), T.stripped(F.substring(l, 2, 100_000))))
        head = F.concat(F.lit("--- "), F.when(F.col("old_path").isNotNull(), F.concat("old_path", F.lit(" => "))).otherwise(""), F.col("path"))
        whole = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", F.array_join(F.concat(F.array(head), F.slice(shown, 1, most_lines)), "\n").alias("t")))), lambda x: x["t"]), "\n\n").alias("t"))
        return whole.select(T.stripped(W.limited(F.col("t"), most_bytes, most_lines)).alias("excerpt"))

    def facts(self, header: int = 1024) -> DataFrame:
        """Facts of a change pack: path, status, adds, deletes, is_binary, header, generated, rule."""
        heads = self.blobs.select(F.col("blob").alias("new_blob"), T.valid_text(F.substring("data", 1, header), 100).alias("header"))
        rows = self.patches().join(heads, "new_blob", "left").fillna("", ["header"])
        return normalised_facts(rows.select("path", "status", "adds", "deletes", "is_binary", "header"))

    def fingerprint(self) -> DataFrame:
        """A hash of all changes."""
        return changes.fingerprint(self.changes, "path", "old_path", "status", "old_blob", "new_blob", "old_mode", "new_mode")

    def snapshot(self) -> DataFrame:
        """Status, counts and blobs of each path at once."""
        return self.patches().select("path", "old_path", "status", "adds", "deletes", "is_binary", "submodule", "old_blob", "new_blob").orderBy("path")


def placed(path: Column, prefix: str) -> Column:
    """A component's path in its parent."""
    return F.concat(F.lit(f"{prefix}/"), path) if prefix else path


def component_paths(paths: DataFrame, prefix: str) -> DataFrame:
    """Paths below a component, as the component names them."""
    return paths.where(F.col("path").startswith(f"{prefix}/")).select(F.substring("path", len(prefix) + 2, 100_000).alias("path")) if prefix else paths.select("path")


def check_fingerprint(view: View, want: str) -> None:
    """An error if a view isn't what was fingerprinted."""
    if view.fingerprint().first()[0] != want:
        raise ValueError("the change has changed since it was fingerprinted")


def normalised_facts(facts: DataFrame) -> DataFrame:
    """Facts with clean paths, a status and marks; those without a path go."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    out = facts.where(F.coalesce("path", F.lit("")) != "").withColumn("path", path).withColumn("status", F.when(F.coalesce("status", F.lit("")) == "", "modified").otherwise(F.col("status")))
    marked = T.is_go_generated(F.col("path"), F.coalesce("header", F.lit("")))
    return out.withColumns({"generated": marked, "rule": F.when(marked, T.GO_RULE).otherwise("")})


def artifacts(facts: DataFrame) -> DataFrame:
    """Distinct references of facts in order."""
    refs = facts.select(F.explode(F.array("diff_ref", "content_ref")).alias("ref"))
    return refs.where(F.coalesce("ref", F.lit("")) != "").distinct().orderBy("ref")


def generated_heavy(overview: DataFrame) -> DataFrame:
    """Overviews of over 100 files, four fifths of them generated."""
    return overview.where((F.col("files") > 100) & (F.col("generated_files") * 100 >= F.col("files") * 80))


def compact_prompt(current: DataFrame, previous: DataFrame, previous_paths: int) -> bool:
    """Whether a prompt shows summaries only."""
    return previous_paths > 100 or not generated_heavy(current).isEmpty() or not generated_heavy(previous).isEmpty()


def file_set_summary(stats: DataFrame) -> DataFrame:
    """Number of paths, sums and the first five."""
    first = F.slice(F.array_sort(F.collect_list("path")), 1, 5)
    samples = stats.select("path").orderBy("path").limit(5).agg(first.alias("sample_paths"))
    return stats.agg(F.count("*").alias("paths"), F.coalesce(F.sum("adds"), F.lit(0)).alias("adds"), F.coalesce(F.sum("deletes"), F.lit(0)).alias("deletes")).crossJoin(samples)  # one row and one row


def focus_paths(candidates: DataFrame, diff: str, most: int = FOCUS) -> DataFrame:
    """The most changed paths that a cut diff doesn't mention; the most changed one if it mentions all."""
    ranked = candidates.where(F.coalesce("path", F.lit("")) != "").dropDuplicates(["path"]).withColumn("churn", F.col("adds") + F.col("deletes"))
    said = F.lit(diff)
    mentioned = said.contains(F.concat(F.lit(" b/"), "path")) | said.contains(F.concat(F.lit(" a/"), "path"))
    new = ranked.where(~mentioned).orderBy(F.desc("churn"), "path").limit(most)
    return (ranked.orderBy(F.desc("churn"), "path").limit(1) if new.isEmpty() else new).select("path", "churn")


def bounded_entries(values: Column, most: int = PROMPT_ENTRIES) -> Column:
    """The first entries of a list and whether there are more."""
    return F.struct(F.slice(values, 1, most).alias("entries"), (F.size(values) > most).alias("truncated"))


def worktree_tree(index: DataFrame, worktree: DataFrame, file_cap: int = FILE_CAP, total_cap: int = TOTAL_CAP) -> DataFrame:
    """The index with changed worktree files laid over it (M09): path, mode, blob, data.

    ``worktree``: path, mode, blob, size, data, deleted. A file over the cap, or with which the smaller ones before it in path
    order pass the total, has a note of its size and digest for data.
    """
    fits = F.when(~F.col("deleted") & (F.col("size") <= file_cap), F.col("size")).otherwise(0)
    spread = worktree.withColumn("_fit", fits)
    sums = running(spread.select("path", "_fit").where("_fit > 0"), ["path"], {"_before": F.col("_fit")}).select("path", (F.col("_before") + F.col("_fit")).alias("_sum"))
    known = spread.join(sums, "path", "left")
    left = F.greatest(F.lit(0), F.least(F.lit(file_cap), F.lit(total_cap) - F.coalesce("_sum", F.lit(0)) + F.col("_fit")))
    note = F.encode(F.format_string("[worktree file omitted; size=%d bytes exceeds %d-byte review cap; sha256=%s]\n", F.col("size"), left, F.sha2("data", 256)), "UTF-8")
    kept = (F.col("size") <= file_cap) & (F.coalesce("_sum", F.lit(0)) <= total_cap)
    new = known.select("path", F.col("mode").alias("m"), F.col("blob").alias("b"), F.when(kept, F.col("data")).otherwise(note).alias("data"), "deleted")
    out = index.join(new, "path", "full_outer").where(~F.coalesce("deleted", F.lit(False)))
    return out.select("path", F.coalesce("m", "mode").alias("mode"), F.coalesce("b", "blob").alias("blob"), "data")


def dirty_gitlinks(head: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Submodules whose checkout isn't the recorded commit or has changes of its own (M10): path, old, new, dirty, state.

    ``head``: path, sha. ``checkouts``: path, sha, and ``entries``, an array of (path, code, hash) of uncommitted files.
    """
    state = F.sha2(F.array_join(F.transform(F.array_sort("entries"), lambda e: F.concat_ws("\0", e["path"], e["code"], e["hash"])), "\n"), 256)
    both = head.withColumnRenamed("sha", "old").join(checkouts.withColumnRenamed("sha", "new"), "path")
    dirty = F.size("entries") > 0
    return both.where((F.col("old") != F.col("new")) | dirty).select("path", "old", "new", dirty.alias("dirty"), F.when(dirty, state).alias("state"))


def with_dirty(submodules: DataFrame, dirty: DataFrame) -> DataFrame:
    """Submodule changes, replaced or joined by those of dirty checkouts."""
    return dirty.unionByName(submodules.join(dirty, "path", "left_anti"), allowMissingColumns=True)


def initialised_submodules(gitlinks: DataFrame, registered: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Submodules that are registered, checked out and stay inside, with their recorded commit (M11): path, url, base, head."""
    both = registered.where(P.is_safe(F.col("path"))).join(checkouts.select("path", F.col("sha").alias("head")), "path")
    return both.join(gitlinks.select("path", F.col("sha").alias("base")), "path", "left").select("path", "url", "base", "head")


def components(submodules: DataFrame, most: int = 64) -> DataFrame:
    """All nested components below the root (H05, M08): repo, prefix. Rows: repo, path, child; a cycle ends at a repository seen above.

    Each round goes one level down; the repositories above travel with a row.
    """
    level = submodules.sparkSession.createDataFrame([("", "", [""])], "repo string, prefix string, above array<string>")
    out = level
    for _ in range(most):
        step = level.join(submodules.select("repo", "path", "child"), "repo").where(~F.array_contains("above", F.col("child")))
        prefix = F.when(F.col("prefix") == "", F.col("path")).otherwise(F.concat_ws("/", "prefix", "path"))
        level = graph.written(step.select(F.col("child").alias("repo"), prefix.alias("prefix"), F.array_append("above", F.col("child")).alias("above")))
        if level.isEmpty():
            return out.select("repo", "prefix").orderBy("prefix")
        out = out.unionByName(level)
    raise ValueError(f"components nest deeper than {most}")


def component_files(tracked: DataFrame, parts: DataFrame) -> DataFrame:
    """Files of all components under their prefixes (A11, M08): path, repo. Rows of ``tracked``: repo, path."""
    path = F.when(F.col("prefix") == "", F.col("path")).otherwise(F.concat_ws("/", "prefix", "path"))
    return tracked.join(parts, "repo").select(path.alias("path"), "repo").distinct()


def gitlink_range(old: DataFrame, new: DataFrame) -> DataFrame:
    """Submodules whose commit differs between two revisions (M19): path, old, new, status."""
    return changes.delta(old, new, "path", "sha")


def submodule_history(moves: DataFrame, commits: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Commits between the two ends of each moved submodule (H03): path, sha, summary, distance; nearest first, capped a path.

    ``moves``: path, old, new; ``commits``: sha, message; ``edges``: sha, parent, over all repositories, as ids are unique.
    Nested moves are rows of their own (see ``components``), so one search per end serves all.
    """
    whole = moves.where("old is not null and new is not null and old <> new")
    inside = graph.written(graph.commit_ranges(edges, whole, "path"))
    near = graph.nearest_within(edges, whole.select("path", F.col("new").alias("node")), inside, "path", most)
    named = near.join(commits.select(F.col("sha").alias("node"), T.subject(F.col("message")).alias("summary")), "node")
    order = Window.partitionBy("path").orderBy("distance", "node")
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("path", F.col("node").alias("sha"), "summary", "distance")


def history_text(moves: DataFrame, history: DataFrame) -> DataFrame:
    """The heading and commits of each moved submodule as text (M13): path, text."""
    lines = history.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("distance", "sha", "summary"))).alias("c"))
    shown = F.array_join(F.transform("c", lambda c: F.concat(F.lit("  "), F.substring(c["sha"], 1, 7), F.lit(" "), c["summary"], F.lit("\n"))), "")
    head = F.format_string("Submodule commits %s (%s..%s):\n", F.col("path"), F.substring("old", 1, 7), F.substring("new", 1, 7))
    return moves.join(lines, "path").select("path", F.concat(head, shown).alias("text"))


def submodule_only(paths: DataFrame, submodules: DataFrame) -> bool:
    """Whether all changed paths are submodules, and there are some."""
    return not submodules.isEmpty() and not paths.isEmpty() and paths.join(submodules.select("path"), "path", "left_anti").isEmpty()


def repository_summary(refs: DataFrame, remotes: dict[str, str], root: str, kind: str = "repository") -> DataFrame:
    """One row: root, head, whether it is detached, remotes and kind."""
    head = refs.where("name = 'HEAD'").select("target", "hash")
    names = F.create_map(*(F.lit(x) for kv in sorted(remotes.items()) for x in kv)) if remotes else F.create_map().cast("map<string,string>")
    return head.select(F.lit(root).alias("root"), F.coalesce(F.regexp_replace("target", "^refs/heads/", ""), "hash").alias("head"), F.col("target").isNull().alias("detached"), names.alias("remotes"), F.lit(kind).alias("kind"))


def commit_text(commits: DataFrame) -> DataFrame:
    """A commit's header and message as text (M06): sha, text."""
    when = F.date_format("author_time", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return commits.select("sha", F.format_string("commit %s\nAuthor: %s <%s>\nDate: %s\n\n%s\n", F.col("sha"), F.col("author"), F.col("email"), when, T.stripped(F.col("message"))).alias("text"))


def recent(commits: DataFrame, edges: DataFrame, head: DataFrame, most: int = 10, touched: DataFrame | None = None) -> DataFrame:
    """The last commits, on request of those that touch a path (M18, L11). ``touched``: sha."""
    from .history import log

    kept = commits if touched is None else commits.join(touched.select("sha").distinct(), "sha", "left_semi")
    return log(kept, edges, head, limit=most)


def prepared(view: View, previous: View | None = None, allow_empty: bool = False, most_bytes: int = 48 << 10, most_lines: int = 1200) -> dict[str, DataFrame]:
    """What a message or a review is written from (M21, M23): overview, groups, outliers, stats, text, focus, fingerprint and the previous overview.

    A cut diff has a focus: the diff of the most changed paths that it doesn't show. An empty change is an error.
    """
    if not allow_empty and view.changes.isEmpty():
        raise ValueError("there is no change")
    facts = graph.written(view.facts())
    groups = graph.written(changes.groups(facts))
    out = {"overview": changes.overview(facts), "groups": groups.where("not outlier"), "outliers": groups.where("outlier"), "stats": view.stats(), "text": view.text(most_bytes, most_lines), "fingerprint": view.fingerprint()}
    text, cut = out["text"].first() or ("", False)
    if cut and generated_heavy(out["overview"]).isEmpty():
        out["focus"] = view.for_paths(focus_paths(facts, text)).text(64 << 10, 1600)
    if not out["outliers"].isEmpty() and cut:
        out["outlier_text"] = view.for_paths(out["outliers"].select(F.explode("samples").alias("path"))).text(most_bytes, most_lines)
    if previous is not None:
        out["previous"] = changes.overview(previous.facts())
    return out
