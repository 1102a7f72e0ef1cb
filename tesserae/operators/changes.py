"""Change sets: joins of facts, groups, classes, budgets and tree deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import vectors as V

#: Least and most steps, least and most tool calls, base and verification steps.
BUDGETS = {"review": (8, 60, 6, 48, 6, 3), "simplify": (6, 45, 5, 36, 5, 2)}


def inventory(paths: DataFrame, status: DataFrame, stats: DataFrame) -> DataFrame:
    """Paths with status and counts, defaults where there are none."""
    return (
        paths.join(status, "path", "left").join(stats, "path", "left")
        .select("path", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("adds", F.lit(0)).alias("adds"),
                F.coalesce("deletes", F.lit(0)).alias("deletes"), F.coalesce("is_binary", F.lit(False)).alias("is_binary")))


def delta(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two sides, with both values."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    out = a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return out.withColumn("status", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified"))


def with_renames(changes: DataFrame) -> DataFrame:
    """Deleted and added rows of one blob as renames, paired in path order (C14): path, old_path, status."""
    place = lambda side: F.row_number().over(_by("blob", "path")).alias(side)
    gone = changes.where("status = 'deleted'").select(F.col("path").alias("old_path"), F.col("old").alias("blob"), "path").select("old_path", "blob", place("k"))
    come = changes.where("status = 'added'").select("path", F.col("new").alias("blob")).select("path", "blob", place("k"))
    moved = come.join(gone, ["blob", "k"]).select("path", "old_path", F.lit("renamed").alias("status"))
    rest = changes.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return moved.unionByName(rest.select("path", F.lit(None).cast("string").alias("old_path"), "status"))


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


def overview(facts: DataFrame) -> DataFrame:
    """One row: files, adds, deletes, generated files and the directory with most of them."""
    dirs = facts.groupBy(P.directory(F.col("path")).alias("dir")).count()
    dominant = dirs.agg(F.min_by("dir", F.struct(-F.col("count"), F.col("dir"))).alias("dominant_scope"), F.sum("count").alias("files"))
    sums = facts.agg(F.count("*").alias("files"), F.sum("adds").alias("adds"), F.sum("deletes").alias("deletes"), F.sum(F.col("generated").cast("long")).alias("generated_files"))
    return sums.join(dominant, "files")


def counts_by(facts: DataFrame, value: Column, name: str) -> DataFrame:
    """Rows by a value."""
    return facts.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def merged_counts(*tables: DataFrame, key: str) -> DataFrame:
    """Counts of several tables added."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.sum("n").alias("n"))


def groups(facts: DataFrame, outlier_size: int = 1, samples: int = 3) -> DataFrame:
    """Facts by status, mark, rule, directory and extension.

    A group's samples are its first, middle and most changed paths if it has more than
    ``samples``. In sets of over 20 facts groups of at most ``outlier_size`` are outliers.
    A group keeps arrays of its own members only; ``top_churn`` is pre-aggregated.
    """
    named = facts.withColumns({"dir": P.directory(F.col("path")), "extension": P.extension(F.col("path"))})
    keys = ["status", "generated", "rule", "dir", "extension"]
    churn = F.struct((-(F.col("adds") + F.col("deletes"))).alias("c"), "path")
    place = F.row_number().over(_window(keys, "path"))
    sized = named.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("adds").alias("adds"), F.sum("deletes").alias("deletes"), F.min(churn).alias("top"))
    middle = (
        named.select(*keys, "path", place.alias("k")).join(sized.select(*keys, "files"), keys)
        .where((F.col("k") == 1) | (F.col("k") == F.floor(F.col("files") / 2) + 1) | (F.col("files") <= samples))
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "path"))).alias("s")))
    total = facts.agg(F.count("*").alias("all")).first()["all"]
    top = F.col("top.path")
    few = F.transform("s", lambda x: x["path"])
    out = sized.join(middle, keys)
    match = F.when(F.col("dir") == ".", F.concat(F.lit("*"), F.col("extension"))).otherwise(F.concat(F.col("dir"), F.lit("/*"), F.col("extension")))
    return out.select(
        *keys, "files", "adds", "deletes", match.alias("match"),
        F.concat(F.lit("group_"), F.substring(F.sha2(F.concat_ws("|", match, F.col("status")), 256), 1, 12)).alias("id"),
        F.slice(F.array_distinct(F.when(F.col("files") <= samples, few).otherwise(F.concat(few, F.array(top)))), 1, samples).alias("samples"),
        top.alias("most_changed"), ((F.lit(total) > 20) & (F.col("files") <= outlier_size)).alias("outlier"))


def _window(keys: list[str], order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)


def top_churn(facts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The most changed paths of each group."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("adds") + F.col("deletes")), "path")
    return facts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def classified_diffstat(files: DataFrame, *keys: str) -> DataFrame:
    """Files by the first class that holds, and sums."""
    first = F.when(F.col("submodule"), "submodule")
    for c in ("build", "test", "docs", "generated", "dependency"):
        first = first.when(F.col(c), c)
    out = files.withColumn("_class", first)
    counts = [F.sum((F.col("_class") == c).cast("long")).alias(f"{c}_files") for c in ("submodule", "build", "test", "docs", "generated", "dependency")]
    return out.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), *(F.coalesce(c, F.lit(0)).alias(f"{n}_files") for c, n in zip(counts, ("submodule", "build", "test", "docs", "generated", "dependency"), strict=True)))


def operator_signals(files: DataFrame, *keys: str) -> DataFrame:
    """Whether all or any files of a change are of a class."""
    plain = ~(F.col("test") | F.col("docs") | F.col("generated") | F.col("dependency") | F.col("submodule") | F.col("build"))
    every = {"generated_only": F.col("generated"), "tests_only": F.col("test"), "dependency_only": F.col("dependency"), "submodule_only": F.col("submodule"),
             "build_only": F.col("build"), "internal_only": F.col("path").startswith("internal/") & plain}
    some = {"docs_changed": F.col("docs"), "cli_changed": F.col("cli"), "api_changed": F.col("api"), "config_schema_changed": F.col("config_schema"), "runtime_changed": plain}
    return files.groupBy(*keys).agg(*(F.bool_and(c).alias(n) for n, c in every.items()), *(F.bool_or(c).alias(n) for n, c in some.items()))


def narrative_policy(summary: Column) -> Column:
    """Why a change is left out of the narrative; null if it is told."""
    chore = F.lower(summary).rlike("^chore[(:]")
    return (
        F.when(F.col("submodule_only"), "submodule pointer update; use submodule commits as narrative evidence")
        .when(F.col("tests_only"), "tests only").when(F.col("build_only"), "build or CI files only")
        .when(F.col("generated_only") & ~F.col("config_schema_changed") & ~F.col("api_changed") & ~F.col("docs_changed"), "generated files only")
        .when(F.col("dependency_only"), "dependency metadata only").when(F.col("internal_only") & chore, "internal chore only"))


def section(summary: Column, message: Column) -> Column:
    """The release-note section of a commit."""
    low = F.lower(F.concat(summary, F.lit("\n"), message))
    return (
        F.when(low.contains("breaking") | low.contains("remove ") | low.contains("drop "), "Breaking Changes")
        .when(low.contains("security") | low.contains("cve"), "Security").when(low.rlike(r"^fix[(:]"), "Bug Fixes")
        .when(low.rlike(r"^feat[(:]"), "New Features").otherwise("Improvements"))


def budget_metrics(facts: DataFrame, *keys: str) -> DataFrame:
    """Effective lines and files, scopes and work units of change sets."""
    lines = F.col("adds") + F.col("deletes")
    scope = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")
    got = facts.groupBy(*keys).agg(
        F.sum(lines).alias("total"), F.sum(F.when(F.col("generated"), lines).otherwise(0)).alias("made"), F.count("*").alias("n"),
        F.sum(F.col("is_binary").cast("long")).alias("binary"), F.sum(F.col("generated").cast("long")).alias("gen"), F.count_distinct(scope).alias("scopes"))
    made = F.least("made", "total")
    gen = F.least(F.col("gen"), F.greatest(F.col("n") - F.col("binary"), F.lit(0)))
    hand = F.greatest(F.col("n") - gen - F.col("binary"), F.lit(0))
    got = got.select(
        *keys, (F.greatest(F.col("total") - made, F.lit(0)) + F.ceil(made * 0.15) + F.col("binary") * 50).cast("long").alias("effective_lines"),
        (hand + V.ceil_division(gen, 4) + F.col("binary")).cast("long").alias("effective_files"), "scopes")
    units = 2 * F.ceil(F.sqrt(F.col("effective_lines") / 50)) + F.ceil(F.sqrt("effective_files")) + F.ceil(F.log2(1 + F.greatest(F.col("scopes") - 1, F.lit(0)).cast("double")))
    return got.withColumn("work_units", units.cast("long"))


def budget_plan(metrics: DataFrame, kind: str, coverage: float) -> DataFrame:
    """Lower and upper steps, and steps and tool calls by depth."""
    low_cap, high_cap, tool_low, tool_high, base, check = BUDGETS[kind]
    bounded = lambda c, low: F.least(F.greatest(c, low), F.lit(high_cap)).cast("long")
    w = F.col("work_units")
    out = metrics.withColumn("lower_steps", bounded(base + F.ceil(0.5 * w * (1 + 0.25 * (1 - coverage))), F.lit(low_cap)))
    out = out.withColumn("upper_steps", bounded(base + F.ceil(w * (1 + 0.75 * (1 - coverage))) + check, F.col("lower_steps")))
    steps = {"fast": F.col("lower_steps"), "balanced": V.ceil_division(F.col("lower_steps") + F.col("upper_steps"), 2), "thorough": F.col("upper_steps")}
    for name, c in steps.items():
        out = out.withColumn(f"{name}_steps", c.cast("long"))
        out = out.withColumn(f"{name}_tools", F.least(F.greatest(F.lit(tool_low), V.ceil_division(4 * F.col(f"{name}_steps"), 5)), F.lit(tool_high)).cast("long"))
    return out


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """A hash of rows in any order: each row's digest of length-prefixed fields, combined by sum and count."""
    field = lambda c: F.concat(F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    digest = F.sha2(F.concat(*(field(c) for c in columns)), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.agg(F.sha2(F.concat_ws(":", part(0), part(1), part(2), part(3), F.count("*").cast("string")), 256).alias("fingerprint"))


def unique_diagnostics(rows: DataFrame, most: int = 100) -> DataFrame:
    """Distinct diagnostics in order, the first ones."""
    return rows.distinct().orderBy("path", "line", "column", "code", "message").limit(most)
