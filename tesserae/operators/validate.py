"""Row validators: arrays of errors, empty for good rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of severities, aspects of findings.
SEVERITY = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
ASPECTS = ("correctness", "security", "reliability", "performance", "maintainability", "tests", "style")


def errors(**rules: Column) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(name.replace("_", " "))) for name, broken in rules.items())))


# Phrases that are talk about a message and not one, and those of an amended message that tells what is new.
COMMENTARY = ("here is", "commit message:", "explanation:", "i would")
AMENDING = ("this amend", "in addition", "also")


def _contains(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def commit_message(message: Column, amend: bool = False) -> Column:
    """Errors of a commit message (V01); an amended one mustn't tell what is new in it. An empty one has no other error."""
    text = F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+|\s+$", "")
    lines, low = F.split(text, "\n"), F.lower(text)
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    full = text != ""
    return errors(
        empty_message=~full, code_fence=text.contains("```"), commentary=full & _contains(low, COMMENTARY), amend_phrase=full & F.lit(amend) & _contains(low, AMENDING),
        body_line_over_90_bytes=F.exists(body, lambda l: F.octet_length(l) > 90))


def amended_message(message: Column, original: Column) -> Column:
    """Errors of an amended message against the one before, whose subject must stay."""
    subject = lambda m: F.get(F.filter(F.transform(F.split(F.coalesce(m, F.lit("")), "\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")), lambda l: l != ""), 0)
    changed = subject(original).isNotNull() & ~subject(message).eqNullSafe(subject(original))
    return F.concat(commit_message(message, amend=True), errors(subject_of_the_original_lost=changed))


def severity_rank(severity: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.try_element_at(known, severity)


def findings(rows: DataFrame, report: str = "report", order: str = "ord") -> DataFrame:
    """Errors of report findings (V02, E09): enums, order, style, evidence ranges."""
    rank = severity_rank(F.col("severity"))
    before = F.lag(rank).over(Window.partitionBy(report).orderBy(order))
    bad = errors(
        unknown_severity=rank.isNull(), unknown_aspect=~F.coalesce(F.col("aspect").isin(*ASPECTS), F.lit(False)), severity_rises=F.coalesce(before < rank, F.lit(False)),
        style_must_be_low=(F.col("aspect") == "style") & ~F.col("severity").eqNullSafe("LOW"), title_missing=F.trim(F.coalesce("title", F.lit(""))) == "",
        bad_line_range=(F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")))
    return rows.withColumn("errors", bad)


def recommendation(rows: DataFrame, report: str = "report") -> DataFrame:
    """What a report must recommend by its worst finding (D21, V02); a row without a severity stands for a report without findings."""
    worst = F.max(severity_rank(F.col("severity")))
    return rows.groupBy(report).agg(F.when(worst >= 3, "FIX").when(worst.isNotNull(), "COMMENT").otherwise("APPROVE").alias("recommendation"), F.count("severity").alias("findings"))


def wrong_recommendations(reports: DataFrame, rows: DataFrame, report: str = "report") -> DataFrame:
    """Reports that don't recommend what their findings call for (V02): report, recommendation, wanted."""
    want = recommendation(rows, report).select(report, F.col("recommendation").alias("wanted"))
    out = reports.select(report, "recommendation").join(want, report, "left").withColumn("wanted", F.coalesce("wanted", F.lit("APPROVE")))
    return out.where(F.col("recommendation") != F.col("wanted"))


def evidence(rows: DataFrame, files: DataFrame, synthetic: DataFrame | None = None, head: DataFrame | None = None) -> DataFrame:
    """Errors of evidence locations against line counts of files (V04): path, line_start, line_end, errors.

    A path that ``files`` lacks is looked up in ``head`` (path, lines), as deleted files are; one that neither has is right only
    as line 1 of a path of ``synthetic``, which stands for what isn't a file.
    """
    known = files.select("path", "lines")
    if head is not None:
        known = known.unionByName(head.select("path", "lines").join(files, "path", "left_anti"))
    made = (synthetic.select("path").distinct() if synthetic is not None else files.select("path").limit(0)).withColumn("_made", F.lit(True))
    stands_for = F.col("_made").isNotNull() & (F.col("line_start") == 1) & (F.col("line_end") == 1)
    return rows.join(known, "path", "left").join(made, "path", "left").withColumn("errors", errors(
        unknown_path=F.col("lines").isNull() & ~stands_for, line_end_past_the_file=F.coalesce(F.col("line_end") > F.col("lines"), F.lit(False)))).drop("lines", "_made")


def strictly_ascending(rows: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """Rows whose key isn't above the one before."""
    return rows.withColumn("_b", F.lag(key).over(Window.partitionBy(group).orderBy(order))).where(F.col(key) <= F.col("_b")).drop("_b")


def tool_batch(calls: DataFrame, allowed: list[str], batch: str = "batch", control: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Errors of tool calls (V13): repeated ids, unknown names, repeated calls, and more than one call of the control tool in a batch.

    ``seen``: call_id, name, arguments of earlier batches, which count as well.
    """
    same_id, same_call = (F.count("*").over(Window.partitionBy(batch, *c)) for c in (["call_id"], ["name", "arguments"]))
    controls = F.count_if(F.col("name").eqNullSafe(control) if control else F.lit(False)).over(Window.partitionBy(batch))
    out = calls.withColumns({"_i": same_id, "_c": same_call, "_n": controls, "_si": F.lit(None).cast("boolean"), "_sc": F.lit(None).cast("boolean")})
    if seen is not None:
        ids, sent = seen.select("call_id").distinct().withColumn("_a", F.lit(True)), seen.select("name", "arguments").distinct().withColumn("_b", F.lit(True))
        out = out.join(ids, "call_id", "left").join(sent, ["name", "arguments"], "left").withColumns({"_si": F.col("_a"), "_sc": F.col("_b")}).drop("_a", "_b")
    names = F.col("name").isin(*allowed) | F.col("name").eqNullSafe(control) if control else F.col("name").isin(*allowed)
    return out.withColumn("errors", errors(
        call_id_missing=F.coalesce("call_id", F.lit("")) == "", repeated_call_id=(F.col("_i") > 1) | F.col("_si").isNotNull(), unknown_tool=~F.coalesce(names, F.lit(False)),
        repeated_call=(F.col("_c") > 1) | F.col("_sc").isNotNull(), several_control_calls=F.col("_n") > 1)).drop("_i", "_c", "_n", "_si", "_sc").select(*calls.columns, "errors")


def is_commit_sha(value: Column) -> Column:
    """Seven or more hexadecimal digits."""
    return value.rlike("^[0-9A-Fa-f]{7,}$")


def is_object_id(value: Column, size: int = 40) -> Column:
    """Lower-case hexadecimal digits of a length."""
    return value.rlike(f"^[0-9a-f]{{{size}}}$")


#: The version of session records, and follow-ups of one at most.
SESSION, FOLLOW_UPS = 4, 3


def sessions(rows: DataFrame) -> DataFrame:
    """Errors of session records (V10): ids, depths and parents, and version, workspace and prompt key where there are such columns."""
    parents = rows.select(F.col("id").alias("parent_id"), F.col("depth").alias("_up"))
    joined = rows.join(parents, "parent_id", "left")
    more = {}
    if "version" in rows.columns:
        more["unsupported_version"] = ~F.col("version").eqNullSafe(SESSION)
    if "workspace" in rows.columns:
        more["workspace_missing"] = F.trim(F.coalesce("workspace", F.lit(""))) == ""
        more["workspace_not_clean"] = F.col("workspace").rlike(r"//|/$|(^|/)\.{1,2}(/|$)") & (F.col("workspace") != "/")
    if "prompt_cache_key" in rows.columns:
        more["prompt_key_missing"] = F.trim(F.coalesce("prompt_cache_key", F.lit(""))) == ""
    return joined.withColumn("errors", errors(
        bad_id=~F.col("id").rlike("^[A-Z2-7]{26}$"), root_has_depth=F.col("parent_id").isNull() & (F.col("depth") != 0),
        parent_missing=F.col("parent_id").isNotNull() & F.col("_up").isNull(), depth_not_parents_plus_one=F.coalesce(F.col("depth") != F.col("_up") + 1, F.lit(False)),
        depth_out_of_range=(F.col("depth") < 0) | (F.col("depth") > FOLLOW_UPS), **more)).drop("_up")
