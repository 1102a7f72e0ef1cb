"""Reports: release documents, reviews, checks, answers and messages, their rules and their text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import vectors as V
from ..functions import web as W
from . import history, messages, validate

#: Section headings, characters of a bullet and of a child.
SECTIONS, BULLET, CHILD = ("Breaking Changes", "Security", "New Features", "Improvements", "Bug Fixes"), 160, 140
#: Aspects of simplifications, diagnostics of a result, bytes of messages, codes, reasons and errors.
ASPECTS = ("reuse", "clarity", "efficiency")
DIAGNOSTICS, MESSAGE, CODE, REASON, ERROR = 100, 512, 128, 512, 1024
#: Files of guidance by family, the first of a directory wins.
GUIDANCE = {"agents": ("AGENTS.override.md", "AGENTS.md"), "claude": ("CLAUDE.md",)}
#: Arguments that diagnostics of failures show, bytes of such a summary.
SAFE_ARGUMENTS = ("path", "paths", "source", "line_start", "line_end", "offset", "limit", "max_bytes", "max_lines", "max_matches", "glob", "type")
SUMMARY_BYTES = 4096

REFS = "array<struct<type:string,value:string,url:string>>"
BULLETS = f"array<struct<label:string,summary:string,refs:{REFS},children:array<struct<summary:string,refs:{REFS}>>>>"
DOCUMENT = f"struct<sections:array<struct<heading:string,bullets:{BULLETS}>>>"


def _all(*arrays: Column) -> Column:
    return F.array_compact(F.flatten(F.array(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))))


def _if(broken: Column, text: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(text))


def blank(c: Column) -> Column:
    return T.stripped(F.coalesce(c, F.lit(""))) == ""


def ref_errors(refs: Column) -> Column:
    """Errors of references: repeated ones, and values that aren't of their type."""
    keys = F.transform(refs, lambda r: F.concat_ws(":", r["type"], r["value"]))
    bad = lambda r: F.when(r["type"] == "commit", F.when(~validate.is_commit_sha(F.trim(r["value"])), "invalid commit ref")).when(r["type"].isin("pr", "issue"), F.when(~F.trim(r["value"]).rlike("^[0-9]+$"), "invalid number ref")).otherwise("invalid ref type")
    return _all(F.array(_if(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate ref")), F.transform(refs, bad))


def _line_errors(summary: Column, refs: Column, most: int, what: str) -> Column:
    return _all(
        F.array(_if(blank(summary), f"{what} is empty"), _if(summary.contains("```"), f"{what} contains a code fence"), _if(history.low_signal(summary), f"{what} has a low-signal clause"),
                _if(F.char_length(T.stripped(summary)) > most, f"{what} is too long")), ref_errors(refs))


def document_errors(document: Column) -> Column:
    """Errors of a release document's narrative (V05): sections, headings, bullets, children and references."""
    sections = document["sections"]
    heads = F.transform(sections, lambda s: s["heading"])
    child = lambda c: _line_errors(c["summary"], c["refs"], CHILD, "child")
    bullet = lambda b: _all(
        F.array(_if((b["label"] != "") & blank(b["label"]), "blank label"), _if(F.size(F.coalesce(b["refs"], F.array().cast(REFS))) == 0, "bullet has no refs")),
        _line_errors(b["summary"], b["refs"], BULLET, "bullet"), F.flatten(F.transform(F.coalesce(b["children"], F.array().cast(f"array<struct<summary:string,refs:{REFS}>>")), child)))
    section = lambda s: _all(
        F.array(_if(blank(s["heading"]), "section heading is empty"), _if(~s["heading"].isin(*SECTIONS), "forbidden section heading"), _if(F.coalesce(F.size(s["bullets"]), F.lit(0)) < 1, "section has no bullets")),
        F.flatten(F.transform(s["bullets"], bullet)))
    return _all(
        F.array(_if(document.isNull() | sections.isNull(), "not a document"), _if(F.size(sections) == 0, "no sections"), _if(F.size(F.array_distinct(heads)) < F.size(heads), "duplicate section heading")),
        F.flatten(F.transform(sections, section)))


def changelog_errors(document: DataFrame, required: DataFrame) -> DataFrame:
    """Submodules that a rendered changelog must name and doesn't (V05, M24): path, error. Rows of ``document``: path, entries."""
    return required.select("path").join(document.select("path"), "path", "left_anti").withColumn("error", F.lit("missing submodule full changelog group"))


def _refs(refs: Column) -> Column:
    shown = F.transform(F.coalesce(refs, F.array().cast(REFS)), lambda r: F.when(r["type"] == "commit", F.when(F.coalesce(r["url"], F.lit("")) != "", r["url"]).otherwise(F.substring(F.trim(r["value"]), 1, 7))).when(r["type"].isin("pr", "issue"), F.concat(F.lit("#"), F.trim(r["value"]))))
    text = F.array_join(shown, ", ")
    return F.when(text != "", F.concat(F.lit(" ("), text, F.lit(")"))).otherwise("")


def _entry(e: Column) -> Column:
    short = F.substring(F.trim(e["sha"]), 1, 7)
    return F.concat(F.when(F.coalesce(e["url"], F.lit("")) != "", F.concat(F.lit("["), short, F.lit("]("), e["url"], F.lit(")"))).otherwise(short), F.lit(" "), e["summary"])


def release_markdown(document: Column, changelog: Column, submodules: Column) -> Column:
    """A release document as Markdown (A56): sections with bullets and children, then the full changelog.

    ``changelog``: array of (sha, summary, url); ``submodules``: array of (heading, entries).
    """
    child = lambda c: F.concat(F.lit("  - "), T.stripped(c["summary"]), _refs(c["refs"]))
    label = lambda b: F.when(~blank(b["label"]), F.concat(F.lit("**"), T.stripped(b["label"]), F.lit("**: "))).otherwise("")
    bullet = lambda b: F.concat(F.array(F.concat(F.lit("- "), label(b), T.stripped(b["summary"]), _refs(b["refs"]))), F.transform(F.coalesce(b["children"], F.array().cast(f"array<struct<summary:string,refs:{REFS}>>")), child))
    told = F.filter(document["sections"], lambda s: F.size(s["bullets"]) > 0)
    narrative = F.transform(told, lambda s: F.concat(F.lit("### "), s["heading"], F.lit("\n\n"), F.array_join(F.flatten(F.transform(s["bullets"], bullet)), "\n")))
    entries = F.transform(changelog, lambda e: F.concat(F.lit("- "), _entry(e)))
    groups = F.transform(submodules, lambda s: F.array_join(F.array(s["heading"], F.lit(""), F.array_join(F.transform(s["entries"], lambda e: F.concat(F.lit("  - "), _entry(e))), "\n")), "\n"))
    rest = F.concat(F.array(F.rtrim(F.concat(F.lit("### Full Changelog\n\n"), F.array_join(entries, "\n")))), groups)
    has = (F.size(changelog) > 0) | (F.size(submodules) > 0)
    whole = F.concat(narrative, F.when(has, rest).otherwise(F.array().cast("array<string>")))
    return T.stripped(F.regexp_replace(F.array_join(whole, "\n\n"), "\n{3,}", "\n\n"))


def release_documents(rows: DataFrame, urls: DataFrame, recommended: list[str], changelog: str = "changelog", submodules: str = "submodules") -> DataFrame:
    """Release documents from their JSON (M24): id, document, errors, markdown.

    Rows: id, json, changelog, submodules. References of commits get addresses, by whole id or a
    unique prefix (C26); sections come in the recommended order, then as they came (F07).
    """
    parsed = rows.withColumn("document", F.from_json("json", DOCUMENT))
    asked = parsed.select(F.explode(F.transform(F.flatten(F.transform("document.sections", lambda s: F.flatten(F.transform(s["bullets"], lambda b: F.concat(b["refs"], F.flatten(F.transform(F.coalesce(b["children"], F.array().cast(f"array<struct<summary:string,refs:{REFS}>>")), lambda c: c["refs"]))))))), lambda r: F.when(r["type"] == "commit", r["value"]))).alias("ref"))
    known = history.resolved_refs(asked.where("ref is not null").distinct(), urls).where("url is not null")
    of_id = parsed.select("id", F.explode(F.split(F.regexp_replace("json", r"[^0-9A-Fa-f]+", " "), " ")).alias("ref")).distinct().join(known, "ref").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("ref", "url"))).alias("u"))
    place = F.array(*map(F.lit, [r.removeprefix("### ") for r in recommended])) if recommended else F.array().cast("array<string>")
    rank = lambda h: F.when(F.array_position(place, h) > 0, F.array_position(place, h)).otherwise(1 << 20)
    address = lambda r, u: F.struct(r["type"].alias("type"), r["value"].alias("value"), F.coalesce(F.when(r["type"] == "commit", F.try_element_at(u, r["value"])), r["url"]).alias("url"))
    told = parsed.join(of_id, "id", "left").withColumn("u", F.coalesce("u", F.create_map().cast("map<string,string>")))
    u = F.col("u")
    linked = F.transform("document.sections", lambda s, i: F.struct(rank(s["heading"]).alias("rank"), i.alias("i"), F.struct(s["heading"].alias("heading"), F.transform(s["bullets"], lambda b: b.withField("refs", F.transform(b["refs"], lambda r: address(r, u))).withField("children", F.transform(b["children"], lambda c: c.withField("refs", F.transform(c["refs"], lambda r: address(r, u)))))).alias("bullets")).alias("s")))
    ordered = F.struct(F.transform(F.array_sort(linked), lambda x: x["s"]).alias("sections"))
    out = told.withColumn("errors", document_errors(F.col("document"))).withColumn("document", ordered)
    return out.select("id", "document", "errors", F.when(F.size("errors") == 0, release_markdown(F.col("document"), F.col(changelog), F.col(submodules))).alias("markdown"))


def item_errors(title: Column, detail: Column, proposal: Column, evidences: Column) -> Column:
    """Errors of a finding or a simplification (V02, V03, V04): fields, evidence paths and lines."""
    of = lambda e: F.array(_if(blank(e["title"]), "evidence title is required"), _if(~P.is_safe(F.coalesce(e["path"], F.lit(""))), "evidence path must be repository-relative"), _if((e["line_start"] < 1) | (e["line_end"] < e["line_start"]), "invalid line range"))
    return _all(
        F.array(_if(blank(title), "title is required"), _if(blank(detail), "detail is required"), _if(blank(proposal), "proposal is required"), _if(F.coalesce(F.size(evidences), F.lit(0)) < 1, "evidence is required")),
        F.flatten(F.transform(evidences, of)))


def simplify_errors(summary: Column, opportunities: Column) -> Column:
    """Errors of a simplification report."""
    one = lambda o: _all(F.array(_if(~o["aspect"].isin(*ASPECTS), "aspect is invalid")), item_errors(o["title"], o["body"], o["proposed_change"], o["evidences"]))
    return _all(F.array(_if(blank(summary), "summary is required"), _if(opportunities.isNull(), "opportunities must be an array")), F.flatten(F.transform(opportunities, one)))


def clean_path(path: Column) -> Column:
    """A repository's path with forward slashes; null if it is empty or absolute or leaves the root."""
    slashes = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+", "/")
    start = F.array().cast("array<string>")
    steps = F.aggregate(F.split(slashes, "/"), start, lambda s, p: (
        F.when(p.isin("", "."), s).when((p == "..") & (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1)) != ".."), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p))))
    out = F.array_join(steps, "/")
    return F.when(~slashes.startswith("/") & (out != "") & ~out.rlike(r"^\.\.(/|$)") & (F.instr(out, "\0") == 0), out)


def tool_path(path: Column) -> Column:
    """The same for tools, where nothing means the root."""
    return F.when(T.stripped(F.coalesce(path, F.lit(""))).isin("", "."), ".").otherwise(clean_path(path))


def normalised_diagnostics(rows: DataFrame) -> DataFrame:
    """Diagnostics with clean paths and single lines, and errors of those that can't be."""
    path = clean_path(F.col("path"))
    out = rows.withColumns({
        "path": F.coalesce(path, "path"), "code": T.single_line_bytes(F.coalesce("code", F.lit("")), CODE), "message": T.single_line_bytes(F.coalesce("message", F.lit("")), MESSAGE),
        "errors": F.array_compact(F.array(_if(path.isNull(), "path must be repository-relative"), _if(F.col("line") < 1, "line must be positive"), _if(F.col("column") < 0, "column must not be negative"),
                                          _if((F.col("code") != "") & blank(F.col("code")), "code must be nonempty when present"), _if(blank(F.col("message")), "message is required")))})
    return out


def linter_issues(rows: DataFrame, scope: DataFrame, module: str = "") -> DataFrame:
    """A linter's issues as diagnostics of files in scope (M53). Rows: file, line, column, linter, text, with files below the module."""
    path = clean_path(F.concat(F.lit(f"{module}/" if module else ""), F.col("file")))
    out = rows.select(path.alias("path"), "line", F.coalesce("column", F.lit(0)).alias("column"), F.col("linter").alias("code"), F.col("text").alias("message"))
    good = normalised_diagnostics(out.where("path is not null")).where(F.size("errors") == 0).drop("errors")
    return good.join(scope.select("path").distinct(), "path", "left_semi").distinct()


def check_result_errors(r: Column) -> Column:
    """Errors of a check's result (V08): name, order, and fields that don't go with its status."""
    d, said = r["diagnostics"], lambda c: F.coalesce(c, F.lit("")) != ""
    n, omitted = F.coalesce(F.size(d), F.lit(0)), F.coalesce(r["omitted"], F.lit(0))
    ordered = F.array_sort(F.array_distinct(F.transform(d, lambda x: F.struct(x["path"], x["line"], F.coalesce(x["column"], F.lit(0)), F.coalesce(x["code"], F.lit("")), x["message"]))))
    same = F.transform(d, lambda x: F.struct(x["path"], x["line"], F.coalesce(x["column"], F.lit(0)), F.coalesce(x["code"], F.lit("")), x["message"]))
    plain = lambda c, most: c == T.single_line_bytes(c, most)
    return F.array_compact(F.array(
        _if(~r["name"].rlike(r"^[a-z0-9][a-z0-9._-]{0,63}$"), "invalid checker name"), _if(d.isNull(), "diagnostics must be an array"), _if(n > DIAGNOSTICS, "too many diagnostics"),
        _if(~ordered.eqNullSafe(same) & d.isNotNull(), "diagnostics must be strictly ordered and unique"),
        _if(F.exists(d, lambda x: clean_path(x["path"]).isNull() | (clean_path(x["path"]) != x["path"]) | (x["line"] < 1) | (F.coalesce(x["column"], F.lit(0)) < 0) | blank(x["message"]) | ~plain(x["message"], MESSAGE)), "diagnostic isn't normalised"),
        _if(~r["status"].isin("pass", "findings", "skipped", "error"), "unsupported status"),
        _if((r["status"] == "pass") & ((n > 0) | (omitted != 0) | said(r["reason"]) | said(r["error"])), "pass result contains inapplicable fields"),
        _if((r["status"] == "findings") & (n == 0) & (omitted == 0), "findings result requires diagnostics or an omitted count"),
        _if((r["status"] == "findings") & ((omitted < 0) | said(r["reason"]) | said(r["error"])), "findings result contains invalid fields"),
        _if((r["status"] == "skipped") & ((n > 0) | (omitted != 0) | said(r["error"]) | ~said(r["reason"]) | ~plain(r["reason"], REASON)), "skipped result requires only a normalised reason"),
        _if((r["status"] == "error") & ((n > 0) | (omitted != 0) | said(r["reason"]) | ~said(r["error"]) | ~plain(r["error"], ERROR)), "error result requires only a normalised error")))


def outside_scope(results: DataFrame, scope: DataFrame) -> DataFrame:
    """Diagnostics of files that a check wasn't asked about (V08, M32): name, path."""
    return results.select("name", F.explode("diagnostics").alias("d")).select("name", F.col("d.path").alias("path")).distinct().join(scope.select("path"), "path", "left_anti")


def check_scope(files: DataFrame, paths: DataFrame | None, components: list[str], ignore=None) -> DataFrame:
    """Files that checks look at: changed ones, or all that no rule ignores (M32): path, component.

    ``ignore`` is a set of ignore rules for a whole codebase.
    """
    kept = files if paths is None else files.join(paths.select("path").distinct(), "path", "left_semi")
    kept = kept if ignore is None or paths is not None else ignore.kept(kept)
    owner = F.lit("")
    for c in sorted(components, key=len):
        owner = F.when(F.col("path").startswith(f"{c}/"), c).otherwise(owner) if c else owner
    return kept.select("path", owner.alias("component"))


def module_roots(files: DataFrame) -> DataFrame:
    """Folders with a module file (M54): root."""
    return files.where(P.base(F.col("path")) == "go.mod").select(F.regexp_replace(P.directory(F.col("path")), r"^\.$", "").alias("root")).distinct().orderBy("root")


def affected_packages(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct module and package of changed source files (D30, M54): root, package."""
    from ..plans.graph import nearest_ancestor

    go = paths.where(F.col("path").endswith(".go")).select("path")
    found = nearest_ancestor(go, roots)
    inner = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    return found.select("root", F.when(P.directory(inner) == ".", ".").otherwise(F.concat(F.lit("./"), P.directory(inner))).alias("package")).distinct().orderBy("root", "package")


def final_reports(reports: DataFrame, checks: DataFrame) -> DataFrame:
    """Reviews with their checks, and errors of both (V09): id, summary, recommendation, findings, checks, errors.

    ``reports``: id, summary, recommendation, findings, errors; ``checks``: id, result.
    """
    of = checks.groupBy("id").agg(F.array_sort(F.collect_list("result")).alias("checks"), F.flatten(F.collect_list(check_result_errors(F.col("result")))).alias("_e"), (F.count_distinct("result.name") < F.count("*")).alias("_twice"))
    out = reports.join(of, "id", "left")
    return out.withColumn("errors", _all(F.col("errors"), F.col("_e"), F.array(_if(F.col("checks").isNull(), "checks must be an array"), _if(F.col("_twice"), "duplicate check")))).drop("_e", "_twice")


def leaves(rows: DataFrame, schema: str, names: list[str], json_: str = "json") -> DataFrame:
    """Leaf reports decoded strictly, and as canonical JSON (M34): value, errors, canonical."""
    return messages.strict_json(rows, json_, schema, names).withColumn("canonical", F.when(F.size("errors") == 0, W.canonical_json(F.col(json_))))


def answers(rows: DataFrame, json_: str = "json") -> DataFrame:
    """Answers by item with their errors (M35): batch, item_id, items, errors. Repeated ids, and items without text or references, are errors."""
    schema = "struct<answers:array<struct<item_id:string,items:array<struct<description:string,references:array<string>>>>>>"
    each = rows.select("batch", F.explode(F.from_json(json_, schema)["answers"]).alias("a")).select("batch", "a.item_id", "a.items")
    one = lambda i: F.array(_if(blank(i["description"]), "description is required"), _if(F.coalesce(F.size(i["references"]), F.lit(0)) < 1, "reference is required"), _if(F.exists(i["references"], blank), "reference is empty"))
    twice = F.count("*").over(Window.partitionBy("batch", "item_id")) > 1
    return each.withColumn("errors", _all(F.array(_if(twice, "duplicate answer"), _if(F.coalesce(F.size("items"), F.lit(0)) < 1, "item is required")), F.flatten(F.transform("items", one))))


def call_errors(items: DataFrame) -> DataFrame:
    """Repeated calls, and outputs without a call before them or after another (M36): thread, ord, error. Rows: thread, ord, type, call_id, name."""
    w = Window.partitionBy("thread", "call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda kind: F.coalesce(F.count_if(F.col("type") == kind).over(w), F.lit(0))
    call, output = F.col("type") == "function_call", F.col("type") == "function_call_output"
    told = items.withColumns({"_c": before("function_call"), "_o": before("function_call_output")})
    error = F.when(call & (F.col("_c") > 0), "duplicate call").when(output & (F.col("_c") == 0), "output without a call").when(output & (F.col("_o") > 0), "duplicate output")
    return told.select("thread", "ord", error.alias("error")).where("error is not null")


def completed_calls(items: DataFrame, reason: str = "tool call was not executed because the agent is finalizing without tools") -> DataFrame:
    """Items with an error output after the last one for each call that has none (M36): thread, ord, type, call_id, name, content."""
    done = items.where("type = 'function_call_output'").select("thread", "call_id")
    open_ = items.where("type = 'function_call'").join(done, ["thread", "call_id"], "left_anti")
    last = items.groupBy("thread").agg(F.max("ord").alias("_last"))
    place = F.row_number().over(Window.partitionBy("thread").orderBy("ord"))
    content = F.to_json(F.struct(F.lit(False).alias("ok"), F.col("name").alias("tool"), F.lit(reason).alias("error")))
    made = open_.join(last, "thread").select("thread", (F.col("_last") + place).alias("ord"), F.lit("function_call_output").alias("type"), "call_id", "name", content.alias("content"))
    return items.unionByName(made.select(*items.columns))


def portable(items: DataFrame) -> DataFrame:
    """Items that another provider can take over."""
    return items.where(~F.col("type").isin("reasoning", "web_search_call"))


def responses(rows: DataFrame, json_: str = "json") -> DataFrame:
    """Completed responses as text, calls and usage (M56): id, text, calls, input_tokens, cached_input_tokens, output_tokens, reasoning_tokens, total_tokens."""
    schema = """struct<id:string,output:array<struct<type:string,id:string,call_id:string,name:string,arguments:string,status:string,content:array<struct<type:string,text:string>>>>,
      usage:struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint>,output_tokens_details:struct<reasoning_tokens:bigint>>>"""
    r = rows.withColumn("r", F.from_json(json_, schema))
    texts = F.flatten(F.transform(F.filter("r.output", lambda o: o["type"] == "message"), lambda o: F.transform(F.filter(o["content"], lambda c: c["type"] == "output_text"), lambda c: c["text"])))
    calls = F.transform(F.filter("r.output", lambda o: o["type"] == "function_call"), lambda o: F.struct(o["id"].alias("id"), o["call_id"].alias("call_id"), o["name"].alias("name"), o["arguments"].alias("arguments")))
    hosted = F.size(F.filter("r.output", lambda o: o["type"].endswith("_call") & (o["type"] != "function_call")))
    zero = lambda c: F.coalesce(F.col(f"r.usage.{c}"), F.lit(0))
    return r.select(F.col("r.id").alias("id"), F.array_join(texts, "").alias("text"), calls.alias("calls"), hosted.alias("hosted_calls"), zero("input_tokens").alias("input_tokens"), zero("input_tokens_details.cached_tokens").alias("cached_input_tokens"),
                    zero("output_tokens").alias("output_tokens"), zero("output_tokens_details.reasoning_tokens").alias("reasoning_tokens"), zero("total_tokens").alias("total_tokens"))


def payload_identity(payload: Column) -> Column:
    """What diagnostics of failures keep of a tool's payload (M38): bytes, SHA-256, known arguments, sorted keys of its data."""
    v = F.try_parse_json(payload)
    known = F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: k.isin(*SAFE_ARGUMENTS))
    data = F.array_sort(F.json_object_keys(F.try_variant_get(v, "$.data", "string")))
    return F.struct(F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("sha256"), known.alias("arguments"),
                    F.try_variant_get(v, "$.ok", "boolean").alias("ok"), F.try_variant_get(v, "$.tool", "string").alias("tool"), W.limited(F.try_variant_get(v, "$.error", "string"), 256, 1).alias("error"), data.alias("data_keys"))


def guidance(targets: DataFrame, files: DataFrame, family: str = "auto") -> DataFrame:
    """Guidance files for target paths (C22): path, text, family; root first, once each, in the order of the targets.

    Of each directory the first file of the family counts. ``auto`` takes the first family that any target has. Rows: ``targets`` ord, path.
    """
    if family not in ("auto", "none", *GUIDANCE):
        raise ValueError(f"unknown guidance family {family!r}")
    names = [(f, k, n) for f, all_ in GUIDANCE.items() for k, n in enumerate(all_)]
    dirs = targets.select("ord", F.posexplode(F.transform(P.ancestors(F.col("path")), lambda d: d)).alias("depth", "dir"))
    which = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(k).alias("priority"), F.lit(n).alias("name")) for f, k, n in names)))
    asked = dirs.select("ord", "depth", "dir", which.alias("w")).select("ord", "depth", "dir", "w.*", F.when(F.col("dir") == "", F.col("w.name")).otherwise(F.concat_ws("/", "dir", "w.name")).alias("path"))
    found = asked.join(files.select("path", "text"), "path")
    first = found.groupBy("ord", "depth", "dir", "family").agg(F.min_by(F.struct("path", "text"), "priority").alias("r"))
    if family == "auto":
        best = found.agg(F.min(F.array_position(F.array(*map(F.lit, GUIDANCE)), F.col("family")))).first()[0]
        family = list(GUIDANCE)[best - 1] if best else "none"
    kept = first.where(F.col("family") == family).select("ord", "depth", "r.path", "r.text", "family")
    place = F.row_number().over(Window.partitionBy("path").orderBy("ord", "depth"))
    return kept.withColumn("_k", place).where("_k = 1").orderBy("ord", "depth").drop("_k")


def guidance_text(found: DataFrame, target: str) -> DataFrame:
    """Guidance as one text with a tag for each document (M49); one row, empty if there is none."""
    doc = F.concat(F.lit("<PROJECT_DOC path=\""), "path", F.lit("\">\n"), F.regexp_replace("text", "\n+$", ""), F.lit("\n</PROJECT_DOC>\n"))
    docs = found.agg(F.array_sort(F.collect_list(F.struct("ord", "depth", doc.alias("t")))).alias("d"))
    body = F.concat(F.lit(f"# AGENTS.md instructions for {target}\n\n<INSTRUCTIONS>\n"), F.array_join(F.transform("d", lambda x: x["t"]), "\n"), F.lit("</INSTRUCTIONS>"))
    return docs.select(F.when(F.size("d") > 0, body).otherwise("").alias("text"))


def message_style(recent: DataFrame) -> str:
    """The style of the first recent summary that has one."""
    s = F.trim("summary")
    got = recent.select("ord", F.when(T.is_conventional(s), "conventional").when(T.is_title_case(s), "title").alias("style")).where("style is not null")
    row = got.agg(F.min_by("style", "ord")).first()
    return row[0] or "conventional"


def submodule_subject(style: str, paths: Column) -> Column:
    """The subject of a commit that only moves submodules."""
    n = F.size(paths)
    target = F.when((n == 0) | (n > 3), "submodules").when(n == 1, F.concat(F.get(paths, 0), F.lit(" submodule"))).otherwise(F.concat(T.human_list(paths), F.lit(" submodules")))
    return F.concat(F.lit("Update " if style == "title" else "chore(deps): update "), target)


def submodule_body(submodules: Column) -> Column:
    """A heading and commits for each moved submodule (I23). An array of (path, old, new, available, commits of (sha, summary)), in path order."""
    told = lambda s: F.filter(s["commits"], lambda c: ~blank(c["summary"]))
    line = lambda c: F.concat(F.lit("  - "), F.when(blank(c["sha"]), "").otherwise(F.concat(F.substring(F.trim(c["sha"]), 1, 7), F.lit(": "))), T.stripped(c["summary"]))
    part = lambda s: F.array_join(F.concat(F.array(s["path"]), F.transform(told(s), line)), "\n")
    return F.array_join(F.transform(F.array_sort(F.filter(submodules, lambda s: ~blank(s["path"]))), part), "\n\n")


#: Ends of a subject that goes on in the next line.
CONNECTORS = (" and", " or", " to", " for", " with", " across", ",")


def shaped(output: Column) -> Column:
    """A message with its subject on one line and its body wrapped.

    The lines of the first paragraph are one subject if the first ends with a connector, or is
    conventional, of 50 bytes or more, and the second begins in lower case.
    """
    whole = T.stripped(output)
    first, rest = F.split_part(whole, F.lit("\n\n"), F.lit(1)), F.regexp_replace(F.regexp_replace(whole, r"(?s)^(.*?)(\n\n|\z)", "\u0001"), "^\u0001", "")
    lines = F.transform(F.split(first, "\n"), lambda l: T.stripped(l))
    head, second = F.get(lines, 0), F.coalesce(F.get(lines, 1), F.lit(""))
    ends = F.lit(False)
    for c in CONNECTORS:
        ends = ends | head.endswith(c)
    long = (F.octet_length(head) >= 50) & T.is_conventional(head) & second.rlike("^[a-z]")
    joined = (F.size(lines) > 1) & (ends | long)
    subject = F.when(joined, F.array_join(F.filter(lines, lambda l: l != ""), " ")).otherwise(head)
    body = F.when(joined, T.stripped(rest)).otherwise(T.stripped(F.regexp_replace(whole, r"(?s)^[^\n]*(\n|\z)", "")))
    return F.when(body == "", subject).otherwise(F.concat(subject, F.lit("\n\n"), messages.wrapped(body, 72)))


def brief_summary(symbol: Column, excerpt: Column) -> Column:
    """A symbol's name, else the first line of an excerpt without its number."""
    first = F.coalesce(F.get(F.filter(F.transform(F.split(excerpt, "\n"), lambda l: T.stripped(l)), lambda l: l != ""), 0), F.lit(""))
    return F.when(F.coalesce(symbol, F.lit("")) != "", symbol).otherwise(F.trim(F.regexp_replace(first, r"^[+-]?\d+: ", "")))


def sanitised_prompt(text: Column) -> Column:
    """A prompt for traces (I35): without the tag lines around it and angle brackets, white space collapsed in each line."""
    wrapper = r"[ \t]*</?[A-Za-z][^<>\n]*>[ \t]*"
    bare = F.regexp_replace(F.regexp_replace(text, rf"\A({wrapper}(\n|\z))+", ""), rf"((\A|\n){wrapper})+\z", "")
    lines = F.transform(F.split(bare, "\n"), lambda l: F.trim(F.regexp_replace(F.translate(l, "<>", "  "), r"\s+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\A\n+|\n+\z", "")


def pointed(files: DataFrame, pointer: str, most_bytes: int = 16 << 10, most_lines: int = 400, text: str = "text") -> DataFrame:
    """A JSON tool's answer for a pointer (I61): path, pointer, value_kind, value_bytes, value or value_preview, truncated."""
    from .readq import pointer as at

    value = at(F.col(text), pointer)
    schema = F.schema_of_variant(F.try_parse_json(value))
    kind = F.when(value.isNull(), "null").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "BOOLEAN", "boolean").when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("string")
    size, lines = F.octet_length(value), T.line_count(value)
    cut = (size > most_bytes) | (lines > most_lines)
    return files.select("path", F.lit(pointer).alias("pointer"), kind.alias("value_kind"), size.cast("long").alias("value_bytes"), lines.cast("long").alias("value_lines"),
                        F.when(~cut, value).alias("value"), F.when(cut, W.limited(value, most_bytes, most_lines)).alias("value_preview"), cut.alias("truncated"))


def _expanded(value):
    if isinstance(value, dict):
        return {k: _expanded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_expanded(v) for v in value]
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            return _expanded(json.loads(value))
        except ValueError:
            return value
    return value


def _flat(value, prefix: str = "") -> Iterator[tuple[str, object]]:
    if isinstance(value, dict) and value:
        for k in sorted(value):
            yield from _flat(value[k], f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from _flat(v, f"{prefix}[{i}]")
    else:
        yield prefix, value


def _on_json(column: Column, f) -> Column:
    """A function of decoded JSON on batches of texts; text that isn't JSON stays."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else f(json.loads(text))
        except ValueError:
            return text

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(one)

    return run(column)


def expanded_json(value: Column) -> Column:
    """JSON whose strings that hold objects or arrays are expanded, at any depth (I64)."""
    return _on_json(value, lambda v: json.dumps(_expanded(v), separators=(",", ":"), ensure_ascii=False))


def console_line(at: Column, kind: Column, value: Column, preview: int = 120) -> Column:
    """An event as one line of key=value, nested keys with dots and long values cut."""

    def shown(v) -> str:
        text = v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
        text = " ".join(text.split())
        text = text if len(text) <= preview else text[:preview] + "..."
        return json.dumps(text, ensure_ascii=False) if isinstance(v, str) and (not text or " " in text or '"' in text) else text

    fields = _on_json(value, lambda v: " ".join(f"{k}={shown(x)}" if k else shown(x) for k, x in _flat(_expanded(v))))
    return F.concat_ws(" ", F.date_format(at, "HH:mm:ss.SSS"), kind, fields)


def inspection_markdown(payload: Column) -> Column:
    """A session's report as Markdown (A55): session, usage, skills, tool calls, branches, summary, findings.

    A struct of session (map of fields), usage (map), skills, tools (name, count), branches (id, fields), summary,
    recommendation and findings (severity, title, impact, proposed_fix, evidences).
    """
    field = lambda name, v: F.concat(F.lit("- **"), T.markdown(name), F.lit("**: "), T.code_span(v))
    fields = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter(m, lambda _, v: F.coalesce(v, F.lit("")) != ""))), lambda e: field(e["key"], e["value"])), "\n")
    some = lambda items, text: F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(text, "\n")).otherwise("None")
    place = lambda e: F.concat(F.lit("  - "), T.markdown(e["title"]), F.lit(": "), T.code_span(F.format_string("%s:%d-%d", e["path"], e["line_start"], e["line_end"])))
    finding = lambda f: F.array_join(F.concat(F.array(F.concat(F.lit("### "), f["severity"], F.lit(": "), T.markdown(f["title"])), F.lit(""), T.markdown(f["impact"]), F.lit(""), F.concat(F.lit("Proposed fix: "), T.markdown(f["proposed_fix"])), F.lit("")), F.transform(f["evidences"], place)), "\n")
    parts = [
        F.lit("# Session report"), fields(payload["session"]), F.lit("## Usage"), fields(payload["usage"]), F.lit("## Used skills"), some(payload["skills"], F.transform(payload["skills"], lambda s: F.concat(F.lit("- "), T.markdown(s)))),
        F.lit("## Tool calls"), some(payload["tools"], F.transform(payload["tools"], lambda t: F.concat(F.lit("- "), T.markdown(t["name"]), F.lit(": "), t["count"].cast("string")))),
        F.concat(F.lit("## Branches ("), F.coalesce(F.size(payload["branches"]), F.lit(0)).cast("string"), F.lit(")")), some(payload["branches"], F.transform(payload["branches"], lambda b: F.concat(F.lit("### Branch "), T.code_span(b["id"]), F.lit("\n\n"), fields(b["fields"])))),
        F.when(~blank(payload["summary"]), F.concat(F.lit("## Summary\n\n"), T.markdown(payload["summary"]))), F.when(~blank(payload["recommendation"]), field(F.lit("Recommendation"), payload["recommendation"])),
        F.when(payload["findings"].isNull(), F.lit("## Report\n\nUnavailable")).otherwise(F.concat(F.lit("## Findings\n\n"), some(payload["findings"], F.transform(payload["findings"], finding))))]
    return F.concat(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n\n"), F.lit("\n"))


def embedded(rows: DataFrame, provider, text: str = "text", batch: int = 32) -> DataFrame:
    """Vectors of texts by a provider that takes batches (K02, K03): adds vector.

    A batch that fails is halved until single texts fail, whose error is the job's. Partitions run
    at once; rows keep their own vector, so there is no order to restore.
    """

    def tried(texts: list[str]) -> list:
        try:
            out = provider(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
            return list(out)
        except Exception:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return tried(texts[:half]) + tried(texts[half:])

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = b.fillna("").tolist()
            got = [v for i in range(0, len(texts), batch) for v in tried(texts[i : i + batch])]
            if len({len(v) for v in got}) > 1:
                raise ValueError("a provider gave vectors of several dimensions")
            yield pd.Series(got)

    return rows.withColumn("vector", run(F.col(text)))


class Registry:
    """Named tools with the members that their arguments may have (K04); a call is a row, its result an envelope."""

    def __init__(self) -> None:
        self.tools: dict[str, tuple[str, object]] = {}

    def register(self, name: str, arguments: str, run) -> None:
        """``arguments`` is the schema of the arguments, ``run`` a function of their column to (data, error, truncated)."""
        if name in self.tools:
            raise ValueError(f"tool {name!r} is registered already")
        self.tools[name] = arguments, run

    def definitions(self) -> list[tuple[str, str]]:
        return sorted((n, a) for n, (a, _) in self.tools.items())

    def results(self, calls: DataFrame) -> DataFrame:
        """Calls (name, arguments) with their result; an unknown name or bad arguments are errors of the row."""
        out = F.to_json(F.struct(F.lit(False).alias("ok"), F.col("name").alias("tool"), F.lit("unknown tool").alias("error")))
        for name, (schema, run) in self.tools.items():
            args = F.from_json("arguments", schema)
            data, error, truncated = run(args)
            error = F.when(args.isNull() | F.try_parse_json("arguments").isNull(), "arguments aren't JSON of the schema").otherwise(error)
            out = F.when(F.col("name") == name, messages.envelope(name, error.isNull(), data, error, truncated)).otherwise(out)
        return calls.withColumn("result", out)


def input_chunks(rows: DataFrame) -> DataFrame:
    """Chunks with the hash and size of what a provider gets for each."""
    text = messages.embedding_input(F.col("path"), F.col("symbol_type"), F.col("symbol"), F.col("body"))
    return rows.withColumns({"embedding_input_hash": V.input_hash(text), "embedding_input_bytes": F.octet_length(text).cast("long")})
