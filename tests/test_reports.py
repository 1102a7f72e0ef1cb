"""Rules and text of reports, messages, checks and chunks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import reports, retrieve, validate, views
from tesserae.sources import ignore


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


SHA = "0123456789abcdef0123456789abcdef01234567"


def document(**changed):
    bullet = {"label": "API", "summary": "adds x", "refs": [{"type": "commit", "value": SHA}, {"type": "pr", "value": "7"}], "children": [{"summary": "a child", "refs": []}]} | changed
    return json.dumps({"sections": [{"heading": "Bug Fixes", "bullets": [{"summary": "mends y", "refs": [{"type": "issue", "value": "3"}]}]}, {"heading": "New Features", "bullets": [bullet]}]})


def test_release_documents(spark):
    rows = [("good", document()), ("long", document(summary="x" * 161)), ("signal", document(summary="adds x, improving usability")), ("ref", document(refs=[{"type": "commit", "value": "zz"}])),
            ("none", document(refs=[])), ("twice", document(refs=[{"type": "pr", "value": "7"}] * 2)), ("child", document(children=[{"summary": "", "refs": []}])), ("bad", "{")]
    df = spark.createDataFrame(rows, "id string, json string").withColumns({
        "changelog": F.array(F.struct(F.lit(SHA).alias("sha"), F.lit("adds x").alias("summary"), F.lit(None).cast("string").alias("url"))),
        "submodules": F.array(F.struct(F.lit("#### lib").alias("heading"), F.array(F.struct(F.lit("f" * 40).alias("sha"), F.lit("inner").alias("summary"), F.lit("http://u").alias("url"))).alias("entries")))})
    urls = spark.createDataFrame([(SHA, "http://c/1")], "sha string, url string")
    got = {r.id: r for r in reports.release_documents(df, urls, ["### New Features", "### Bug Fixes"]).collect()}
    assert {k: r.errors for k, r in got.items()} == {
        "good": [], "long": ["bullet is too long"], "signal": ["bullet has a low-signal clause"], "ref": ["invalid commit ref"], "none": ["bullet has no refs"],
        "twice": ["duplicate ref"], "child": ["child is empty"], "bad": ["not a document"]}
    assert got["good"].markdown == (
        "### New Features\n\n- **API**: adds x (http://c/1, #7)\n  - a child\n\n### Bug Fixes\n\n- mends y (#3)\n\n"
        f"### Full Changelog\n\n- {SHA[:7]} adds x\n\n#### lib\n\n  - [fffffff](http://u) inner")
    assert got["bad"].markdown is None


def test_reviews_and_checks(spark):
    ev = [("t", "a.go", 1, 2)]
    schema = "summary string, o array<struct<aspect:string,title:string,body:string,proposed_change:string,evidences:array<struct<title:string,path:string,line_start:int,line_end:int>>>>"
    rows = [("s", [("reuse", "t", "b", "p", ev)]), ("", None), ("s", [("style", "t", "", "p", [("t", "/x", 2, 1)])]), ("s", [("reuse", "t", "b", "p", [])])]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(reports.simplify_errors(F.col("summary"), F.col("o"))).collect()]
    assert got == [[], ["summary is required", "opportunities must be an array"], ["aspect is invalid", "detail is required", "evidence path must be repository-relative", "invalid line range"], ["evidence is required"]]
    findings = spark.createDataFrame([("a", "LOW"), ("b", "HIGH"), ("b", "LOW"), ("c", None)], "report string, severity string")
    assert sorted(map(tuple, validate.recommendation(findings).collect())) == [("a", "COMMENT", 1), ("b", "FIX", 2), ("c", "APPROVE", 0)]
    given = spark.createDataFrame([("a", "COMMENT"), ("b", "APPROVE"), ("d", "APPROVE")], "report string, recommendation string")
    assert [r[:] for r in validate.wrong_recommendations(given, findings).collect()] == [("b", "APPROVE", "FIX")]
    d = [("a.go", 1, 0, "", "m")]
    result = "name string, status string, diagnostics array<struct<path:string,line:int,column:int,code:string,message:string>>, omitted int, reason string, error string"
    cases = [(("ok", "pass", [], 0, "", ""), []), (("ok", "findings", d, 0, "", ""), []), (("Bad", "pass", d, 0, "", ""), ["invalid checker name", "pass result contains inapplicable fields"]),
             (("x", "findings", d * 2, 0, "", ""), ["diagnostics must be strictly ordered and unique"]), (("x", "skipped", [], 0, "a  b", ""), ["skipped result requires only a normalised reason"]),
             (("x", "error", [], 0, "", "e"), []), (("x", "odd", None, 0, "", ""), ["diagnostics must be an array", "unsupported status"]), (("x", "findings", [("../a", 0, 0, "", " ")], 0, "", ""), ["diagnostic isn't normalised"])]
    df = spark.createDataFrame([c for c, _ in cases], result).select(F.struct("*").alias("r"))
    assert [r[0] for r in df.select(reports.check_result_errors(F.col("r"))).collect()] == [w for _, w in cases]
    checks = df.limit(2).select(F.lit("id").alias("id"), F.col("r").alias("result"))
    final = reports.final_reports(spark.createDataFrame([("id", "s", []), ("z", "s", ["e"])], "id string, summary string, errors array<string>"), checks)
    assert {r.id: r.errors for r in final.collect()} == {"id": ["duplicate check"], "z": ["e", "checks must be an array"]}


def test_paths_and_diagnostics(spark):
    assert values(spark, reports.clean_path, ["a//b/./c", "a/../b", "../a", "/a", "", ".", "a/../..", r"a\b"]) == ["a/b/c", "b", None, None, None, None, None, "a/b"]
    assert values(spark, reports.tool_path, ["", ".", "a/..", "x"]) == [".", ".", None, "x"]
    rows = spark.createDataFrame([("./m.go", 3, 0, "lint", " two\n words "), ("x.go", 0, 0, "", "m"), ("/x.go", 1, 0, "", "")], "file string, line int, column int, linter string, text string")
    scope = spark.createDataFrame([("mod/m.go",), ("mod/x.go",)], "path string")
    assert [r[:] for r in reports.linter_issues(rows, scope, "mod").collect()] == [("mod/m.go", 3, 0, "lint", "two words")]
    listed = spark.createDataFrame([("go.mod",), ("a/b/go.mod",), ("a/b/c/x.go",), ("y.go",), ("a/z.go",), ("a/b/w.go",)], "path string")
    assert [r.root for r in reports.module_roots(listed).collect()] == ["", "a/b"]
    assert [r[:] for r in reports.affected_packages(listed, reports.module_roots(listed)).collect()] == [("", "."), ("", "./a"), ("a/b", "."), ("a/b", "./c")]
    assert sorted(r[:] for r in reports.check_scope(listed, listed.limit(3), ["", "a"]).collect()) == [("a/b/c/x.go", "a"), ("a/b/go.mod", "a"), ("go.mod", "")]


def test_calls_and_answers(spark):
    schema = "thread string, ord int, type string, call_id string, name string, content string"
    items = spark.createDataFrame([("t", 0, "function_call", "1", "f", None), ("t", 1, "function_call", "2", "g", None), ("t", 2, "function_call_output", "1", None, "x"), ("t", 3, "function_call_output", "9", None, "x"), ("t", 4, "function_call_output", "1", None, "x"), ("t", 5, "function_call", "1", "f", None)], schema)
    assert sorted(r[1:] for r in reports.call_errors(items).collect()) == [(3, "output without a call"), (4, "duplicate output"), (5, "duplicate call")]
    done = reports.completed_calls(items.where("ord < 3")).where("ord >= 3").collect()
    assert [(r.ord, r.call_id, json.loads(r.content)["ok"]) for r in done] == [(3, "2", False)]
    text = json.dumps({"answers": [{"item_id": "a", "items": [{"description": "d", "references": ["r"]}]}, {"item_id": "b", "items": []}, {"item_id": "c", "items": [{"description": "", "references": [" "]}]}, {"item_id": "c", "items": [{"description": "d", "references": []}]}]})
    got = reports.answers(spark.createDataFrame([("x", text)], "batch string, json string")).collect()
    assert sorted((r.item_id, r.errors) for r in got) == [("a", []), ("b", ["item is required"]), ("c", ["duplicate answer", "description is required", "reference is empty"]), ("c", ["duplicate answer", "reference is required"])]
    body = json.dumps({"id": "r1", "output": [{"type": "message", "content": [{"type": "output_text", "text": "he"}, {"type": "output_text", "text": "y"}]}, {"type": "function_call", "call_id": "c", "name": "f", "arguments": "{}"}, {"type": "web_search_call"}], "usage": {"input_tokens": 5, "output_tokens": 2, "total_tokens": 7, "input_tokens_details": {"cached_tokens": 1}}})
    r = reports.responses(spark.createDataFrame([(body,)], "json string")).first()
    assert (r.id, r.text, [c.name for c in r.calls], r.hosted_calls, r.input_tokens, r.cached_input_tokens, r.reasoning_tokens, r.total_tokens) == ("r1", "hey", ["f"], 1, 5, 1, 0, 7)
    p = one(spark, reports.payload_identity(F.lit('{"ok":true,"tool":"t","path":"a","secret":"s","data":{"b":1,"a":2}}')))
    assert (p.bytes, p.ok, p.tool, p.arguments, p.data_keys) == (67, True, "t", {"path": "a"}, ["a", "b"])
    assert [r.type for r in reports.portable(spark.createDataFrame([("message",), ("reasoning",)], "type string")).collect()] == ["message"]


def test_guidance(spark):
    texts = spark.createDataFrame([("AGENTS.md", "root\n\n"), ("a/AGENTS.override.md", "over"), ("a/AGENTS.md", "a"), ("CLAUDE.md", "c"), ("b/CLAUDE.md", "bc")], "path string, text string")
    targets = spark.createDataFrame([(0, "a/x/y.go"), (1, "b/z.go")], "ord int, path string")
    got = reports.guidance(targets, texts)
    assert [(r.path, r.family) for r in got.collect()] == [("AGENTS.md", "agents"), ("a/AGENTS.override.md", "agents")]
    assert [r.path for r in reports.guidance(targets, texts, "claude").collect()] == ["CLAUDE.md", "b/CLAUDE.md"]
    assert reports.guidance(targets, texts, "none").count() == 0
    assert reports.guidance_text(got, "/r").first().text == '# AGENTS.md instructions for /r\n\n<INSTRUCTIONS>\n<PROJECT_DOC path="AGENTS.md">\nroot\n</PROJECT_DOC>\n\n<PROJECT_DOC path="a/AGENTS.override.md">\nover\n</PROJECT_DOC>\n</INSTRUCTIONS>'
    assert reports.guidance_text(got.limit(0), "/r").first().text == ""


def test_messages(spark):
    assert values(spark, reports.shaped, ["", "one", "a subject that ends with\nmore", "subject\nbody one\nbody two", "a\n\nb\nc", "feat(x): a long subject of more than fifty bytes, it\ngoes on\n\nbody"]) == [
        "", "one", "a subject that ends with more", "subject\n\nbody one body two", "a\n\nb c", "feat(x): a long subject of more than fifty bytes, it goes on\n\nbody"]
    style = lambda *s: reports.message_style(spark.createDataFrame(list(enumerate(s)), "ord int, summary string"))
    assert (style("x y", "Adds"), style("feat: a", "Adds"), style("none")) == ("title", "conventional", "conventional")
    assert [one(spark, reports.submodule_subject(s, F.array(*map(F.lit, p)))) for s, p in (("title", ["a"]), ("c", ["a", "b"]), ("c", ["a", "b", "c"]), ("c", ["a", "b", "c", "d"]))] == [
        "Update a submodule", "chore(deps): update a and b submodules", "chore(deps): update a, b, and c submodules", "chore(deps): update submodules"]
    subs = spark.createDataFrame([([("b", [("", "s")]), ("a", [("f" * 40, " x "), ("1", " ")])],)], "s array<struct<path:string,commits:array<struct<sha:string,summary:string>>>>")
    assert subs.select(reports.submodule_body(F.col("s"))).first()[0] == "a\n  - fffffff: x\n\nb\n  - s"
    assert values(spark, lambda c: reports.brief_summary(F.lit(""), c), ["\n 12: func x", "a: b", "3: "]) == ["func x", "a: b", "3:"]
    assert values(spark, reports.sanitised_prompt, ["<tag>\n</b>\n\n a <b>  c \nd\n</tag>", "x"]) == ["a b c\nd", "x"]
    assert values(spark, reports.expanded_json, ['{"a":"{\\"b\\":\\"[1]\\"}","c":"{x"}', "bad"]) == ['{"a":{"b":[1]},"c":"{x"}', "bad"]
    assert one(spark, reports.console_line(F.lit("2024-01-01 01:02:03").cast("timestamp"), F.lit("k"), F.lit('{"b":[1,{"c":"x y"}],"a":null}'))) == '01:02:03.000 k a=null b[0]=1 b[1].c="x y"'
    assert values(spark, lambda c: T.clipped_match(c, 4), ["abcd", "abcde", "ééé"]) == ["abcd", "abcd...", "éé..."]
    assert [one(spark, T.has_line(F.lit("a\nb\n"), F.lit(n))) for n in (0, 1, 2, 3)] == [False, True, True, False]


def test_generated_marks(spark):
    heads = ["// Code generated by x. DO NOT EDIT.\npackage a", "/* a\n b */\n\n// Code generated by x. DO NOT EDIT.", "package a\n// Code generated by x. DO NOT EDIT.", "/* a\n// Code generated by x. DO NOT EDIT.\n*/", "// other\n", ""]
    assert values(spark, lambda c: T.is_go_generated(F.lit("a.go"), c), heads) == [True, True, False, True, False, False]
    assert not one(spark, T.is_go_generated(F.lit("a.py"), F.lit(heads[0])))
    assert values(spark, T.has_do_not_edit, ["// DO NOT EDIT\npackage a", "/* x\nDO NOT EDIT */\npackage a\n", "package a\n// DO NOT EDIT", "x"]) == [True, True, False, False]


def test_symbol_chunks(spark):
    go = "package a\n\nimport \"x\"\n\nfunc A() {\n\tx()\n}\n\n// about\ntype (\n\tB int\n\tC struct {\n\t}\n)\n\nfunc (b B) D() {}\n\nvar e = 1\n"
    py = "import x\n\ndef f():\n    return 1\n\n\nclass G:\n    y = 2\n"
    long = "def g():\n" + "\n".join(f"    x{i} = {i}" for i in range(99))
    docs = spark.createDataFrame([("a.go", go), ("b.py", py), ("gen.go", "// DO NOT EDIT\npackage g\nfunc X() {}\n"), ("c.md", "# t\ntext"), ("l.py", long)], "path string, text string")
    got = {}
    for r in retrieve.chunks(docs).orderBy("path", "start_line").collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line, r.symbol_type, r.symbol))
    assert got["a.go"] == [(1, 4, None, None), (5, 7, "function", "A"), (9, 9, None, None), (10, 14, "type", "B, C"), (16, 16, "method", "D"), (18, 18, "var", "e")]
    assert got["b.py"] == [(1, 2, None, None), (3, 4, "function", "f"), (7, 8, "type", "G")]
    assert got["gen.go"] == [(1, 1, None, None)]
    assert got["c.md"] == [(1, 2, None, None)]
    assert got["l.py"] == [(1, 80, "function", "g"), (61, 100, "function", "g")]


def test_nested_views(spark):
    tree = "path string, mode string, blob string"
    blobs = spark.createDataFrame([("1", 2, b"a\n"), ("2", 4, b"a\nb\n"), ("3", 2, b"c\n")], "blob string, size int, data binary")
    frame = lambda rows: spark.createDataFrame(rows, tree)
    outer = views.View(frame([("x", "100644", "1"), ("lib", "160000", "e" * 40)]), frame([("x", "100644", "2"), ("lib", "160000", "f" * 40)]), blobs)
    inner = views.View(frame([]), frame([("y", "100644", "3")]), blobs)
    both = views.View.united([("", outer), ("lib", inner)])
    assert [(r.path, r.status) for r in both.status().collect()] == [("lib", "M"), ("lib/y", "A"), ("x", "M")]
    assert {r.path: (r.adds, r.deletes) for r in both.stats().collect()} == {"lib": (1, 1), "lib/y": (1, 0), "x": (1, 0)}
    assert [r.path for r in views.component_paths(both.paths(), "lib").collect()] == ["y"]
    root = views.View.of("final_amended", {"index": frame([("y", "100644", "3")])}, blobs)
    assert [r.status for r in root.changes.collect()] == ["added"]
    pack = views.prepared(both)
    assert pack["overview"].first().files == 3
    with pytest.raises(ValueError, match="no change"):
        views.prepared(views.View(frame([]), frame([]), blobs))
    parts = views.components(spark.createDataFrame([("", "a", "A"), ("A", "b", "B"), ("B", "loop", "A")], "repo string, path string, child string"))
    assert [tuple(r) for r in parts.collect()] == [("", ""), ("A", "a"), ("B", "a/b")]
    assert sorted(r.path for r in views.component_files(spark.createDataFrame([("", "f"), ("B", "g")], "repo string, path string"), parts).collect()) == ["a/b/g", "f"]
    work = spark.createDataFrame([("x", "100644", "9", 3, b"abc", False), ("gone", None, None, 0, None, True), ("big", "100644", "8", 50, b"z" * 50, False)], "path string, mode string, blob string, size int, data binary, deleted boolean")
    laid = {r.path: r for r in views.worktree_tree(frame([("x", "100644", "1"), ("gone", "100644", "2"), ("k", "100644", "3")]), work, file_cap=40, total_cap=100).collect()}
    assert {p: (r.blob, bytes(r.data or b"")[:15]) for p, r in laid.items()} == {"x": ("9", b"abc"), "k": ("3", b""), "big": ("8", b"[worktree file ")}
    edges = spark.createDataFrame([("e" * 40, "d" * 40), ("f" * 40, "e" * 40), ("d" * 40, None)], "sha string, parent string")
    commits = spark.createDataFrame([("f" * 40, "six\n\nx"), ("e" * 40, "five"), ("d" * 40, "four")], "sha string, message string")
    moves = spark.createDataFrame([("lib", "d" * 40, "f" * 40)], "path string, old string, new string")
    told = views.history_text(moves, views.submodule_history(moves, commits, edges)).first().text
    assert told == f"Submodule commits lib ({'d' * 7}..{'f' * 7}):\n  {'f' * 7} six\n  {'e' * 7} five\n"
    dirty = views.dirty_gitlinks(spark.createDataFrame([("s", "1"), ("t", "2")], "path string, sha string"), spark.createDataFrame([("s", "1", [("f", "M", "h")]), ("t", "2", [])], "path string, sha string, entries array<struct<path:string,code:string,hash:string>>"))
    assert [(r.path, r.dirty) for r in dirty.collect()] == [("s", True)]
    assert views.with_dirty(spark.createDataFrame([("s", "0", "1"), ("u", "0", "1")], "path string, old string, new string"), dirty).count() == 2
    focus = spark.createDataFrame([("p", 5, 1), ("q", 1, 0), ("r", 9, 9)], "path string, adds int, deletes int")
    assert [r.path for r in views.focus_paths(focus, "diff --git a/r b/r").collect()] == ["p", "q"]
    assert [r.path for r in views.focus_paths(focus, " a/r a/p a/q").collect()] == ["r"]


def test_providers_and_tools(spark):
    def provider(texts):
        if len(texts) > 1 and "odd" in texts:
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(str(i), "odd" if i == 3 else "t" * i) for i in range(9)], "id string, text string")
    assert {r.id: r.vector[0] for r in reports.embedded(rows, provider).collect()} == {str(i): float(3 if i == 3 else i) for i in range(9)}

    def failing(texts):
        raise RuntimeError("always")

    with pytest.raises(Exception, match="always"):
        reports.embedded(rows, failing).collect()
    tools = reports.Registry()
    tools.register("upper", "struct<x:string>", lambda a: (F.upper(a["x"]), F.when(a["x"].isNull(), "x is required"), F.lit(False)))
    calls = spark.createDataFrame([("upper", '{"x":"a"}'), ("upper", "{}"), ("upper", "{"), ("none", "{}")], "name string, arguments string")
    got = [json.loads(r.result) for r in tools.results(calls).collect()]
    assert [(g["ok"], g.get("data"), g.get("error")) for g in got] == [(True, "A", None), (False, None, "x is required"), (False, None, "arguments aren't JSON of the schema"), (False, None, "unknown tool")]
    with pytest.raises(ValueError, match="already"):
        tools.register("upper", "", None)


def test_ignore_files(spark):
    listing = spark.createDataFrame([(".gitignore", "*.log\n!keep.log\n"), ("a/.gitignore", "/x\n"), ("a/x", ""), ("b/x", ""), ("c.log", ""), ("keep.log", ""), ("tmp/y", "")], "path string, text string")
    rules = ignore.rules(listing, excludes=("tmp/\n",))
    assert sorted(r.path for r in ignore.kept(listing, rules).collect()) == [".gitignore", "a/.gitignore", "b/x", "keep.log"]


def test_markdown_report(spark):
    schema = "session map<string,string>, usage map<string,string>, skills array<string>, tools array<struct<name:string,count:int>>, branches array<struct<id:string,fields:map<string,string>>>, summary string, recommendation string, findings array<struct<severity:string,title:string,impact:string,proposed_fix:string,evidences:array<struct<title:string,path:string,line_start:int,line_end:int>>>>"
    row = ({"ID": "s", "Mode": ""}, {}, [], [("grep", 2)], [], "good *work*", "FIX", [("HIGH", "t", "i", "p", [("e", "a.go", 1, 2)])])
    text = spark.createDataFrame([row], schema).select(reports.inspection_markdown(F.struct("*"))).first()[0]
    assert text.startswith("# Session report\n\n- **ID**: `s`\n\n## Usage")
    assert "## Used skills\n\nNone\n\n## Tool calls\n\n- grep: 2\n\n## Branches (0)\n\nNone\n\n## Summary\n\ngood \\*work\\*" in text
    assert text.endswith("### HIGH: t\n\ni\n\nProposed fix: p\n\n  - e: `a.go:1-2`\n")
