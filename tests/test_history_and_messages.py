"""History and message operators on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesserae.operators import history, messages

EDGES = [("e", "d"), ("d", "c"), ("c", "b"), ("b", "a"), ("x", "b"), ("a", None)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "sha string, parent string")


def node(spark, n):
    return spark.createDataFrame([(n,)], "node string")


def test_log_and_tags(spark, edges):
    day = lambda i: dt.datetime(2024, 1, i + 1)
    commits = spark.createDataFrame([(s, f"\n subject {s}\nbody", "me", day(i)) for i, s in enumerate("abcdex")], "sha string, message string, author string, author_time timestamp")
    got = history.log(commits, edges, node(spark, "e"), node(spark, "x"))
    assert [r.sha for r in got.collect()] == ["e", "d", "c"]
    assert history.projected(commits).where("sha = 'a'").first()[1:] == ("a", "subject a", "me", "2024-01-01T00:00:00Z")
    tags = spark.createDataFrame([("v1.2.0", "c"), ("v1.10.0", "c"), ("v9.0.0", "x"), ("latest", "e"), ("v0.1.0", "a")], "name string, sha string")
    assert tuple(history.last_version_tag(tags, edges, node(spark, "e")).first()) == ("v1.10.0", "c")
    refs = spark.createDataFrame([("HEAD", "main", None), ("main", None, "h1"), ("loop", "loop", None)], "name string, target string, hash string")
    assert {r.name: r.hash for r in history.followed_refs(refs).collect()} == {"HEAD": "h1", "main": "h1"}


def test_modules_and_refs(spark):
    text = '[submodule "a"]\n\tpath = lib/a\n\turl = https://x/a\n# c\n[submodule "b"]\n\turl = https://x/b\n\tpath = lib/b\n[submodule "c"]\npath = lib/c\nurl = https://x/c'
    got = history.module_urls(spark.createDataFrame([("f", text)], "file string, text string"))
    assert sorted((r.module_path, r.url) for r in got.collect()) == [("lib/a", "https://x/a"), ("lib/c", "https://x/c")]
    urls = spark.createDataFrame([("abcdef1234", "u1"), ("abcdef1299", "u2"), ("1234567890", "u3")], "sha string, url string")
    refs = spark.createDataFrame([("abcdef12",), ("ABCDEF1234",), ("1234567",), ("123456",), ("zzzzzzz",)], "ref string")
    assert {r.ref: r.url for r in history.resolved_refs(refs, urls).collect()} == {"abcdef12": None, "ABCDEF1234": "u1", "1234567": "u3", "123456": None, "zzzzzzz": None}


def test_release_notes(spark):
    commits = spark.createDataFrame([("1", "fix(api): x", "fix(api): x\n\n- First   fact\nmore.\n\nSigned-off-by: a"), ("2", "feat: y", "feat: y"), ("3", "test: z", "test: z"), ("4", "chore: w", "chore: w")], "sha string, summary string, message string")
    files = spark.createDataFrame([("1", "internal/a.go", False), ("2", "b.go", False), ("3", "b_test.go", False)], "sha string, path string, submodule boolean")
    got = {r.sha: r for r in history.candidates(commits, files).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].fact, got["1"].section, got["1"].label, got["1"].confidence) == ("First fact more.", "Bug Fixes", "API", "medium")
    assert got["2"].fact == "y."
    assert history.recommended_sections(commits).first()[0] == ["### Bug Fixes", "### New Features", "### Improvements", "### Full Changelog"]
    sections = spark.createDataFrame([("Other", 1), ("New Features", 2), ("Bug Fixes", 3)], "heading string, ord int")
    assert [r.heading for r in history.ordered_sections(sections, ["### Bug Fixes", "### New Features"]).collect()] == ["Bug Fixes", "New Features", "Other"]
    low = spark.createDataFrame([("Adds x, and while enabling users to y",), ("Adds x, improving usability",), ("Adds x and y",)], "s string").select(history.low_signal(F.col("s"))).collect()
    assert [r[0] for r in low] == [True, True, False]


def test_patch_stats(spark):
    lines = spark.createDataFrame([("a", "+", False), ("a", "-", False), ("a", "+", False), ("b", " ", False), ("c", " ", True)], "path string, op string, is_binary boolean")
    assert sorted(map(tuple, history.patch_stats(lines).collect())) == [("a", 2, 1, False), ("c", 0, 0, True)]


def test_wrap():
    text = "one two three four five\nsix\n\n- aa bb cc dd ee ff\n> qq rr ss tt uu vv ww\n1. xx yy zz ww\n  kept   as it is, however long\nToken: value one two three"
    got = messages.wrap(text, 16)
    assert got == "one two three\nfour five six\n\n- aa bb cc dd ee\n  ff\n> qq rr ss tt uu\n> vv ww\n1. xx yy zz ww\n  kept   as it is, however long\nToken: value one\n       two three"
    assert messages.wrap("a " + "x" * 30 + " b", 10) == "a\n" + "x" * 30 + "\nb"


def test_inputs_and_calls(spark):
    row = spark.sql("select 'a/b.go' p, 'func' k, 'F' n, 'x\r\ny\n' t").select(messages.embedding_input(F.col("p"), F.col("k"), F.col("n"), F.col("t"))).first()
    assert row[0] == "path: a/b.go\nsymbol: func F\nlanguage: go\n\nx\ny"
    schema = "batch string, ord int, id string, call_id string, name string, arguments string"
    primary = spark.createDataFrame([("b", 0, "1", "", "", " "), ("b", 1, "", "c2", "f", "{}"), ("b", 2, "", "", "", ""), ("z", 0, "", "", "", "")], schema)
    streamed = spark.createDataFrame([("b", 0, "9", "c2", "x", "{2}"), ("b", 1, "1", "c1", "g", "{1}"), ("z", 1, "5", "", "h", "")], schema)
    got = {(r.batch, r.ord): tuple(r)[2:] for r in messages.merged_calls(primary, streamed).collect()}
    assert got == {("b", 0): ("1", "c1", "g", "{1}"), ("b", 1): ("9", "c2", "f", "{}"), ("z", 1): ("5", "", "h", "")}
    items, answers = (spark.createDataFrame(x, "batch string, id string") for x in ([("b", "1"), ("b", "2")], [("b", "2"), ("b", "3")]))
    assert sorted((r.id, r.error) for r in messages.unanswered(items, answers).collect()) == [("1", "missing answer"), ("3", "unknown id")]


def test_payloads(spark):
    df = spark.createDataFrame([('{"a":1,"zz":2}',), ("no",), ('{"A":1}',)], "j string")
    assert [r.errors for r in messages.strict_json(df, "j", "a int", ["a"]).collect()] == [["unknown member zz"], ["not JSON"], []]
    text = spark.createDataFrame([("x" * 20_000,), ("short",)], "t string").select(messages.compacted(F.col("t")).alias("c")).collect()
    assert (text[0].c.bytes, text[0].c.truncated, text[1].c) == (20_000, True, None)
    out = spark.createDataFrame([("fetch https://u:p%40w@h/x?t=sec failed for u p@w sec",)], "m string").select(messages.redacted(F.col("m"), "https://u:p%40w@h/x?t=sec", "https://h/x")).first()[0]
    assert "p@w" not in out and "sec" not in out and "https://h/x" in out
    assert spark.sql("select 'fix x' s, 'old (T12)' r").select(messages.preserved_suffix(F.col("s"), F.col("r"))).first()[0] == "fix x (T12)"
    leaves = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "a"), (2, 1, "b"), (2, 2, "x")], "leaf int, ord int, item string")
    assert [r.item for r in messages.common_prefix(leaves).collect()] == ["a", "b"]


def test_release_preparation(spark):
    """Commits after the last version's tag, with their files, sections and candidates."""
    commits = spark.createDataFrame([("c3", "feat: adds x\n\nlonger text here", "a", "2024-01-03"), ("c2", "fix: mends y", "a", "2024-01-02"), ("c1", "first", "a", "2024-01-01")], "sha string, message string, author string, d string").withColumn("author_time", F.col("d").cast("timestamp"))
    edges = spark.createDataFrame([("c3", "c2"), ("c2", "c1"), ("c1", None)], "sha string, parent string")
    files = spark.createDataFrame([("c3", "cmd/x.go", 5, 1, False), ("c3", "", 1, 1, False), ("c2", "a_test.go", 2, 2, False), ("c1", "z.go", 9, 9, False)], "sha string, path string, additions int, deletions int, submodule boolean")
    got = history.release_preparation(commits, files, spark.createDataFrame([("v1.0.0", "c1"), ("x", "c3")], "name string, sha string"), edges, spark.createDataFrame([("c3",)], "node string"))
    assert got["tag"].first().name == "v1.0.0"
    assert sorted((r.sha, r.files_changed) for r in got["commits"].collect()) == [("c2", 1), ("c3", 2)]
    assert got["sections"].first().sections == ["### Bug Fixes", "### New Features", "### Full Changelog"]
    assert [(r.sha, r.section) for r in got["candidates"].collect()] == [("c3", "New Features")]
    assert spark.range(1).select(history.appended(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))).first()[0] == ["a", "b", "c"]
