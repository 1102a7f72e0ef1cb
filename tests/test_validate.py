"""Rules of messages, evidence, sessions and tool calls, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae.operators import validate, views


def test_messages(spark):
    df = spark.createDataFrame([(0, " \n"), (1, "fix: x\n\n" + "b" * 91), (2, "x\n```"), (3, "I would say so"), (4, "Commit message: x"), (5, "fix: y\n\nIn addition it also runs"), (6, "fix: y")], "i int, m string")
    got = {r.i: (r.a, r.b) for r in df.select("i", validate.commit_message(F.col("m")).alias("a"), validate.commit_message(F.col("m"), amend=True).alias("b")).collect()}
    assert got == {
        0: (["empty message"], ["empty message"]), 1: (["body line over 90 bytes"],) * 2, 2: (["code fence"],) * 2, 3: (["commentary"],) * 2, 4: (["commentary"],) * 2, 5: ([], ["amend phrase"]), 6: ([], [])}


def test_amended_messages(spark):
    """The subject of the message before stays, whatever space is around it."""
    rows = [(0, "fix: a\n\nmore", "\n fix: a \n\nold"), (1, "fix: b", "fix: a"), (2, "fix: b", ""), (3, "fix: b", None), (4, "", "fix: a"), (5, "fix: a\n\nalso", "fix: a")]
    got = {r.i: r.e for r in spark.createDataFrame(rows, "i int, m string, o string").select("i", validate.amended_message(F.col("m"), F.col("o")).alias("e")).collect()}
    assert got == {0: [], 1: ["subject of the original lost"], 2: [], 3: [], 4: ["empty message", "subject of the original lost"], 5: ["amend phrase"]}


def test_evidence(spark):
    """Deleted files are looked up in the head; what isn't a file may only be named by its first line."""
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("old", 1, 3), ("old", 1, 4), ("made", 1, 1), ("made", 1, 2), ("made", 2, 2), ("none", 1, 1)], "path string, line_start int, line_end int")
    sized = lambda *x: spark.createDataFrame(list(x), "path string, lines int")
    got = {tuple(r)[:3]: r.errors for r in validate.evidence(rows, sized(("a", 5)), spark.createDataFrame([("made",), ("made",)], "path string"), sized(("a", 99), ("old", 3))).collect()}
    past, unknown = ["line end past the file"], ["unknown path"]
    assert got == {("a", 1, 5): [], ("a", 1, 6): past, ("old", 1, 3): [], ("old", 1, 4): past, ("made", 1, 1): [], ("made", 1, 2): unknown, ("made", 2, 2): unknown, ("none", 1, 1): unknown}
    assert [r.errors for r in validate.evidence(rows.where("path = 'made' and line_end = 1"), sized(("a", 5))).collect()] == [unknown]


def test_sessions(spark):
    name = lambda c: c * 26
    rows = [
        (name("A"), None, 0, 4, "/w", "k"), (name("B"), name("A"), 1, 4, "/w", "k"), (name("C"), name("A"), 2, 4, "/w", "k"), (name("D"), name("Z"), 1, 4, "/w", "k"), ("x", None, 0, 3, "", " "),
        (name("E"), None, 1, None, "/w/../v", "k"), (name("F"), name("G"), 4, 4, "/w/", "k"), (name("G"), None, 0, 4, "/", "k")]
    got = {r.id: r.errors for r in validate.sessions(spark.createDataFrame(rows, "id string, parent_id string, depth int, version int, workspace string, prompt_cache_key string")).collect()}
    assert got == {
        name("A"): [], name("B"): [], name("C"): ["depth not parents plus one"], name("D"): ["parent missing"], "x": ["bad id", "unsupported version", "workspace missing", "prompt key missing"],
        name("E"): ["root has depth", "unsupported version", "workspace not clean"], name("F"): ["depth not parents plus one", "depth out of range", "workspace not clean"], name("G"): []}


def test_tool_calls(spark):
    """Within a batch and against earlier ones; the control tool is known and called once."""
    calls = [("b", "1", "grep", "{}"), ("b", "2", "done", "{}"), ("b", "3", "done", "{1}"), ("c", "4", "grep", "{}"), ("c", "5", "rm", "{}"), ("c", "", "find", "{}"), ("d", "6", "done", "{}"), ("d", "9", "find", "{2}"), ("d", "7", "grep", "{9}"), ("e", "8", None, "{}")]
    df = spark.createDataFrame(calls, "batch string, call_id string, name string, arguments string")
    seen = spark.createDataFrame([("9", "x", "{}"), ("0", "grep", "{9}")], "call_id string, name string, arguments string")
    got = {(r.batch, r.call_id): r.errors for r in validate.tool_batch(df, ["grep", "find"], control="done", seen=seen).collect()}
    several = ["several control calls"]
    assert got == {
        ("b", "1"): several, ("b", "2"): several, ("b", "3"): several, ("c", "4"): [], ("c", "5"): ["unknown tool"], ("c", ""): ["call id missing"], ("d", "6"): [], ("d", "9"): ["repeated call id"],
        ("d", "7"): ["repeated call"], ("e", "8"): ["unknown tool"]}
    assert {r.call_id: r.errors for r in validate.tool_batch(df.where("batch = 'd'"), ["grep", "find"]).collect()} == {"6": ["unknown tool"], "9": [], "7": []}


@pytest.mark.parametrize("parts", [1, 7])
def test_worktree_total(spark, parts):
    """The running total over files in path order decides, however the files are dealt."""
    rows = [(f"f{i:03d}", "100644", f"b{i}", 10, bytearray(b"x" * 10), False) for i in range(200)] + [("big", "100644", "bb", 500, bytearray(b"y" * 500), False), ("gone", "100644", "g", 10, None, True)]
    tree = spark.createDataFrame(rows, "path string, mode string, blob string, size long, data binary, deleted boolean").repartition(parts)
    index = spark.createDataFrame([("gone", "100644", "g"), ("same", "100644", "s")], "path string, mode string, blob string")
    got = {r.path: r.data for r in views.worktree_tree(index, tree, file_cap=100, total_cap=905).collect()}
    assert "gone" not in got and got["same"] is None and len(got) == 202
    assert [p for p in sorted(got) if p.startswith("f") and bytes(got[p]) == b"x" * 10] == [f"f{i:03d}" for i in range(90)]
    assert b"size=500 bytes exceeds 100-byte" in bytes(got["big"]) and b"size=10 bytes exceeds 5-byte" in bytes(got["f090"])
