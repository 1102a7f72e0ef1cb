"""Scalar functions on literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae.functions import paths as P
from tesserae.functions import text as T
from tesserae.functions import vectors as V
from tesserae.functions import web as W
from tesserae.operators import readq, validate


def values(spark, function, inputs):
    """A function over texts, in one job."""
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_terms(spark):
    got = values(spark, T.terms, ["HTTPServerCommand URLParser JSONEncoder", "class classes cats is", "aB1C 2x_y", "", "Übergröße_X", "ABC abcD"])
    assert got == [["http", "server", "command", "url", "parser", "json", "encoder"], ["class", "classes", "classe", "cats", "cat", "is"], ["a", "b1", "c", "2x", "y"], [], ["übergröße", "x"], ["abc", "abc", "d"]]


def test_small_texts(spark):
    assert values(spark, T.normalized_query, ["  A \n b  ", ""]) == ["a b", ""]
    assert values(spark, T.release_scope, ["fix(api): x", "fix: x (y)", "fix(a b): x"]) == ["api", "y", ""]
    assert values(spark, T.commit_scope, ["fix(api): x", "fix: x (y)", "fix(a b): x"]) == ["api", "", "a b"]
    assert values(spark, T.label, ["api_server", "web-ui", "internal/accesslog", "", "tls"]) == ["API/Server", "Web/UI", "Internal/Access Logs", "", "TLS"]
    assert values(spark, T.subject, ["\n\n a \nb", "", "x"]) == ["a", "", "x"]
    assert values(spark, T.prompt, ["  a  \n\n\n\n b\r\nc "]) == ["a\n\nb\nc"]
    assert values(spark, lambda c: T.single_line(c, 5), [" a \n b  cdef"]) == ["a b c"]
    assert values(spark, T.line_count, ["", "a", "a\n", "a\nb"]) == [0, 1, 1, 2]
    assert values(spark, lambda c: T.line_range(c, F.lit(2), F.lit(3), numbered=True), ["a\nb\nc\nd"]) == ["     2\tb\n     3\tc"]
    assert values(spark, T.code_span, ["a", "a``b", "`x"]) == ["`a`", "```a``b```", "`` `x ``"]
    assert values(spark, T.escaped_prompt, ["<a & b>"]) == ["&lt;a &amp; b&gt;"]
    assert values(spark, lambda c: T.clamped_message(c, 3, 4), ["a b c\nd e f\ng"]) == ["a b c\nd"]
    assert values(spark, lambda c: T.human_list(F.split(c, ",")), ["a", "a,b", "a,b,c"]) == ["a", "a and b", "a, b, and c"]


def test_excerpt(spark):
    long = "\n".join(["x" * 100] * 200)
    got = values(spark, lambda c: T.numbered_excerpt(T.body_lines(c), F.lit(7), 40, 1000), ["a\nb\n", long])
    assert got[0] == "7: a\n8: b"
    assert len(got[1].encode()) <= 1000
    assert got[1].count("\n") == 8


@pytest.mark.parametrize(("path", "code", "test"), [
    ("a/b.go", True, False), ("tests/a.py", True, True), ("a/contest.py", True, False), ("a/latest.txt", False, False), ("a/foo_test.go", True, True),
    ("a/FooTest.java", True, True), ("a/TestFoo.kt", True, True), ("a/Testing.kt", True, False), ("a/x.spec.ts", True, True), ("A/__tests__/x.js", True, True), ("test", False, True)])
def test_path_predicates(spark, path, code, test):
    assert values(spark, P.is_code, [path]) == [code]
    assert values(spark, P.is_test, [path]) == [test]


def test_path_parts(spark):
    assert values(spark, P.directory, ["a/b/c.go", "c.go"]) == ["a/b", "."]
    assert values(spark, P.extension, ["a.b/c", "x.tar.gz"]) == ["<none>", ".gz"]
    assert values(spark, P.ancestors, ["a/b/c.go", "c.go"]) == [["", "a", "a/b"], [""]]
    assert values(spark, P.language, ["a.go", "a.yml", "a.zig"]) == ["go", "yaml", ""]
    assert values(spark, P.status_verb, ["A", "deleted", "?"]) == ["Added", "Deleted", "Changed"]
    assert values(spark, lambda c: P.in_scope(c, ["a/b"]), ["a/b", "a/b/c", "a/bc"]) == [True, True, False]
    assert values(spark, lambda c: P.may_contain(c, ["a/b"]), ["a", "a/b/c", "x"]) == [True, True, False]
    assert values(spark, lambda c: P.is_hidden(c, [".github"]), [".git/x", ".github/x", "a/.b"]) == [True, False, True]
    assert values(spark, lambda c: P.matches_glob(c, "*.g[oa]"), ["a/b.go", "b.ga", "b.gx"]) == [True, True, False]
    assert values(spark, lambda c: P.matches_glob(c, "a/*.go"), ["a/b.go", "a/b/c.go"]) == [True, False]
    assert values(spark, P.is_safe, ["a/b", "/a", "../a", "a/./b", "a//b", "."]) == [True, False, False, False, False, False]


def test_scope():
    assert P.normalized_scope(["./b/", "a//c", "b"]) == ["a/c", "b"]
    assert P.normalized_scope(["a", "."]) == []
    for bad in ("/a", "../a"):
        with pytest.raises(ValueError, match="scope"):
            P.normalized_scope([bad])


def test_release_classes(spark):
    cases = {"a/schema.json": "generated", "a_test.go": "test", "docs/x": "docs", ".github/x.yml": "build", "Dockerfile.dev": "build", "go.sum": "dependency", "cmd/x.go": "cli", "internal/api/x.go": "api", "x/config.go": "config_schema"}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").withColumns(P.release_classes(F.col("path"))).collect()
    assert all(r[cases[r.path]] for r in rows)
    assert not any(r["build"] for r in rows if cases[r.path] not in ("build",))


def test_vectors(spark):
    row = spark.sql("select array(1f,0f) a, array(0f,1f) b, array(0f,0f) z, array(1f) s").select(
        V.cosine(F.col("a"), F.col("a")), V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.cosine(F.col("a"), F.col("s")), V.relatedness(F.lit(-1.0)), V.hybrid(F.lit(0.5), F.lit(0.5)), V.lexical(F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert tuple(row) == (1.0, 0.0, 0.0, 0.0, 1e-9, 0.75, 1.0)


def test_float_bytes(spark):
    row = spark.sql("select array(1f, -2.5f) v").select(W.float_bytes(F.col("v")).alias("b")).select("b", F.crc32("b").alias("c")).first()
    import struct
    import zlib

    data = struct.pack("<2f", 1, -2.5)
    assert (bytes(row.b), row.c) == (data, zlib.crc32(data))


def test_urls(spark):
    same = ["https://user:pw@Example.com:443/a/b.git?x=1#y", "git@example.com:a/b.git", "ssh://git@example.com:22/a//b/", "http://EXAMPLE.com/a/b"]
    assert set(values(spark, W.identity, same)) == {"example.com/a/b"}
    assert values(spark, W.identity, ["ssh://h:2222/a"]) == ["h:2222/a"]
    assert values(spark, W.sanitized, [same[0]]) == ["https://Example.com:443/a/b.git"]
    assert values(spark, W.web, [same[1]]) == ["https://example.com/a/b"]


def test_versions(spark):
    assert values(spark, W.version, ["v1.2.3", "1.0.0", "v01.2.3", "1.2"]) == [(1, 2, 3), (1, 0, 0), None, None]
    assert values(spark, lambda c: W.bumped(c, "minor"), ["v1.2.3", "1.2.3"]) == ["v1.3.0", "1.3.0"]


def test_html_and_limits(spark):
    html = '<body><p>no</p><main id="main-content">a <b>b</b><br><script>x</script> &amp; c</main><p>no</p></body>'
    assert values(spark, W.main_text, [html, None]) == ["a b & c", None]
    assert values(spark, lambda c: W.limited(c, 5, 2), ["ab", "éééé", "a\nb\nc", None]) == ["ab", "éé\n[truncated]", "a\nb\n[truncated]", None]
    assert values(spark, W.canonical_json, ['{"b": 1, "a": [1.10]}']) == ['{"a":[1.1],"b":1}']


def test_pointer(spark):
    doc = '{"a":[{"b/c":1},2],"n":12345678901234567890.10,"x~y":"t","o":{"k":[1.50,"1.5"]}}'
    for path, want, exact in (("/a/0/b~1c", "1", "1"), ("/a/1", "2", "2"), ("/n", "12345678901234567890.1", "12345678901234567890.10"), ("/x~0y", "t", "t"), ("/nope", None, None), ("/a/01", None, None), ("/o", '{"k":[1.5,"1.5"]}', '{"k":[1.50,"1.5"]}')):
        assert values(spark, lambda c, p=path: readq.pointer(c, p), [doc, "{", None]) == [want, None, None]
        assert values(spark, lambda c, p=path: readq.exact_pointer(c, p), [doc, "{", None]) == [exact, None, None]
    with pytest.raises(ValueError, match="pointer"):
        readq.pointer(F.lit("{}"), "a")


def test_commit_message_errors(spark):
    assert values(spark, validate.commit_message, ["fix: x", "", "a\n" + "b" * 91, "```x```", "Here is a message"]) == [[], ["empty message"], ["body line over 90 bytes"], ["code fence"], ["commentary"]]
    assert values(spark, validate.is_commit_sha, ["abcdef1", "ABC", "g" * 8]) == [True, False, False]
    assert values(spark, validate.is_object_id, ["a" * 40, "A" * 40]) == [True, False]
