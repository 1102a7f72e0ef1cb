"""Operators on small tables, after the cases of FIXTURES.md."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae.functions import paths as P
from tesserae.functions import web as W
from tesserae.operators import changes, readq, retrieve, store, validate
from tesserae.plans import graph, ranks
from tesserae.sources import files
from tesserae.streaming import folds

CHUNKS = "chunk_id string, path string, start_line int, end_line int, symbol string, text string"
VECTORS = "chunk_id string, vector array<float>"


def test_hybrid_threshold(spark):
    """The threshold holds for the hybrid rank; a row without a vector never appears."""
    chunks = spark.createDataFrame([("1", "positive.txt", 1, 1, None, "target"), ("2", "negative.txt", 1, 1, None, "unrelated"), ("3", "target.txt", 1, 1, None, "target target target"), ("4", "future.txt", 1, 1, None, "target")], CHUNKS)
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [-1.0, 0.0]), ("3", [0.0, 1.0])], VECTORS)
    every = retrieve.search(chunks, vectors, [("q", "target", [1.0, 0.0])]).orderBy("place").collect()
    assert [r.path for r in every] == ["positive.txt", "target.txt", "negative.txt"]
    assert every[1]["rank"] > every[1].vector_score == 0.5
    kept = retrieve.search(chunks, vectors, [("q", "target", [1.0, 0.0])], min_score=every[1]["rank"]).collect()
    assert {r.path for r in kept} == {"positive.txt", "target.txt"}


def test_ties_and_fields(spark):
    chunks = spark.createDataFrame([("1", "b.txt", 1, 1, None, "alpha"), ("2", "a.txt", 1, 1, None, "alpha"), ("3", "server.go", 1, 2, "func languageServerCommand", "x")], CHUNKS)
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0, 0.0]), ("3", [0.9, 0.1])], VECTORS)
    got = retrieve.search(chunks, vectors, [("q", "alpha", [1.0, 0.0]), ("s", "language server", [0.0, 1.0]), ("e", "", [1.0, 0.0])]).collect()
    order = {q: [r.path for r in sorted(got, key=lambda r: r.place) if r.query_id == q] for q in "qse"}
    assert order["q"][:2] == ["a.txt", "b.txt"]
    assert order["s"][0] == "server.go"
    assert next(r for r in got if r.query_id == "s" and r.path == "server.go").symbol_score == 1.0
    assert all(r["rank"] == r.vector_score for r in got if r.query_id == "e")


def test_line_chunks(spark):
    docs = spark.createDataFrame([(n, "\n".join(map(str, range(1, n + 1)))) for n in (1, 80, 81, 200)], "n int, text string")
    got = sorted((r.n, r.start_line, r.end_line) for r in retrieve.line_chunks(docs).collect())
    assert got == [(1, 1, 1), (80, 1, 80), (81, 1, 80), (81, 61, 81), (200, 1, 80), (200, 61, 140), (200, 121, 200)]


def test_replay(spark):
    history = spark.createDataFrame([(1, "a", [1.0, 0.1]), (2, "b", [1.0, 0.0]), (3, "c", [0.0, 1.0])], "ord int, normalized string, query_embedding array<double>")
    assert [tuple(r) for r in retrieve.similar_query(history, [1.0, 0.0], "z").collect()] == [(1, "similar")]
    assert [tuple(r) for r in retrieve.similar_query(history, [1.0, 0.0], "c").collect()] == [(3, "hit")]
    assert retrieve.similar_query(history, [-1.0, 0.0], "z").count() == 0


def test_merges(spark):
    rows = lambda x: spark.createDataFrame(x, "k string, v string, ord int")
    base, incoming = rows([("a", "1", 1), ("b", "2", 2)]), rows([("a", "9", 1), ("c", "3", 2), ("c", "4", 3)])
    assert sorted((r.k, r.v) for r in store.precedence(base, incoming, "k").collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert sorted(r.k for r in store.conflicts(base.unionByName(incoming), "k", "v").collect()) == ["a", "c"]
    same = store.strict(base.drop("ord"), rows([("b", "2", 1), ("d", "5", 1)]).drop("ord"), "k", "v")
    assert sorted((r.k, r.v) for r in same.collect()) == [("a", "1"), ("b", "2"), ("d", "5")]
    with pytest.raises(Exception, match="conflicting payload"):
        store.strict(base.drop("ord"), incoming.drop("ord"), "k", "v").collect()
    assert store.same_rows(base, base)
    assert not store.same_rows(base, incoming)


def test_reuse_and_garbage(spark):
    chunks = spark.createDataFrame([(1, "h"), (2, "h"), (3, "x")], "chunk_id int, embedding_input_hash string")
    pool = spark.createDataFrame([("h", [1.0], 1), ("h", [2.0], 2)], "embedding_input_hash string, vector array<double>, ord int")
    assert sorted((r.chunk_id, r.vector) for r in store.reuse(chunks, pool).collect()) == [(1, [2.0]), (2, [2.0])]
    assert [r[0] for r in store.missing_hashes(chunks, pool).collect()] == ["x"]
    live = store.garbage(chunks, pool, "embedding_input_hash")
    assert [r.chunk_id for r in live.collect()] == [3]
    assert store.garbage(live.where("false"), pool, "embedding_input_hash").count() == 0


def test_publish_and_upsert(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store.publish(spark.range(3), root)
    store.publish(spark.range(5), root)
    assert store.current(spark, root).count() == 5
    for _ in range(2):
        store.upsert(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int"), f"{root}/rows", "k")
    assert spark.read.parquet(f"{root}/rows").count() == 2
    with pytest.raises(ValueError, match="another payload"):
        store.upsert(spark.createDataFrame([("a", 9)], "k string, v int"), f"{root}/rows", "k", "v")
    store.publish(spark.range(7), root)
    assert [r.kept for r in store.retained(spark.read.parquet(f"{root}/manifests")).orderBy("created_at").collect()] == [False, True, True]


def test_json_with_quotes_and_without_json(spark):
    rows = spark.createDataFrame([(1, '{"it\'s":1,"a/b":[2]}'), (2, "bad"), (3, None)], "id int, j string")
    got = readq.json_members(rows, "id", "j").collect()
    assert sorted(map(tuple, got)) == [(1, "/a~1b", "array"), (1, "/it's", "number")]
    assert [r[0] for r in rows.orderBy("id").select(W.canonical_json(F.col("j"))).collect()] == ['{"a/b":[2],"it\'s":1}', "bad", None]
    assert spark.range(1).select(P.release_classes(F.lit(".mypy.ini"))["build"]).first()[0]


def test_change_groups(spark):
    """Five hundred generated files are one group with three samples; two others are outliers."""
    facts = [(f"pkg/generated/type_{i:03d}.go", "M", 10 + i % 7, 5 + i % 3, True, "standard") for i in range(500)] + [("config.json", "M", 2, 1, False, ""), ("docs/readme.md", "M", 3, 0, False, "")]
    df = spark.createDataFrame(facts, "path string, status string, adds int, deletes int, generated boolean, rule string")
    got = changes.groups(df).collect()
    group = [g for g in got if not g.outlier]
    assert len(got) - len(group) == 2
    assert [(g.files, g.match, len(g.samples)) for g in group] == [(500, "pkg/generated/*.go", 3)]
    assert group[0].samples[:2] == ["pkg/generated/type_000.go", "pkg/generated/type_250.go"]
    top = changes.top_churn(df.where("generated"), ["status"]).orderBy("place").collect()
    assert [r.path for r in top] == ["pkg/generated/type_020.go", "pkg/generated/type_041.go", "pkg/generated/type_062.go"]
    view = changes.overview(df).first()
    assert (view.files, view.generated_files, view.dominant_scope) == (502, 500, "pkg/generated")


def test_renames(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, blob string")
    new = spark.createDataFrame([("a", "1"), ("z", "2"), ("c", "4")], "path string, blob string")
    got = changes.with_renames(changes.delta(old, new, "path", "blob"))
    assert sorted((r.path, r.old_path, r.status) for r in got.collect()) == [("c", None, "modified"), ("z", "b", "renamed")]


def test_signals_and_policy(spark):
    rows = [("t", "a_test.go"), ("m", "a_test.go"), ("m", "internal/x.go"), ("d", "go.sum"), ("b", "Makefile"), ("i", "internal/x.go")]
    df = spark.createDataFrame(rows, "sha string, path string").withColumns(P.release_classes(F.col("path"))).withColumn("submodule", F.lit(False))
    got = changes.operator_signals(df, "sha").withColumn("why", changes.narrative_policy(F.lit("chore: x"))).collect()
    assert {r.sha: r.why for r in got} == {"t": "tests only", "m": None, "d": "dependency metadata only", "b": "build or CI files only", "i": "internal chore only"}
    sections = spark.createDataFrame([("fix: drop it",), ("fix: x",), ("feat(a): y",), ("cve",), ("z",)], "s string").select(changes.section(F.col("s"), F.lit(""))).collect()
    assert [r[0] for r in sections] == ["Breaking Changes", "Bug Fixes", "New Features", "Security", "Improvements"]


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "")], "k int, v string")
    a, b = (changes.fingerprint(x, "k", "v").first()[0] for x in (df, df.orderBy(F.desc("k"))))
    assert a == b != changes.fingerprint(df.where("k = 1"), "k", "v").first()[0]


def test_reads(spark):
    docs = spark.createDataFrame([("a/x.md", "one\r\ntwo three\nthree"), ("b/y.go", "func A() {}\nfunc (t T) B() {\n}\ntype C struct"), ("bin", "three\0")], "path string, text string")
    assert [(r.path, r.line, r.match) for r in readq.grep(docs, "^three").collect()] == [("a/x.md", 3, "three")]
    assert [(r.path, r.kind) for r in readq.find(docs, "[ab]", "directory").collect()] == [("a", "directory"), ("b", "directory")]
    assert [r.path for r in readq.listed(docs, "a").collect()] == ["a/x.md"]
    assert sorted((r.line, r.kind, r.name) for r in readq.go_outline(docs.where("path = 'b/y.go'")).collect()) == [(1, "function", "A"), (2, "method", "T.B"), (4, "type", "C")]
    for bad in ("(?=x)", r"(a)\1", "a++"):
        with pytest.raises(ValueError, match="pattern"):
            readq.grep(docs, bad)
    page = readq.page(docs.select("path"), ["path"], 1, 1).first()
    assert (page.path, page.total, page.has_more, page.next_offset) == ("b/y.go", 3, True, 2)
    assert readq.within_bytes(docs.select("path"), "path", 40).count() == 2


def test_markdown_outline(spark):
    text = "# A #\n```\n# no\n~~~\n```\n   ## B\n    # code\n~~~~\n# no\n~~~\n# no\n~~~~\n###### C\n####### no"
    got = readq.markdown_outline(spark.createDataFrame([("m", text)], "path string, text string")).collect()
    assert [(r.line, r.level, r.title) for r in got] == [(1, 1, "A"), (6, 2, "B"), (13, 6, "C")]


def test_graphs(spark):
    edges = spark.createDataFrame([("e", "d"), ("d", "c"), ("c", "b"), ("b", "a"), ("x", "b"), ("y", "x"), ("a", None)], "sha string, parent string")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    assert {r.node: r.distance for r in graph.reachable(edges, one("c")).collect()} == {"c": 0, "b": 1, "a": 2}
    assert {r.node for r in graph.commit_range(edges, one("e"), one("y")).collect()} == {"x", "y"}
    roots = spark.createDataFrame([("",), ("a",), ("a/b",)], "root string")
    got = graph.nearest_ancestor(spark.createDataFrame([("a/b/c/d.go",), ("a/bc.go",), ("z.go",)], "path string"), roots)
    assert {r.path: r.root for r in got.collect()} == {"a/b/c/d.go": "a/b", "a/bc.go": "a", "z.go": ""}
    rows = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("4", "3"), ("5", "4")], "id string, parent_id string")
    assert {r.id: r.depth for r in graph.depths(rows).collect()} == {"1": 0, "2": 1, "3": 2, "4": 3, "5": 0}
    tree = lambda x: {r.dir: r.hash for r in graph.merkle(spark.createDataFrame(x, "path string, blob string")).collect()}
    first, second = tree([("a/b/c", "1"), ("a/d", "2"), ("e", "3")]), tree([("a/b/c", "9"), ("a/d", "2"), ("e", "3")])
    assert set(first) == {".", "a", "a/b"}
    assert all(first[d] != second[d] for d in first)


def test_validators(spark):
    rows = [("r", 1, "MEDIUM", "tests", "t", 1, 2), ("r", 2, "HIGH", "tests", "t", 1, 2), ("r", 3, "HIGH", "style", "", 5, 2), ("s", 1, "x", "bug", "t", 0, 1)]
    df = spark.createDataFrame(rows, "report string, ord int, severity string, aspect string, title string, line_start int, line_end int")
    got = {(r.report, r.ord): r.errors for r in validate.findings(df).collect()}
    assert got == {("r", 1): [], ("r", 2): ["severity rises"], ("r", 3): ["style must be low", "title missing", "bad line range"], ("s", 1): ["unknown severity", "unknown aspect", "bad line range"]}
    assert {r.report: r.recommendation for r in validate.recommendation(df).collect()} == {"r": "FIX", "s": "APPROVE"}
    calls = spark.createDataFrame([("b", "1", "grep", "{}"), ("b", "1", "find", "{}"), ("b", "2", "rm", "{}")], "batch string, call_id string, name string, arguments string")
    assert sorted(r.errors for r in validate.tool_batch(calls, ["grep", "find"]).collect()) == [["repeated call id"], ["repeated call id"], ["unknown tool"]]
    seen = validate.evidence(spark.createDataFrame([("a", 1, 2), ("a", 1, 9), ("z", 1, 1)], "path string, line_start int, line_end int"), spark.createDataFrame([("a", 5)], "path string, lines int"))
    assert sorted(r.errors for r in seen.collect()) == [[], ["line end past the file"], ["unknown path"]]


def test_folds(spark):
    deltas = spark.createDataFrame([("m", 0, 1, "he", False), ("m", 0, 3, "llo", False), ("m", 1, 2, "x", False), ("m", 1, 4, " world", True)], "id string, part int, seq int, delta string, done boolean")
    assert [tuple(r) for r in folds.concatenated(deltas).collect()] == [("m", "hello world")]
    runs = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, None)], "g int, o int, v string")
    assert {r.g: (r.run, r.value) for r in folds.leading_run(runs, "g", "o", "v").collect()} == {1: (2, "a"), 2: (1, None)}
    sized = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 5, 20, 1])], "g string, o int, size int")
    assert [r.batch for r in ranks.greedy_batches(sized, "g", "o", "size", 2, 12).orderBy("o").collect()] == [0, 0, 1, 2, 3]



def test_scan(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", ".hidden/x.py": b"x", "d/.env": b"x", "d/b.txt": b"a\0b", "d/big.txt": b"x" * ((1 << 20) + 1), "p.png": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = files.scan(spark, f"file:{tmp_path}")
    reasons = {r.path: r.reason for r in got.select("path", "reason").collect()}
    assert {k.removeprefix(str(tmp_path).lstrip("/")).lstrip("/"): v for k, v in reasons.items()} == {"a.py": None, "d/b.txt": "binary", "d/big.txt": "oversized", "p.png": "non_text"} | {k: v for k, v in {".hidden/x.py": "dot_dir", "d/.env": "dot_file"}.items() if k in reasons}


def test_vectors_from_files(spark, tmp_path):
    import numpy as np

    np.arange(6, dtype="<f4").tofile(tmp_path / "v.bin")
    got = files.float_vectors(spark.read.format("binaryFile").load(f"file://{tmp_path}/v.bin"), 3).orderBy("n").collect()
    assert [r.vector for r in got] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    packs = spark.createDataFrame([(0, 0, [1.0])], "pack int, slot int, vector array<float>")
    with pytest.raises(Exception, match="no vector at 0/1"):
        files.referenced(spark.createDataFrame([(0, 1)], "pack int, slot int"), packs).collect()
    near = files.hashed_embeddings(spark.createDataFrame([("a b",), ("a b",), ("",)], "text string")).collect()
    assert near[0].vector == near[1].vector != near[2].vector
