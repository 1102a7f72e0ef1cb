"""Readers of records, chunk bodies on disk, and facts of a repository."""

from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tesserae.operators import inventory, packs, retrieve, views

ROW = {"chunk_id": "c1", "path": "a.go", "start_line": 1, "end_line": 9, "content_hash": "h", "embedding_input_hash": "e", "embedding_model": "m", "dimensions": 2}


def test_index_and_legacy_vectors(spark, tmp_path):
    """JSON arrays over several lines; what doesn't fit the types is an error, what is missing is null."""
    (tmp_path / "i.json").write_text(json.dumps([ROW | {"vector_key": "k", "checksum": 7, "size": 10, "extra": 1}, {"chunk_id": "c2"}], indent=1))
    got = {r.chunk_id: r for r in inventory.index_metadata(spark, f"file://{tmp_path}/i.json").collect()}
    assert (got["c1"].checksum, got["c1"].end_line, got["c2"].path) == (7, 9, None)
    (tmp_path / "v.json").write_text(json.dumps([ROW | {"vector": [0.5, -1.0]}]))
    assert list(packs.legacy_vectors(spark, f"file://{tmp_path}/v.json").first().vector) == [0.5, -1.0]
    (tmp_path / "bad.json").write_text(json.dumps([ROW | {"dimensions": "two"}]))
    for read in (inventory.index_metadata, packs.legacy_vectors):
        with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED"):
            read(spark, f"file://{tmp_path}/bad.json").collect()


def test_query_history(spark, tmp_path):
    """Entries keep their order; those of older versions lack filters, and aren't replayed for code."""
    entries = [{"query": f"q{i}", "normalized": f"q{i}", "query_embedding": [1.0, 0.0], "created_at": "2024-01-01T00:00:00Z", "filters": None if i % 2 else {"code": True, "no_tests": False, "scope": []}} for i in range(6)]
    (tmp_path / "h.json").write_text(json.dumps(entries))
    h = inventory.query_history(spark, f"file://{tmp_path}/h.json")
    assert [r["query"] for r in h.orderBy("ord").collect()] == [f"q{i}" for i in range(6)]
    same = lambda *x: [r["query"] for r in h.where(retrieve.same_filters(*x)).orderBy("ord").collect()]
    assert same(True, False, []) == ["q0", "q2", "q4"] and same(False, False, []) == ["q1", "q3", "q5"] and same(True, True, []) == []


def test_bodies_on_disk(spark):
    """Bodies come from disk as often as they are read, and are released."""
    kept = retrieve.on_disk(spark.range(1000).selectExpr("id", "repeat('x', 100) as body"))
    assert kept.count() == kept.distinct().count() == 1000
    assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    kept.unpersist()
    assert not kept.storageLevel.useDisk


def test_repository_facts(spark):
    refs = spark.createDataFrame([("HEAD", "refs/heads/main", None), ("refs/heads/main", None, "abc")], "name string, target string, hash string")
    assert tuple(views.repository_summary(refs, {"origin": "u"}, "/r").first()) == ("/r", "main", False, {"origin": "u"}, "repository")
    loose = spark.createDataFrame([("HEAD", None, "abc")], "name string, target string, hash string")
    assert tuple(views.repository_summary(loose, {}, "/r", "parent-with-submodules").first()) == ("/r", "abc", True, {}, "parent-with-submodules")
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    assert views.submodule_only(paths("lib", "ext"), paths("lib", "ext", "more"))
    assert not views.submodule_only(paths("lib", "a.go"), paths("lib")) and not views.submodule_only(paths(), paths("lib")) and not views.submodule_only(paths("lib"), paths())
