"""Packs, snapshots, clean-up and inventories."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import web as W
from tesserae.operators import inventory, packs, store
from tesserae.plans.graph import written

KEY = hashlib.sha256(b"m\0" + b"4").digest()


def vectors(n: int) -> list[tuple[bytes, bytes, bytes]]:
    r = np.random.default_rng(n)
    out = []
    for i in range(n):
        data = r.standard_normal(4).astype("<f4").tobytes()
        out.append((hashlib.sha256(str(i).encode()).digest(), hashlib.sha256(data).digest(), data))
    return out


def test_pack_round_trip():
    items = vectors(5)
    content = packs.encoded(4, KEY, items)
    assert len(content) == 52 + 5 * (68 + 16)
    got = packs.decoded(content, hashlib.sha256(content).hexdigest())
    assert list(zip(got.embedding_key, got.vector_digest, (v.tobytes() for v in got.vector), strict=True)) == sorted(items)
    for bad, why in ((content[:40], "header"), (b"x" + content[1:], "not a pack"), (content[:-1], "size"), (content[:-1] + b"\1", "content")):
        with pytest.raises(ValueError, match=why):
            packs.decoded(bad, hashlib.sha256(content).hexdigest())
    broken = bytearray(content)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        packs.decoded(bytes(broken), "")
    with pytest.raises(ValueError, match="twice"):
        packs.encoded(4, KEY, [*items, items[0]])
    with pytest.raises(ValueError, match="digest"):
        packs.encoded(4, KEY, [(items[0][0], items[1][1], items[0][2])])


def test_packs_as_tables(spark, tmp_path):
    rows = spark.createDataFrame(vectors(50), "embedding_key binary, vector_digest binary, data binary")
    made = written(packs.packed(rows.unionByName(rows), 4, KEY, size=16 * 8))
    assert made.count() == 7  # eight vectors each, the last with two
    back = packs.entries(made)
    assert back.join(rows, (back.embedding_key == rows.embedding_key) & (W.float_bytes(back.vector) == rows.data)).count() == 50
    found = packs.catalog(back)
    assert found.count() == 50
    folder = f"file://{tmp_path}/packs"
    for _ in range(2):
        packs.write_packs(made, folder)
    assert spark.read.parquet(folder).count() == 7
    cache = f"file://{tmp_path}/cache"
    assert packs.cached_catalog(made, cache, "h1").count() == 50
    assert packs.cached_catalog(made.limit(0), cache, "h1").count() == 50  # from the cache
    assert packs.cached_catalog(made.limit(1), cache, "h2").count() == 8  # another head


def test_snapshots_and_reconciliation(spark):
    schema = "chunk_id string, path string, start_line int, embedding_input_hash string, vector array<float>"
    rows = spark.createDataFrame([(f"c{i}", f"p{i % 3}", i, hashlib.sha256(str(i % 4).encode()).hexdigest(), [float(i % 4)] * 4) for i in range(8)], schema)
    none = spark.createDataFrame([], "embedding_key binary, vector_digest binary, pack string, slot int")
    refs, made = packs.snapshot_rows(rows, none, 4, KEY)
    refs, made = written(refs), written(made)
    assert refs.count() == 8
    assert refs.select("pack", "slot").distinct().count() == 4
    known = packs.catalog(packs.entries(made))
    again, more = packs.snapshot_rows(rows, known, 4, KEY)
    assert more.count() == 0
    assert store.same_rows(again, refs)
    assert packs.unresolved(refs, packs.entries(made).select("pack", "slot")).count() == 0
    assert sorted(r.error for r in packs.unresolved(refs.limit(1).withColumn("slot", F.lit(99)), packs.entries(made)).collect()) == ["no such entry"]
    side = lambda rows_: spark.createDataFrame(rows_, "origin string, revision string, model string, dimensions int, chunk_id string, vector_digest string, pack string, slot int")
    a, b = side([("o", "r", "m", 4, "1", "x", "p1", 0), ("o", "r", "m", 4, "2", "y", "p1", 1)]), side([("o", "r", "m", 4, "1", "x", "p0", 3), ("o", "r2", "m", 4, "1", "z", "p1", 1)])
    assert packs.reconciled(a, b).count() == 3
    with pytest.raises(Exception, match="two vectors"):
        packs.reconciled(a, side([("o", "r", "m", 4, "1", "other", "p0", 3)])).collect()
    assert packs.migration_summary(rows.withColumns({"origin": F.lit("o"), "revision": F.lit("r")}), made).first()[:4] == (1, 8, 4, 1)


def test_clean_up(spark):
    entry = lambda k, o: (k, o, 4, 100 + o)
    catalog = spark.createDataFrame([entry("a", 0), entry("b", 16), entry("c", 32)], "vector_key string, offset bigint, dimensions int, checksum bigint")
    live = spark.createDataFrame([("c", 4, 132), ("a", 4, 100), ("a", 4, 100)], "vector_key string, dimensions int, checksum bigint")
    kept, payload, sums = packs.compacted(catalog, catalog.select("vector_key"), live)
    assert sorted((r.vector_key, r.offset) for r in kept.collect()) == [("a", 0), ("c", 16)]
    assert payload.count() == 2
    assert sums.first()[:] == (3, 2, 16, False)
    assert packs.gc_summary(sums.unionByName(sums)).first()[:] == (2, 2, 2, 32)
    with pytest.raises(Exception, match="isn't in the catalog"):
        packs.compacted(catalog, catalog, live.withColumn("checksum", F.lit(1).cast("long")))[0].collect()
    names = spark.createDataFrame([(f"catalog-{g:020d}.json",) for g in (1, 2, 3)] + [("catalog-1.json",), ("x",)], "name string")
    assert sorted((int(r.generation), r.kept) for r in packs.newest(names).collect()) == [(1, False), (2, True), (3, True)]
    assert names.limit(1).select(packs.catalog_name(F.lit(7))).first()[0] == "catalog-00000000000000000007.json"


def test_sync_trees(spark):
    sha, oid = "a" * 64, "b" * 40
    listing = [(".", "directory"), ("schema.json", "file"), (f"indexes/{sha}/{oid}", "directory"), (f"indexes/{sha}/{oid}/{sha}.json", "file"), (f"packs/{sha}/{sha}.pack", "file"), (".git/x", "file")]
    bad = [(f"indexes/{sha}/{oid}/{'c' * 16}.json", "file"), ("extra", "file"), (f"packs/{sha}/x.pack", "file"), ("schema.json", "symlink"), ("indexes", "file")]
    df = spark.createDataFrame(listing + bad, "path string, kind string")
    assert sorted((r.path) for r in packs.tree_errors(df, 2).collect()) == sorted(p for p, _ in bad)
    first = {r.path for r in packs.tree_errors(df, 1).collect()}
    assert f"indexes/{sha}/{oid}/{'c' * 16}.json" not in first
    assert f"packs/{sha}/{sha}.pack" in first
    files = df.where("kind = 'file'").select("path", F.lit(10).cast("long").alias("size"))
    assert packs.tree_statistics(files).first()[:] == (2, 2, 80)
    assert [r.path for r in packs.legacy_manifests(files).collect()] == [f"indexes/{sha}/{oid}/{'c' * 16}.json"]
    assert packs.strict_tree(files).count() == 4
    one = spark.range(1)
    assert one.select(packs.sync_path(F.lit("o"), F.lit(oid), F.lit("m"), F.lit(4))).first()[0] == f"indexes/{hashlib.sha256(b'o').hexdigest()}/{oid}/{hashlib.sha256(b'm' + bytes(1) + b'4').hexdigest()}.json"


def test_shared_vectors_and_reuse(spark):
    schema = "vector_key string, dimensions int, checksum bigint"
    payload = spark.createDataFrame([("k", [1.0, 2.0])], "vector_key string, vector array<float>")
    crc = payload.select(F.crc32(W.float_bytes(F.col("vector")))).first()[0]
    index, catalog = spark.createDataFrame([("k", 2, crc)], schema), spark.createDataFrame([("k", 2, crc)], schema)
    assert packs.shared_vectors(index, catalog, payload).first().vector == [1.0, 2.0]
    for wrong in (spark.createDataFrame([("x", 2, crc)], schema), spark.createDataFrame([("k", 2, 7)], schema), spark.createDataFrame([("k", 3, crc)], schema)):
        with pytest.raises(Exception, match="missing or differs"):
            packs.shared_vectors(wrong, catalog, payload).collect()
    records = spark.createDataFrame([("i", "h", "m", 2, [1.0, 2.0]), ("j", "", "m", 2, [3.0, 4.0]), ("t", "h", "m", 2, [9.0, 9.0])], "index string, embedding_input_hash string, embedding_model string, dimensions int, vector array<float>")
    assert [r.vector for r in packs.exact_reuse(spark.createDataFrame([("h",), ("g",)], "embedding_input_hash string"), records, "m", 2, "t").collect()] == [[1.0, 2.0]]
    refs = packs.index_rows(records).collect()
    assert [(r.vector_key is None, r.vector) for r in refs] == [(False, None), (True, [3.0, 4.0]), (False, None)]
    kept, every = packs.compatible_rows(records, "m", 2, "index")
    assert (kept.count(), every) == (2, False)


def test_inventories(spark):
    manifests = spark.createDataFrame([("fs/0/scope-1", "filesystem", "", "", None), ("revs/abc", "revision", "abc", "o", None), ("revs/x", "revision", "x", "", None)], "dir string, mode string, resolved_rev string, origin_identity string, remote string")
    entries = spark.createDataFrame([("fs/0/scope-1", "a.go"), ("fs/0/scope-1", "a.go"), ("fs/0/scope-1", ""), ("revs/abc", "b_test.go"), ("revs/abc", "a.go")], "dir string, path string")
    got = inventory.indexes(manifests, entries).collect()
    assert [(r.dir, r.files, r.chunks, r.filters) for r in got] == [("fs/0/scope-1", 1, 3, ["scope-1"]), ("revs/abc", 2, 2, [])]
    assert [r.path for r in inventory.indexed_files(entries.where("dir = 'revs/abc'"), no_tests=True).collect()] == ["a.go"]
    assert [r.skipped for r in inventory.sync_targets(manifests).orderBy("dir").collect()] == [True, False, True]
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    items = spark.createDataFrame([("b", True, "2024-01-01 00:00:59"), ("b", False, "2024-01-01 00:00:10"), ("c", False, "2024-01-01 00:00:50")], "batch string, consumed boolean, h string").withColumn("heartbeat_at", F.col("h").cast("timestamp"))
    assert [r.batch for r in inventory.finished_batches(items, now).collect()] == ["b"]
    assert sorted(map(tuple, inventory.live_intents(items, now, "batch").collect())) == [("b", 1), ("c", 1)]
    records = spark.createDataFrame([("k", '{"id":"k"}'), ("l", '{"id":"k"}'), ("m", "{")], "id string, json string")
    assert [inventory.record(records, k).first().errors for k in "klm"] == [[], ["id isn't the key"], ["not JSON", "id isn't the key"]]
    one = spark.range(1)
    ids = one.select(inventory.project_id(F.lit("/a/"), F.lit("git@h.org:x/y.git")), inventory.project_id(F.lit("/a//b/./c/"), F.lit(None).cast("string"))).first()
    assert ids[:] == tuple(hashlib.sha256(x).hexdigest() for x in (b"h.org/x/y", b"/a/b/c"))
    where = one.select(inventory.index_dir("B", F.lit("filesystem"), F.lit("/r"), F.lit(""), F.array(F.lit(".x"))), inventory.index_dir("B", F.lit("revision"), F.lit("/r"), F.lit("abc"), F.array(F.lit("x")))).first()
    assert where[:] == (f"B/search/fs/{hashlib.sha256(b'/r').hexdigest()[:16]}/scope-{hashlib.sha256(b'.x').hexdigest()[:16]}", "B/search/revs/abc")
    listing = manifests.withColumns({"root": F.lit("/r"), "files": F.lit(1), "chunks": F.lit(2), "embedding_model": F.lit("m"), "dimensions": F.lit(4), "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp"), "filters": F.array(F.lit("a"), F.lit("b"))})
    assert inventory.index_lines(listing).first().text == "filesystem root=/r filters=a,b files=1 chunks=2 model=m dims=4 created=2024-01-01T00:00:00Z\n  fs/0/scope-1\n"
    tasks = spark.createDataFrame([("t", None), ("u", ("done", "1"))], "task string, terminal struct<kind:string,at:string>")
    events = spark.createDataFrame([("t", 2, "failed", "2"), ("t", 1, "completed", "1"), ("u", 1, "failed", "0")], "task string, seq int, kind string, at string")
    assert sorted((r.task, r.terminal.kind) for r in inventory.terminal(tasks, events).collect()) == [("t", "completed"), ("u", "done")]
    sessions = spark.createDataFrame([("p", "w", 3, "x"), ("q", "w", 1, "y")], "id string, workspace string, depth int, target string")
    assert inventory.follow_up(sessions, "q", "w").first()[:] == ("q", 2, "y", True)
    assert inventory.follow_up(sessions, "p", "w").first()[:] == ("p", 0, "x", False)
    assert inventory.follow_up(sessions, "p", "other").count() == 0
    lines = inventory.dispositions(spark.createDataFrame([("b", "i", "w", "answered", "a\n secret  b", "2024-01-01 00:00:00")], "batch string, id string, workspace string, disposition string, question string, a string").withColumn("arrived_at", F.col("a").cast("timestamp")), ["secret"])
    assert lines.first().line == '2024-01-01T00:00:00Z batch=b item=i workspace=w disposition=answered question={"q":"a [REDACTED] b"}'
    stream = spark.createDataFrame([("s", "2024-01-01 00:00:02", 1, "b", "{}"), ("s", "2024-01-01 00:00:01", 0, "a", "{}")], "stream string, t string, ord int, kind string, value string").withColumn("at", F.col("t").cast("timestamp"))
    assert sorted((r.seq, r.kind, r.at) for r in inventory.event_stream(stream).collect()) == [(1, "a", "2024-01-01T00:00:01.000000Z"), (2, "b", "2024-01-01T00:00:02.000000Z")]
