"""Streams run to their end."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.operators import store
from tesserae.sources import files
from tesserae.streaming import folds


def test_incremental_index(spark, tmp_path):
    """Arriving files are embedded once; a second run finds nothing new."""
    spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "z")], "path string, text string").write.parquet(f"{tmp_path}/in")
    target = f"file://{tmp_path}/store"
    for turn in range(2):
        stream = spark.readStream.schema("path string, text string").parquet(f"{tmp_path}/in")
        writer = folds.indexed(stream, target, lambda d: d.withColumn("embedding_input_hash", V.input_hash(F.col("text"))), lambda d: files.hashed_embeddings(d).select("embedding_input_hash", "vector"))
        writer.option("checkpointLocation", f"{tmp_path}/check{turn}").trigger(availableNow=True).start().awaitTermination(90)
    assert folds.index_entries(spark, target, SCHEMA).count() == 2
    assert spark.read.parquet(f"{target}/data").count() == 2


SCHEMA = "embedding_input_hash string, vector array<float>"


def test_replayed_batches_and_buckets(spark, tmp_path):
    """A batch that is replayed adds nothing; a batch reads its own buckets only; settling keeps all entries."""
    target, asked = f"file://{tmp_path}/store", spark.sparkContext.accumulator(0)
    chunk = lambda d: d.withColumn("embedding_input_hash", V.input_hash(F.col("text")))

    def embed(rows):
        asked.add(rows.count())
        return files.hashed_embeddings(rows).select("embedding_input_hash", "vector")

    def run(n, words):
        spark.createDataFrame([(w,) for w in words], "text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
        folds.indexed(stream, target, chunk, embed).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)

    run(0, [f"w{i}" for i in range(40)])
    run(1, ["w1", "w1", "new"])
    assert asked.value == 41 and folds.index_entries(spark, target, SCHEMA).count() == 41
    # the last batch is taken for unfinished: its commit goes, and it runs again
    import glob
    import os

    for f in glob.glob(f"{tmp_path}/check/commits/1") + glob.glob(f"{tmp_path}/check/commits/.1.crc"):
        os.remove(f)
    run(2, [])
    assert spark.read.parquet(f"{target}/data").count() == 41
    batches = spark.read.schema(f"{SCHEMA}, batch string, bucket int").parquet(f"{target}/data")
    one = batches.where("bucket = 3")
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    assert folds.settle(spark, target, SCHEMA) == 41
    assert not glob.glob(f"{tmp_path}/store/data/batch=*/bucket=*") and folds.index_entries(spark, target, SCHEMA).count() == 41
    before = asked.value
    run(3, ["w5", "late"])
    assert asked.value == before + 1 and folds.index_entries(spark, target, SCHEMA).count() == 42


def test_live_sessions(spark, tmp_path):
    spark.sql("select 1 as user, timestamp'2024-01-01 00:00:00' as ts union all select 1, timestamp'2024-01-01 00:00:10' union all select 1, timestamp'2024-01-01 00:05:00'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user int, ts timestamp").parquet(f"{tmp_path}/in")
    q = folds.live_sessions(stream, "user", "ts").writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_history_and_ranks(spark):
    rows = spark.range(250).select(F.col("id").alias("ord"))
    assert store.kept_history(rows).agg(F.min("ord"), F.count("*")).first() == (150, 100)
    assert [r.n for r in store.ranked(spark.range(100).select(F.col("id").alias("k")), "k").orderBy("k").collect()] == list(range(100))


def test_intake_cases():
    """Batches by a fixed clock: concurrent callers, the grace time, three at most, silence, the time limit."""
    intake = lambda **x: folds.Intake(**({"items": 3, "wait": 120_000, "grace": 100, "stale": 30_000} | x))
    i = intake()
    both = [(0, "intent", "a"), (0, "intent", "b"), (50, "ready", "a"), (50, "ready", "b")]
    assert i.until(10_000, both) == [(0, "a", "idle"), (0, "b", "idle")]  # two concurrent callers, one batch
    late = [(0, "intent", "a"), (10, "ready", "a"), (85, "intent", "b"), (90, "ready", "b")]
    assert intake().until(10_000, late) == [(0, "a", "idle"), (0, "b", "idle")]  # the second comes within the grace time
    assert intake(grace=0).until(10_000, late) == [(0, "a", "idle"), (1, "b", "idle")]  # without grace they don't meet
    four = [(0, "intent", x) for x in "abcd"] + [(5, "ready", x) for x in "abcd"]
    assert intake().until(10_000, four) == [(0, "a", "count"), (0, "b", "count"), (0, "c", "count"), (1, "d", "idle")]
    silent = [(0, "intent", "a"), (0, "intent", "b"), (5, "ready", "a"), (20_000, "beat", "b")]
    i = intake()
    assert i.until(49_999, silent) == [] and i.until(50_000, []) == [(0, "a", "idle")]  # b's last sign was at 20 s
    assert i.until(60_000, [(55_000, "ready", "b")]) == [(-1, "b", "expired")]
    beats = [(0, "intent", "a"), (0, "intent", "b"), (5, "ready", "a"), *((t, "beat", "b") for t in range(10_000, 200_000, 10_000))]
    assert intake().until(120_105, beats) == [(0, "a", "time")]
    assert intake().until(200, [(0, "intent", "a"), (0, "intent", "b"), (5, "ready", "a"), (120, "gone", "b")]) == [(0, "a", "idle")]
    assert intake().due() is None


def test_batches_on_a_stream(spark, tmp_path):
    """Events in several files and any order, over restarts, as one pass by time has them."""
    r = random.Random(4)
    rows = []
    for key in "xyz":
        for n in range(12):
            at, i = r.randrange(0, 100_000), f"{key}{n}"
            rows.append((key, i, "intent", at))
            for _ in range(r.randrange(3)):
                rows.append((key, i, "beat", at := at + r.randrange(1, 35_000)))
            if r.random() < 0.9:
                rows.append((key, i, r.choice(["ready", "ready", "ready", "gone"]), at + r.randrange(1, 35_000)))
    want = []
    for key in "xyz":
        got = folds.Intake(3, 20_000, 100, 30_000).until(10**9, [(at, kind, i) for k, i, kind, at in rows if k == key])
        want += [(key, *x) for x in got]
    rows.sort(key=lambda x: x[3])
    schema = "key string, id string, kind string, ms bigint"
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # each file in any order; a later one brings events that are at most a second late; the last pushes the clock
        cuts = [rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :], [("end", "end", "intent", 10**7)], [("end", "end2", "intent", 2 * 10**7)]]
        for n, part in enumerate(cuts):
            r.shuffle(part)
            spark.createDataFrame(part, schema).withColumn("at", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("key string, id string, kind string, at timestamp").parquet(f"{tmp_path}/in")
            q = folds.batched(stream, 3, 20_000).writeStream.option("checkpointLocation", f"{tmp_path}/check").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            q.awaitTermination(120)
        got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").select("key", "batch", "id", "reason").where("key <> 'end'").collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    assert (sorted(set(got) - set(want)), sorted(set(want) - set(got))) == ([], [])
    assert sorted(got) == sorted(want) and {x[3] for x in want} == {"count", "idle", "time", "expired"}
    sizes = defaultdict(int)
    for key, n, _, reason in got:
        sizes[key, n] += reason != "expired"
    assert max(sizes.values()) == 3
