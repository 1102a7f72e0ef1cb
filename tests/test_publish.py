"""Saves that are killed, broken and withdrawn snapshots, clean-up."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from tesserae.operators import store


def rows(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("k"), "id")


def folders(root):
    return {os.path.basename(x) for x in glob.glob(f"{root}/snapshots/*")}


@pytest.mark.parametrize("replace", [False, True])
def test_killed_saves(spark, tmp_path, replace):
    """However far a save has come, a whole snapshot is read; the next save works and removes what was left."""
    root = f"file://{tmp_path}"
    with pytest.raises(ValueError, match="no whole"):
        store.current(spark, root)
    store.publish(rows(spark, 3), root)
    store.publish(rows(spark, 5), root)
    steps = len(list(store.publish_steps(rows(spark, 6), root, replace=replace)))
    assert steps == 4 + replace
    for n in range(1, steps + 1):
        save = store.publish_steps(rows(spark, 7 + n), root, replace=replace)
        done = [next(save) for _ in range(n)]
        save.close()
        seen = store.current(spark, root).count()
        assert seen == (7 + n if len(done) >= steps - 1 else seen) and seen >= 5
    store.publish(rows(spark, 50), root, abandoned_hours=0)
    assert store.current(spark, root, deep=True).count() == 50
    assert len(folders(tmp_path)) == store.GENERATIONS and store.clean(spark, root, 0) == []


def test_broken_snapshots(spark, tmp_path):
    """Missing and broken files, and rows that were changed, lead to the snapshot before."""
    root = f"file://{tmp_path}"
    for n in (4, 6):
        last = store.publish(rows(spark, n).coalesce(1), root)
    file = glob.glob(f"{tmp_path}/snapshots/{last}/*.parquet")[0]
    good = open(file, "rb").read()
    open(file, "wb").write(b"corrupt")
    for crc in glob.glob(f"{tmp_path}/snapshots/{last}/.*.crc"):
        os.remove(crc)
    assert store.current(spark, root).count() == 4
    open(file, "wb").write(good)
    assert store.current(spark, root).count() == 6
    os.remove(file)
    assert store.current(spark, root).count() == 4
    rows(spark, 6).withColumn("k", F.lit("other")).write.mode("append").parquet(f"{root}/snapshots/{last}")
    assert store.current(spark, root).count() == 6 and store.current(spark, root, deep=True).count() == 4


def test_swept(spark, tmp_path):
    root = f"file://{tmp_path}"
    store.publish(rows(spark, 10), root)
    live = spark.range(6).select(F.col("id").cast("string").alias("k"))
    assert store.swept(spark, root, live, "k") == {"live": 6, "dead": 4}
    assert sorted(r.id for r in store.current(spark, root).collect()) == list(range(6))
    before = folders(tmp_path)
    assert store.swept(spark, root, live, "k") == {"live": 6, "dead": 0} and folders(tmp_path) == before
