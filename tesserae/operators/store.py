"""A versioned vector store: reuse, precedence and strict merges, packs and clean-up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import running


def compatible(model: str, dims: int) -> Column:
    """Rows of a model and dimension with an input hash."""
    return (F.col("embedding_model") == model) & (F.col("dimensions") == dims) & (F.size("vector") == dims) & (F.coalesce("embedding_input_hash", F.lit("")) != "")


def reuse(chunks: DataFrame, pool: DataFrame, order: str = "ord") -> DataFrame:
    """Chunks with the pool's last vector of their input hash; all else comes from the chunk."""
    last = pool.groupBy("embedding_input_hash").agg(F.max_by("vector", order).alias("vector"))
    return chunks.join(last, "embedding_input_hash")


def missing(chunks: DataFrame, vectors: DataFrame, on: str = "chunk_id") -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors, on, "left_anti")


def missing_hashes(chunks: DataFrame, pool: DataFrame) -> DataFrame:
    """Distinct input hashes that the pool lacks."""
    return chunks.select("embedding_input_hash").distinct().join(pool, "embedding_input_hash", "left_anti")


def precedence(base: DataFrame, incoming: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Rows by key; the base's win over incoming ones, the first incoming over later ones."""
    both = base.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    group = both.groupBy(key)
    has = group.agg(F.min(F.struct("_side", order, *[c for c in both.columns if c not in (key, order, "_side")])).alias("r"))
    return has.select(key, *[F.col(f"r.{c}").alias(c) for c in base.columns if c != key])


def conflicts(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys with several payloads; a strict union must have none."""
    return rows.groupBy(key).agg(F.min(payload).alias("_a"), F.max(payload).alias("_b")).where("_a <> _b").select(key)


def strict(base: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """The union of rows by key; the same key with another payload is an error when read."""
    both = base.unionByName(incoming).groupBy(key).agg(F.min(payload).alias(payload), F.max(payload).alias("_b"))
    bad = F.raise_error(F.concat(F.lit("conflicting payload of "), F.col(key).cast("string"))).cast("boolean")
    return both.where(F.when(F.col(payload) == F.col("_b"), True).otherwise(bad)).drop("_b")


def imported(local: DataFrame, remote: DataFrame, key: str, location: str) -> DataFrame:
    """Remote rows, and local ones whose key and location the remote lacks."""
    own = local.join(remote.select(key), key, "left_anti").join(remote.select(location), location, "left_anti")
    return remote.unionByName(own.select(*remote.columns))


def preserved(records: DataFrame, old: DataFrame, key: str, outside: Column) -> DataFrame:
    """Records, and old rows outside the scope whose key is absent."""
    return records.unionByName(old.where(outside).join(records.select(key), key, "left_anti").select(*records.columns))


def rows_changed(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty if the scope didn't change."""
    a, b = (d.select(key).distinct() for d in (new, old))
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """A gapless ``n`` from 0 in order."""
    return running(rows, list(order))


def packs(rows: DataFrame, dims: int, *order: str, size: int = 16 << 20) -> DataFrame:
    """Pack and slot of each row in key order, packs of a size."""
    each = max(1, size // (4 * dims))
    return ranked(rows, *order).withColumns({"pack": F.floor(F.col("n") / each), "slot": F.col("n") % each}).drop("n")


def byte_offsets(rows: DataFrame, dims: str, order: str) -> DataFrame:
    """The exclusive running sum of 4 * dims bytes in key order."""
    return running(rows, [order], {"offset": F.col(dims).cast("long") * 4}).drop("n")


def smallest_slot(rows: DataFrame) -> DataFrame:
    """The least (pack, slot) of each key and digest."""
    return rows.groupBy("embedding_key", "vector_digest").agg(F.min(F.struct("pack", "slot")).alias("p")).select("embedding_key", "vector_digest", "p.pack", "p.slot")


def garbage(catalog: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Catalog rows that no live index names."""
    return catalog.join(live.select(key), key, "left_anti")


#: Fixed value: published generations that stay readable.
GENERATIONS = 2


def _added(spark: SparkSession, root: str, table: str, **values: Column) -> None:
    """Append one row to a table of a store, as one file."""
    spark.range(1).select(*(v.alias(k) for k, v in values.items()), F.current_timestamp().alias("created_at")).coalesce(1).write.mode("append").parquet(f"{root}/{table}")


def _digest(rows: DataFrame) -> tuple[int, str]:
    """Number and digest of rows in any order."""
    n, d = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")).first()
    return n, d or "0"


def publish_steps(rows: DataFrame, root: str, mode: str = "filesystem", replace: bool = False, abandoned_hours: float = 24, partition_by: tuple[str, ...] = ()) -> Iterator[str]:
    """Save rows as a new snapshot, step by step (A40, A43, M39): after each of them a reader finds a whole snapshot.

    With ``replace`` the current snapshot is withdrawn first, so that what is read meanwhile is the one before it. The save is
    announced; the rows are written to a folder of their own and read back; the manifest with their number and digest comes last and makes
    them current. Then folders go that neither of the newest two manifests names: older snapshots, and saves that were announced
    ``abandoned_hours`` ago and have no manifest.
    """
    spark, snapshot = rows.sparkSession, uuid.uuid4().hex
    if replace:
        last = current_manifest(spark, root)
        if last is not None:
            _added(spark, root, "withdrawn", snapshot=F.lit(last["snapshot"]))
        yield "withdrawn"
    _added(spark, root, "announced", snapshot=F.lit(snapshot))
    yield "announced"
    rows.write.partitionBy(*partition_by).parquet(f"{root}/snapshots/{snapshot}")
    yield "written"
    n, digest = _digest(spark.read.parquet(f"{root}/snapshots/{snapshot}"))
    _added(spark, root, "manifests", version=F.lit(3), mode=F.lit(mode), snapshot=F.lit(snapshot), chunk_count=F.lit(n), digest=F.lit(digest))
    yield snapshot
    clean(spark, root, abandoned_hours)
    yield "cleaned"


def publish(rows: DataFrame, root: str, mode: str = "filesystem", **options) -> str:
    """All steps of a save; the snapshot's name."""
    return next(x for x in list(publish_steps(rows, root, mode, **options)) if x not in ("withdrawn", "announced", "written"))


def retained(manifests: DataFrame, most: int = GENERATIONS) -> DataFrame:
    """Manifests with ``kept``: whether a snapshot is of the newest generations."""
    newest = manifests.orderBy(F.desc("created_at"), F.desc("snapshot")).limit(most).select("snapshot", F.lit(True).alias("kept"))
    return manifests.join(F.broadcast(newest), "snapshot", "left").fillna(False, ["kept"])


_MANIFEST = "version int, mode string, snapshot string, chunk_count bigint, digest string, created_at timestamp"
_MARK = "snapshot string, created_at timestamp"


def clean(spark: SparkSession, root: str, abandoned_hours: float = 24) -> list[str]:
    """Remove the folders of snapshots that no reader can want; a second call finds none (A43, M39). Returns their names."""
    known = retained(stored(spark, f"{root}/manifests", _MANIFEST)).select("snapshot", "kept")
    old = F.col("created_at") <= F.current_timestamp() - F.make_interval(secs=F.lit(float(abandoned_hours) * 3600))
    announced = stored(spark, f"{root}/announced", _MARK).join(known, "snapshot", "left").where(F.when(F.col("kept").isNull(), old).otherwise(~F.col("kept")))
    gone = announced.select("snapshot").distinct().join(stored(spark, f"{root}/removed", _MARK), "snapshot", "left_anti")
    names = [r.snapshot for r in gone.toLocalIterator()]  # what earlier saves left, not rows
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _added(spark, root, "removed", snapshot=F.lit(name))
    return names


def current_manifest(spark: SparkSession, root: str, deep: bool = False):
    """The newest manifest whose snapshot is whole (E08), a withdrawn one only if there is no other; None if there is none.

    Whole: its files can be read and hold the stated number of rows (from their footers); with ``deep`` also the stated digest.
    """
    marked = lambda t: stored(spark, f"{root}/{t}", _MARK).select("snapshot").distinct()
    there = stored(spark, f"{root}/manifests", _MANIFEST).join(marked("removed"), "snapshot", "left_anti").join(marked("withdrawn").withColumn("withdrawn", F.lit(True)), "snapshot", "left")
    for m in there.orderBy(F.coalesce("withdrawn", F.lit(False)), F.desc("created_at"), F.desc("snapshot")).limit(2 * GENERATIONS).collect():
        try:
            rows = spark.read.parquet(f"{root}/snapshots/{m.snapshot}")
            if rows.count() == m.chunk_count and (not deep or _digest(rows) == (m.chunk_count, m.digest)):
                return m
        except (PySparkException, Py4JJavaError):  # missing or broken files: an older snapshot serves
            continue
    return None


def current(spark: SparkSession, root: str, deep: bool = False) -> DataFrame:
    """Rows of the newest whole snapshot."""
    last = current_manifest(spark, root, deep)
    if last is None:
        raise ValueError(f"no whole snapshot below {root}")
    return spark.read.parquet(f"{root}/snapshots/{last['snapshot']}")


def swept(spark: SparkSession, root: str, live: DataFrame, key: str) -> dict[str, int]:
    """Save the current rows whose key is live as a new snapshot (M39, D23): live, dead. Without dead rows nothing is written."""
    rows = current(spark, root)
    n, dead = rows.count(), garbage(rows, live, key).count()
    if dead:
        publish(rows.join(live.select(key).distinct(), key, "left_semi").select(*rows.columns), root, "swept")
    return {"live": n - dead, "dead": dead}


def stored(spark, path: str, schema) -> DataFrame:
    """The rows at a path, none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def lacking(new: DataFrame, path: str, key: str) -> DataFrame:
    """One row of each key that the store at a path lacks."""
    there = stored(new.sparkSession, path, new.select(key).schema)
    return new.dropDuplicates([key]).join(there, key, "left_anti")


def upsert(new: DataFrame, path: str, key: str, payload: str | None = None) -> None:
    """Append the rows whose key the store lacks, one of each key (A41). With ``payload``, another payload for a key is an error."""
    if payload:
        there = stored(new.sparkSession, path, new.select(key, payload).schema)
        known = there.join(new.select(key).distinct(), key, "left_semi").unionByName(new.select(key, payload))
        bad = conflicts(known, key, payload).limit(1).collect()
        if bad:
            raise ValueError(f"another payload for key {bad[0][0]!r}")
    lacking(new, path, key).write.mode("append").parquet(path)


def kept_history(history: DataFrame, most: int = 100) -> DataFrame:
    """The last entries of a history."""
    return history.orderBy(F.desc("ord")).limit(most)
