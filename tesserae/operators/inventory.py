"""Inventories and records: indexes, remotes, sessions, tasks, queries, and how fresh they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import vectors as V
from ..functions import web as W

#: Seconds after which a heartbeat is stale, bytes of a record, follow-up depth at most.
STALE_SECONDS, RECORD_BYTES, MOST_DEPTH = 30, 1 << 20, 3
HISTORY = "query string, normalized string, query_text_hash string, query_embedding array<double>, embedding_only boolean, embedding_model string, dimensions int, source_mode string, root string, remote string, resolved_rev string, filters struct<code:boolean,no_tests:boolean,scope:array<string>>, result_chunk_ids array<string>, created_at timestamp"
INDEX = "chunk_id string, path string, source string, blob string, start_line int, end_line int, content_hash string, embedding_input_hash string, embedding_model string, dimensions int, size bigint, mtime_unix_nano bigint, vector_key string, checksum bigint"


def _array(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path)


def index_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an index's JSON array; one that doesn't fit is an error when read."""
    return _array(spark, path, INDEX)


def query_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a query history with their place (A22): ord."""
    return _array(spark, path, HISTORY).withColumn("ord", F.monotonically_increasing_id())


def snapshots(spark: SparkSession, root: str, schema: str = INDEX) -> DataFrame:
    """Rows of first-version snapshots with origin, revision and model from their path."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{root}/indexes")
    place = F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(r"/indexes/([^/]+)/([^/]+)/([^/]+)\.json$"), F.lit(0))
    parts = F.split(F.regexp_replace(F.get(place, 0), r"^/indexes/|\.json$", ""), "/")
    return rows.select("*", parts[0].alias("origin_key"), parts[1].alias("revision"), parts[2].alias("model_file"))


def filters_of(dir_: Column) -> Column:
    """Parts of an index's folder below the bucket and its id."""
    parts = P.parts(dir_)
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.filter(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p != "."))


def indexes(manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """Complete indexes with their filters, distinct files and chunks, in order.

    ``manifests``: dir, mode, resolved_rev and more; ``entries``: dir, path. Manifests without entries are left out.
    """
    counts = entries.groupBy("dir").agg(F.count_distinct(F.when(F.coalesce("path", F.lit("")) != "", F.col("path"))).alias("files"), F.count("*").alias("chunks"))
    return manifests.join(counts, "dir").withColumn("filters", filters_of(F.col("dir"))).orderBy("mode", "resolved_rev", F.array_join("filters", ","), "dir")


def remotes(records: DataFrame) -> DataFrame:
    """Cached remotes by address."""
    return records.where(F.coalesce("remote", F.lit("")) != "").orderBy("remote")


def indexed_files(entries: DataFrame, scope: list[str] | None = None, no_tests: bool = False) -> DataFrame:
    """Distinct paths of an index in order."""
    out = entries.where((F.coalesce("path", F.lit("")) != "") & P.in_scope(F.col("path"), P.normalized_scope(scope or [])))
    return (out.where(~P.is_test(F.col("path"))) if no_tests else out).select("path").distinct().orderBy("path")


def path_list(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct paths of each group, counted and sorted."""
    kept = F.collect_set(F.when(F.col("path") != "", F.col("path")))
    return rows.groupBy(*keys).agg(F.size(kept).cast("long").alias("n_paths"), F.array_sort(kept).alias("paths"))


def sync_targets(manifests: DataFrame) -> DataFrame:
    """Which indexes can be synchronised (A32): revision and remote ones with a known origin; others are counted by ``skipped``."""
    good = F.col("mode").isin("revision", "remote") & (F.coalesce("origin_identity", F.lit("")) != "") & (F.coalesce("resolved_rev", F.lit("")) != "")
    return manifests.withColumn("skipped", ~good)


def record(rows: DataFrame, key: str, json: str = "json") -> DataFrame:
    """One record by key (A33): errors tell of size, JSON and an id that isn't the key's."""
    at = rows.where(F.col("id") == key)
    inner = F.try_variant_get(F.try_parse_json(json), "$.id", "string")
    bad = F.array_compact(F.array(
        F.when(F.octet_length(json) > RECORD_BYTES, "record is too large"), F.when(F.try_parse_json(json).isNull(), "not JSON"),
        F.when(~inner.eqNullSafe(F.col("id")), "id isn't the key")))
    return at.withColumn("errors", bad)


def fresh(at: Column, now: Column, seconds: int = STALE_SECONDS) -> Column:
    """Whether a heartbeat isn't stale."""
    return at > now - F.make_dt_interval(secs=F.lit(seconds))


def built_since(created: Column, since: Column) -> Column:
    """Whether an index was built at or after a time."""
    return created >= since


def confirmed(confirmations: DataFrame, started: Column) -> DataFrame:
    """The last confirmation of each index, if it was observed after the query began."""
    return confirmations.groupBy("dir").agg(F.max("confirmed_at").alias("confirmed_at")).where(F.col("confirmed_at") >= started)


def live_intents(intents: DataFrame, now: Column, *keys: str) -> DataFrame:
    """Fresh intents of each key."""
    return intents.groupBy(*keys).agg(F.count_if(fresh(F.col("heartbeat_at"), now)).alias("live"))


def finished_batches(items: DataFrame, now: Column) -> DataFrame:
    """Batches that can go: all items consumed or their owners stale (J05): batch."""
    return items.groupBy("batch").agg(F.bool_and(F.col("consumed") | ~fresh(F.col("heartbeat_at"), now)).alias("done")).where("done").select("batch")


def event_stream(events: DataFrame, key: str = "stream") -> DataFrame:
    """Events of each stream with a gapless sequence in order of time, UTC times and their value as JSON."""
    order = Window.partitionBy(key).orderBy("at", "ord")
    return events.select(key, F.row_number().over(order).cast("long").alias("seq"), F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), "kind", "value")


def terminal(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks with their one terminal event (A54): the first that arrives; a task that has one keeps it."""
    first = events.groupBy("task").agg(F.min_by(F.struct("kind", "at"), F.struct("at", "seq")).alias("t"))
    return tasks.join(first, "task", "left").withColumn("terminal", F.coalesce("terminal", "t")).drop("t")


def dispositions(items: DataFrame, secrets: list[str] | None = None) -> DataFrame:
    """A line for each item of a sealed batch, without line ends and known secrets (A52): batch, id, line."""
    clean = F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), r"\s+", " "))
    for s in sorted(secrets or [], key=len, reverse=True):
        clean = F.replace(clean, F.lit(s), F.lit("[REDACTED]"))
    line = F.format_string("%s batch=%s item=%s workspace=%s disposition=%s question=%s", F.date_format("arrived_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("batch"), F.col("id"), F.col("workspace"), F.col("disposition"), F.to_json(F.struct(clean.alias("q"))))
    return items.select("batch", "id", line.alias("line"))


def follow_up(sessions: DataFrame, parent: str, workspace: str) -> DataFrame:
    """What a follow-up takes over from its parent of the same workspace (M55, H07): parent_id, depth, target, allowed."""
    at = sessions.where((F.col("id") == parent) & (F.col("workspace") == workspace))
    deep = F.col("depth") >= MOST_DEPTH
    return at.select(F.col("id").alias("parent_id"), F.when(deep, 0).otherwise(F.col("depth") + 1).alias("depth"), F.col("target"), (~deep).alias("inherits"))


def path_id(path: Column) -> Column:
    """SHA-256 of a clean path."""
    clean = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")
    return F.sha2(F.regexp_replace(clean, r"/\.(?=/|$)", ""), 256)


def project_id(root: Column, origin: Column) -> Column:
    """A project's id: of its origin's identity, without one of its path."""
    known = W.identity(F.coalesce(origin, F.lit("")))
    return F.when(F.trim(F.coalesce(origin, F.lit(""))) != "", F.sha2(known, 256)).otherwise(path_id(root))


def index_dir(base: str, mode: Column, root: Column, revision: Column, scope: Column) -> Column:
    """The folder of an index (I54): by revision, else by the root's hash; a scope of hidden paths below it."""
    hidden = F.exists(scope, lambda s: F.exists(P.parts(s), lambda p: p.startswith(".")))
    part = F.when(hidden, F.concat(F.lit("/scope-"), F.substring(F.sha2(F.array_join(scope, "\0"), 256), 1, 16))).otherwise("")
    own = F.when(mode.isin("revision", "remote"), F.concat(F.lit("revs/"), revision)).otherwise(F.concat(F.lit("fs/"), F.substring(F.sha2(root, 256), 1, 16)))
    return F.concat(F.lit(f"{base}/search/"), own, part)


def query_lock(dir_: Column, *parts: Column) -> Column:
    """The lock of a query below an index."""
    key = F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(dir_, F.lit("/query-locks/"), F.substring(F.sha2(key, 256), 1, 16))


def _optional(name: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f" {name}="), value)).otherwise("")


def index_lines(rows: DataFrame) -> DataFrame:
    """Listing of indexes (A51): dir, text."""
    text = F.concat(
        "mode", _optional("rev", F.substring("resolved_rev", 1, 12)), _optional("root", F.col("root")), _optional("remote", F.col("remote")), _optional("filters", F.array_join("filters", ",")),
        F.format_string(" files=%d chunks=%d model=%s dims=%d created=%s\n  %s\n", F.col("files"), F.col("chunks"), F.col("embedding_model"), F.col("dimensions"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("dir")))
    return rows.select("dir", text.alias("text"))


def remote_lines(rows: DataFrame) -> DataFrame:
    """Listing of cached remotes (A51): remote, text."""
    fetched = _optional("fetched", F.date_format("last_fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return rows.select("remote", F.concat("remote", _optional("rev", F.substring("last_resolved_rev", 1, 12)), fetched, F.lit("\n  "), "dir", F.lit("\n")).alias("text"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def rfc3339(at: Column) -> Column:
    """A time as RFC 3339 in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def tracked(files: DataFrame, listed: DataFrame, protected: list[str]) -> DataFrame:
    """Files of a walk; those in protected folders only if they are tracked (A09): path."""
    inside = P.in_scope(F.col("path"), protected) if protected else F.lit(False)
    plain = files.where(~inside).select("path")
    return plain.unionByName(files.where(inside).select("path").join(listed.select("path"), "path", "left_semi"))


def input_facts(text: Column) -> Column:
    """Hash and bytes of an embedding input."""
    return F.struct(V.input_hash(text).alias("hash"), F.octet_length(text).cast("long").alias("bytes"))
