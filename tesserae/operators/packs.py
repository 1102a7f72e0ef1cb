"""Vector packs, snapshots that refer to them, and what keeps both consistent: validation, reconciliation, clean-up and migration.

Rows of vectors: embedding_key, vector_digest (binary), data (little-endian 32-bit floats). Snapshot rows have the fields of
``STATE`` and refer to a vector by pack and slot.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions import web as W
from . import store

#: The first bytes of a pack; packs of another writer are read by giving its own.
MAGIC = b"VECPACK\0"
#: Version, bytes of the header and of an entry, payload that a pack aims at.
VERSION, HEADER, ENTRY, PAYLOAD = 1, 52, 68, 16 << 20
ENTRIES = "pack string, slot int, dimensions int, model_key binary, embedding_key binary, vector_digest binary, checksum bigint, vector array<float>"
#: What all rows of one snapshot agree on, and what tells a row.
STATE, ROW = ("origin", "revision", "model", "dimensions"), ("chunk_id", "path", "start_line", "end_line", "content_hash", "embedding_input_hash")


def encoded(dims: int, model_key: bytes, items: list[tuple[bytes, bytes, bytes]], magic: bytes = MAGIC) -> bytes:
    """A pack of (embedding key, digest, data), in the order of key and digest."""
    items = sorted(items, key=lambda x: x[:2])
    if dims < 1 or not items:
        raise ValueError("a pack has dimensions and vectors")
    for before, (key, digest, data) in zip([None, *items], items, strict=False):
        if len(data) != 4 * dims or hashlib.sha256(data).digest() != digest:
            raise ValueError("a vector doesn't have its dimensions or digest")
        if before and before[:2] == (key, digest):
            raise ValueError("a vector stands in the pack twice")
    entries = [key + digest + struct.pack("<I", zlib.crc32(data)) for key, digest, data in items]
    return b"".join([magic, struct.pack("<III", VERSION, dims, len(items)), model_key, *entries, *(x[2] for x in items)])


def decoded(content: bytes, name: str, magic: bytes = MAGIC) -> pd.DataFrame:
    """A pack's entries (A19); an error where header, size, name, order, checksums or digests are wrong."""

    def check(good: bool, what: str) -> None:
        if not good:
            raise ValueError(f"pack {name}: {what}")

    check(len(content) >= HEADER, "header is cut off")
    check(content[:8] == magic, "not a pack")
    version, dims, n = struct.unpack("<III", content[8:20])
    check(version == VERSION, f"version {version}")
    check(dims > 0 and n > 0 and len(content) == HEADER + n * (ENTRY + 4 * dims), "size doesn't fit dimensions and count")
    check(not name or hashlib.sha256(content).hexdigest() == name, "content isn't what the name says")
    table = np.frombuffer(content, np.uint8, n * ENTRY, HEADER).reshape(n, ENTRY)
    keys, digests = ([bytes(x) for x in table[:, a : a + 32]] for a in (0, 32))
    sums = table[:, 64:].copy().view("<u4")[:, 0].astype(np.int64)
    body = content[HEADER + n * ENTRY :]
    parts = [body[i * 4 * dims : (i + 1) * 4 * dims] for i in range(n)]
    order = list(zip(keys, digests, strict=True))
    check(all(a < b for a, b in zip(order, order[1:], strict=False)), "entries aren't in order")
    check([zlib.crc32(p) for p in parts] == sums.tolist(), "checksum of a vector is wrong")
    check([hashlib.sha256(p).digest() for p in parts] == digests, "digest of a vector is wrong")
    vectors = list(np.frombuffer(body, "<f4").reshape(n, dims))
    return pd.DataFrame({"pack": name, "slot": range(n), "dimensions": dims, "model_key": content[20:52], "embedding_key": keys, "vector_digest": digests, "checksum": sums, "vector": vectors})


def packed(vectors: DataFrame, dims: int, model_key: bytes, size: int = PAYLOAD, magic: bytes = MAGIC) -> DataFrame:
    """Packs of distinct vectors in key order, named by their content (A44): pack, content. A pack is a group of bounded size."""
    distinct = vectors.dropDuplicates(["embedding_key", "vector_digest"])
    numbered = store.packs(distinct, dims, "embedding_key", "vector_digest", size=size)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        content = encoded(dims, model_key, list(zip(p["embedding_key"], p["vector_digest"], p["data"], strict=True)), magic)
        return pd.DataFrame({"pack": [hashlib.sha256(content).hexdigest()], "content": [content]})

    return numbered.groupBy("pack").applyInPandas(run, "pack string, content binary")


def write_packs(made: DataFrame, folder: str) -> None:
    """Append the packs that the table at a folder lacks; content names them, so a repeat writes nothing."""
    store.lacking(made, folder, "pack").write.mode("append").parquet(folder)


def entries(made: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """Entries of packs (pack, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["pack"], b["content"], strict=True):
                yield decoded(content, name, magic)

    return made.select("pack", "content").mapInPandas(run, ENTRIES)


def pack_files(spark: SparkSession, root: str) -> DataFrame:
    """Packs that lie as files below packs/<model key>/<digest>.pack (A20): pack, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pack").load(f"{root}/packs")
    return files.select(F.regexp_extract("path", r"([0-9a-f]+)\.pack$", 1).alias("pack"), "content")


def catalog(rows: DataFrame) -> DataFrame:
    """The least pack and slot of each key and digest."""
    return store.smallest_slot(rows)


def cached_catalog(made: DataFrame, folder: str, head: str) -> DataFrame:
    """The catalog that a folder keeps for a head, built and written if it has another one or none.

    Only the current head's stays valid: the table is partitioned by head and others are overwritten.
    """
    spark = made.sparkSession
    schema = "embedding_key binary, vector_digest binary, pack string, slot int, head string"
    known = store.stored(spark, folder, schema).where(F.col("head") == head)
    if known.isEmpty():
        catalog(entries(made)).withColumn("head", F.lit(head)).write.mode("overwrite").parquet(folder)
        known = store.stored(spark, folder, schema).where(F.col("head") == head)
    return known.drop("head")


def shared_vectors(index: DataFrame, catalog_: DataFrame, payload: DataFrame) -> DataFrame:
    """Index rows with the vectors of the shared store (A16, C27, C29); a key that it lacks, or other dimensions or checksum, is an error when read.

    ``index`` and ``catalog_``: vector_key, dimensions, checksum; ``payload``: vector_key, vector.
    """
    there = catalog_.select("vector_key", F.col("dimensions").alias("_d"), F.col("checksum").alias("_c")).join(payload.select("vector_key", "vector"), "vector_key", "left")
    out = index.join(there, "vector_key", "left")
    good = (F.col("_d") == F.col("dimensions")) & (F.col("_c") == F.col("checksum")) & F.col("vector").isNotNull() & (F.crc32(W.float_bytes(F.col("vector"))) == F.col("checksum"))
    bad = F.raise_error(F.concat(F.lit("shared vector "), "vector_key", F.lit(" is missing or differs"))).cast("boolean")
    return out.where(F.when(good, True).otherwise(bad)).drop("_d", "_c")


def legacy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows with vectors in one JSON array."""
    return spark.read.schema("chunk_id string, path string, start_line int, end_line int, content_hash string, embedding_input_hash string, embedding_model string, dimensions int, vector array<float>").option("multiLine", True).option("mode", "FAILFAST").json(path)


def index_rows(records: DataFrame) -> DataFrame:
    """Records as references: key and checksum for the vector; without an input hash the vector itself stays."""
    hashed = F.coalesce("embedding_input_hash", F.lit("")) != ""
    return records.withColumns({
        "vector_key": F.when(hashed, V.vector_key(F.col("embedding_input_hash"), F.col("embedding_model"), F.col("dimensions"))),
        "checksum": F.crc32(W.float_bytes(F.col("vector"))), "vector": F.when(~hashed, F.col("vector"))})


def records(chunks: DataFrame, vectors: DataFrame, model: str, dims: int) -> DataFrame:
    """A record for each chunk with a vector."""
    return chunks.join(vectors.select("chunk_id", "vector"), "chunk_id").withColumns({"embedding_model": F.lit(model), "dimensions": F.lit(dims)})


def exact_reuse(wanted: DataFrame, indexes: DataFrame, model: str, dims: int, target: str) -> DataFrame:
    """Vectors of other indexes for wanted input hashes, one of each (C05): embedding_input_hash, vector."""
    pool = indexes.where((F.col("index") != target) & store.compatible(model, dims))
    return pool.join(wanted.select("embedding_input_hash").distinct(), "embedding_input_hash", "left_semi").groupBy("embedding_input_hash").agg(F.min_by("vector", "index").alias("vector"))


def pool(exact: DataFrame, own: DataFrame) -> DataFrame:
    """Rows for reuse, the target's own after the others so that they win."""
    return exact.withColumn("ord", F.lit(0)).unionByName(own.withColumn("ord", F.lit(1)), allowMissingColumns=True)


def key_set(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct record keys (G14, F09, F03): key, in byte order."""
    return rows.select(V.record_key(*map(F.col, columns)).alias("key")).distinct().orderBy("key")


def compatible_rows(rows: DataFrame, model: str, dims: int, key: str = "chunk_id") -> tuple[DataFrame, bool]:
    """Distinct compatible records, and whether all are."""
    good = F.coalesce(store.compatible(model, dims), F.lit(False))
    return rows.where(good).dropDuplicates([key]), rows.where(~good).isEmpty()


def exported(snapshot: DataFrame, remote: DataFrame, key: str = "chunk_id", payload: str = "vector") -> tuple[DataFrame, bool]:
    """A first-version snapshot merged strictly with the remote one, and whether that changes it."""
    merged = store.strict(remote.select(key, payload), snapshot.select(key, payload), key, payload)
    return merged, not store.same_rows(merged, remote.select(key, payload).distinct())


def snapshot_rows(rows: DataFrame, known: DataFrame, dims: int, model_key: bytes, size: int = PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """References of compatible rows and the packs of vectors that a catalog lacks.

    ``rows`` have embedding_input_hash and vector; the result's have pack and slot, in key order (F09).
    """
    data = W.float_bytes(F.col("vector"))
    told = rows.withColumns({"data": data, "embedding_key": F.unhex("embedding_input_hash")}).withColumn("vector_digest", F.unhex(F.sha2("data", 256)))
    new = told.join(known, ["embedding_key", "vector_digest"], "left_anti").select("embedding_key", "vector_digest", "data")
    made = packed(new, dims, model_key, size)
    both = catalog(entries(made).select("embedding_key", "vector_digest", "pack", "slot").unionByName(known.select("embedding_key", "vector_digest", "pack", "slot")))
    refs = told.join(both, ["embedding_key", "vector_digest"]).select(*[c for c in rows.columns if c != "vector"], "pack", "slot")
    return refs.orderBy(*[c for c in ROW if c in refs.columns]), made


def reconciled(local: DataFrame, remote: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Snapshots of both sides as one (G04, G05, G13): per state and row the same reference; another one is an error when read.

    Packs are united by name, as their names are their content; references are compared by the vectors' digests.
    """
    on = [c for c in (*STATE, key) if c in local.columns]
    both = local.unionByName(remote.select(*local.columns))
    rest = [c for c in local.columns if c not in (*on, "vector_digest")]
    out = both.groupBy(*on).agg(F.min("vector_digest").alias("vector_digest"), F.max("vector_digest").alias("_high"), *(F.min(c).alias(c) for c in rest))
    bad = F.raise_error(F.concat(F.lit("two vectors for row "), F.col(key))).cast("boolean")
    return out.where(F.when(F.col("vector_digest") == F.col("_high"), True).otherwise(bad)).drop("_high").select(*local.columns)


def migrated(legacy: DataFrame, current: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Rows of a legacy store moved into the identity's own, whose rows win."""
    return store.precedence(current, legacy, key, order)


def metadata_errors(snapshots: DataFrame, target: dict[str, object], version: int = 2) -> DataFrame:
    """Snapshots whose version, origin, revision, model or dimensions aren't the target's (M45): errors."""
    wrong = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in {"version": version, **target}.items()]
    return snapshots.withColumn("errors", F.array_compact(F.array(*wrong)))


def tree_errors(listing: DataFrame, version: int) -> DataFrame:
    """Paths that a sync repository's schema doesn't allow, and links (V11): path, error. ``listing``: path, kind (file, directory, symlink, other)."""
    key = {1: "[0-9a-f]{16}", 2: "[0-9a-f]{64}"}[version]
    sha, oid = "[0-9a-f]{64}", "([0-9a-f]{40}|[0-9a-f]{64})"
    folders = rf"^(\.|indexes|indexes/{sha}|indexes/{sha}/{oid}" + (rf"|packs|packs/{sha}" if version == 2 else "") + ")$"
    files = rf"^(schema\.json|indexes/{sha}/{oid}/{key}\.json" + (rf"|packs/{sha}/{sha}\.pack" if version == 2 else "") + ")$"
    rows = listing.where(~F.col("path").rlike(r"^\.git(/|$)"))
    good = F.when(F.col("kind") == "directory", F.col("path").rlike(folders)).when(F.col("kind") == "file", F.col("path").rlike(files)).otherwise(False)
    return rows.where(~good).select("path", F.when(F.col("kind").isin("file", "directory"), "path isn't allowed").otherwise(F.concat(F.col("kind"), F.lit(" isn't allowed"))).alias("error"))


def unresolved(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """References to no entry, and packs that nothing refers to (V12, A24): pack, slot, error."""
    there = rows.select("pack", "slot")
    lost = snapshots.select("pack", "slot").distinct().join(there, ["pack", "slot"], "left_anti").withColumn("error", F.lit("no such entry"))
    unused = there.select("pack").distinct().join(snapshots.select("pack").distinct(), "pack", "left_anti")
    return lost.unionByName(unused.select("pack", F.lit(None).cast("int").alias("slot"), F.lit("pack isn't used").alias("error")))


def compacted(catalog_: DataFrame, payload: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A store without what no index names (M39, C27, D22): catalog with new offsets, payload, and a summary.

    Every live row must be in the catalog with its dimensions and checksum, else an error is raised when it is read.
    """
    keys = live.select("vector_key", F.col("dimensions").alias("_d"), F.col("checksum").alias("_c")).distinct()
    joined = keys.join(catalog_, "vector_key", "left")
    bad = F.raise_error(F.concat(F.lit("live vector "), "vector_key", F.lit(" isn't in the catalog"))).cast("boolean")
    good = (F.col("_d") == F.col("dimensions")) & (F.col("_c") == F.col("checksum"))
    kept = joined.where(F.when(good, True).otherwise(bad)).drop("_d", "_c").dropDuplicates(["vector_key"])
    placed = store.byte_offsets(kept.drop("offset"), "dimensions", "vector_key")
    sums = catalog_.join(kept.select("vector_key", F.lit(1).alias("_live")), "vector_key", "left").agg(
        F.count("*").alias("before"), F.count("_live").alias("after"), F.coalesce(F.sum(F.when(F.col("_live").isNull(), F.col("dimensions").cast("long") * 4)), F.lit(0)).alias("bytes_removed"))
    return placed, payload.join(kept.select("vector_key"), "vector_key", "left_semi"), sums.withColumn("already_compact", F.col("before") == F.col("after"))


def gc_summary(stores: DataFrame) -> DataFrame:
    """Sums over stores (D23): stores, compacted, removed vectors and bytes."""
    return stores.agg(F.count("*").alias("stores"), F.count_if(~F.col("already_compact")).alias("compacted"), F.coalesce(F.sum(F.col("before") - F.col("after")), F.lit(0)).alias("vectors_removed"), F.coalesce(F.sum("bytes_removed"), F.lit(0)).alias("bytes_removed"))


def tree_statistics(files: DataFrame) -> DataFrame:
    """Indexes, packs and bytes of a tree (D25): rows path, size."""
    return files.agg(F.count_if(F.col("path").rlike(r"^indexes/.*\.json$")).alias("indexes"), F.count_if(F.col("path").rlike(r"^packs/.*\.pack$")).alias("packs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def migration_summary(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Indexes, records, distinct vectors, packs and their bytes."""
    left = rows.agg(F.count_distinct(*[c for c in STATE if c in rows.columns]).alias("indexes"), F.count("*").alias("records"), F.count_distinct("embedding_input_hash").alias("unique_vectors"))
    return left.crossJoin(made.agg(F.count("*").alias("packs"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")))  # one row and one row


def legacy_manifests(files: DataFrame) -> DataFrame:
    """Manifests of the first version in a tree of both (M42), which a repair removes after moving their rows."""
    return files.where(F.col("path").rlike(r"^indexes/[0-9a-f]{64}/[0-9a-f]+/[0-9a-f]{16}\.json$")).select("path").orderBy("path")


def strict_tree(files: DataFrame) -> DataFrame:
    """Files that a repaired tree keeps."""
    bad = tree_errors(files.withColumn("kind", F.lit("file")), 2).select("path")
    return files.join(bad, "path", "left_anti")


def sync_path(origin: Column, revision: Column, model: Column, dims: Column) -> Column:
    """Where a snapshot lies (M30): indexes/<origin's hash>/<revision>/<model key>.json."""
    return F.concat_ws("/", F.lit("indexes"), F.sha2(origin, 256), revision, F.concat(V.model_key(model, dims), F.lit(".json")))


def sync_summary(targets: DataFrame) -> DataFrame:
    """Indexes and records synchronised, and targets left out (D35): rows synced, records."""
    return targets.agg(F.count_if("synced").alias("indexes"), F.coalesce(F.sum(F.when(F.col("synced"), F.col("records"))), F.lit(0)).alias("records"), F.count_if(~F.col("synced")).alias("skipped"))


def catalog_name(generation: Column) -> Column:
    """The file of a catalog's generation."""
    return F.concat(F.lit("catalog-"), F.lpad(generation.cast("string"), 20, "0"), F.lit(".json"))


def generation(name: Column, kind: str = "catalog") -> Column:
    """The generation of a catalog's or a payload's file; null for any other name."""
    pattern = {"catalog": r"^catalog-(\d{20})\.json$", "payload": r"^vectors-(\d{20})\.f32$"}[kind]
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).try_cast("decimal(20,0)"))


def newest(rows: DataFrame, keep: int = 2) -> DataFrame:
    """Catalog files of the newest generations and whether each stays (M39, M46): name, generation, kept."""
    told = rows.withColumn("generation", generation(F.col("name"))).where("generation is not null")
    place = F.row_number().over(Window.orderBy(F.desc("generation")))  # one row a file of one folder
    return told.withColumn("kept", place <= keep)
