"""Readers of files, snapshots and packs, with the reasons for what they reject."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import vectors as V
from ..functions.sniff import content_type

#: Bytes of a file at most, and bytes that are searched for a NUL.
FILE_BYTES, SNIFF = 1 << 20, 8000


def scan(spark: SparkSession, root: str, scope: list[str] | None = None) -> DataFrame:
    """Files below a root with the reason for leaving each out, null for those to keep.

    The listing is read without content; content comes from a second reader, whose filters on
    length and path reach the scan, so that oversized, hidden and non-text files are never read. Links
    to nothing and unreadable files aren't listed. Returns path, size, modified, content, reason.
    """
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"  # below whatever form of the scheme the reader gives
    path = F.substring_index("path", base, -1)
    listing = files().select(F.col("path").alias("uri"), path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if scope:
        listing = listing.where(P.in_scope(F.col("path"), P.normalized_scope(scope)))
    dot = P.is_hidden(F.col("path"), scope)
    by_name = (
        F.when(dot & P.base(F.col("path")).startswith("."), "dot_file").when(dot, "dot_dir").when(F.col("size") > FILE_BYTES, "oversized")
        .when(~is_text(F.col("path")), "non_text"))
    listing = listing.withColumn("by_name", by_name)
    bodies = files().where(F.col("length") <= FILE_BYTES).select(F.col("path").alias("uri"), "content")
    wanted = listing.where("by_name is null").select("uri")
    out = listing.join(bodies.join(wanted, "uri", "left_semi"), "uri", "left")
    binary = F.hex(F.substring("content", 1, SNIFF)).rlike("^(..)*00")
    reason = F.coalesce("by_name", F.when(F.col("content").isNull(), "unreadable").when(binary, "binary").when(~is_text(F.col("path"), F.col("content")), "non_text"))
    return out.select("path", "size", "modified", F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("reason"))


# Extensions whose type isn't text, and those of text that isn't code.
OTHER = (
    ".7z", ".a", ".avi", ".avif", ".bin", ".bmp", ".bz2", ".class", ".deb", ".dll", ".dmg", ".doc", ".docx", ".dylib", ".eot", ".exe", ".flac", ".gif", ".gz", ".ico", ".iso", ".jar", ".jpeg", ".jpg", ".m4a",
    ".mkv", ".mov", ".mp3", ".mp4", ".o", ".odt", ".ogg", ".otf", ".pdf", ".png", ".ppt", ".pptx", ".ps", ".rar", ".rpm", ".so", ".svg", ".tar", ".tgz", ".tif", ".tiff", ".ttf", ".war", ".wasm", ".wav",
    ".webm", ".webp", ".woff", ".woff2", ".xls", ".xlsx", ".xz", ".zip", ".zst")
TEXT = (
    ".atom", ".cfg", ".conf", ".css", ".csv", ".diff", ".htm", ".html", ".ini", ".json", ".log", ".markdown", ".md", ".ndjson", ".patch", ".properties", ".rss", ".rst", ".sql", ".tex", ".text", ".toml", ".tsv",
    ".txt", ".vcf", ".xhtml", ".xml", ".yaml", ".yml")


def is_text(path: Column, data: Column | None = None) -> Column:
    """Whether a file is code or text (B07): by its extension, and where that tells nothing by its first bytes, if they are given."""
    end = F.lower(P.dotted(path))
    unknown = F.lit(True) if data is None else content_type(data).startswith("text/")
    return P.is_code(path) | F.when(end.isin(*TEXT), True).when(end.isin(*OTHER), False).otherwise(unknown)


def texts(files: DataFrame) -> DataFrame:
    """Kept files as text."""
    return files.where("reason is null").select("path", "size", "modified", F.decode("content", "UTF-8").alias("text"))


def skipped(files: DataFrame) -> DataFrame:
    """Rejected files by reason."""
    return files.where("reason is not null").groupBy("reason").count()


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests in strict JSON; version 3 must name a vector store, version 2 must not."""
    schema = "version int, mode string, root string, remote string, resolved_rev string, embedding_model string, dimensions int, created_at timestamp, file_count int, chunk_count int, vector_store string"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    good = ((F.col("version") == 3) & F.col("vector_store").isNotNull()) | ((F.col("version") == 2) & F.col("vector_store").isNull())
    return rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad manifest version "), F.coalesce(F.col("version").cast("string"), F.lit("null")))).cast("boolean")))


def float_vectors(files: DataFrame, dims: int) -> DataFrame:
    """Rows of little-endian 32-bit floats from binary files (A15): path, n, vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                v = np.frombuffer(data, "<f4")
                if len(v) % dims:
                    raise ValueError(f"{path} holds {len(v)} floats, not a multiple of {dims}")
                yield pd.DataFrame({"path": path, "n": range(len(v) // dims), "vector": list(v.reshape(-1, dims))})

    return files.select("path", "content").mapInPandas(run, "path string, n bigint, vector array<float>")


def referenced(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """Snapshot rows with their pack's vectors; a reference to nothing is an error when read."""
    out = rows.join(packs.select("pack", "slot", "vector"), ["pack", "slot"], "left")
    bad = F.raise_error(F.concat(F.lit("no vector at "), F.col("pack").cast("string"), F.lit("/"), F.col("slot").cast("string"))).cast("boolean")
    return out.where(F.when(F.col("vector").isNotNull(), True).otherwise(bad))


def hashed_embeddings(texts_: DataFrame, dims: int = 64, text: str = "text") -> DataFrame:
    """An offline provider of vectors (K01): signed counts of hashed words, at unit length."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None):
            v = np.zeros(dims)
            words = (t or "").lower().split()
            if words:
                h = pd.util.hash_array(np.array(words, object), categorize=False)
                np.add.at(v, (h % np.uint64(dims)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
            n = np.linalg.norm(v)
            return (v / n if n else v).astype("float32")

        for b in batches:
            yield b.map(one, na_action=None)

    return texts_.withColumns({"vector": run(text), "embedding_input_hash": V.input_hash(F.coalesce(F.col(text), F.lit("")))})
