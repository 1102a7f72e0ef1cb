"""Token counts through a cache of digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session, table_path
from .tokens import WordBpe, file_digest, loaded, vocabulary

CACHE = "digest binary, tokenizer string, n_tokens bigint"


def _counted(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = loaded(WordBpe, path)
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "n_tokens": codec.counts(b["t"].tolist())})

    return run


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: id, n_bytes, n_tokens, over_limit.

    The content (null becomes an empty text; nothing else changes, as other normalisation
    could change counts) and the tokenizer file are digested by SHA-256. Pairs that the
    table at ``cache`` lacks are encoded once each, appended to it, and joined back. Copies
    meet in a map-side aggregate before any shuffle. A cache written by two jobs at once
    may hold a pair twice, which reading tolerates. Repeated rows keep a row each; an empty
    table gives none.
    """
    spark = session(docs)
    path = tokenizer or vocabulary("word_bpe_49k.json")
    version = file_digest(path)
    cache = cache or table_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))

    def stored() -> DataFrame:
        try:
            found = spark.read.schema(CACHE).parquet(cache)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = spark.createDataFrame([], CACHE)
        return found.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    distinct = docs.select(digest.alias("digest"), text.alias("t")).groupBy("digest").agg(F.first("t").alias("t"))
    misses = distinct.join(stored(), "digest", "left_anti")
    counts = misses.mapInPandas(_counted(path), "digest binary, n_tokens bigint")
    counts.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = cut(stored(), "token-counts")
    return (
        docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
        .join(known, "digest")
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
