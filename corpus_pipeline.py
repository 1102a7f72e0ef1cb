"""A corpus pipeline of five of the training-data operators.

Each stage takes what its predecessor kept and returns the columns of ``documents``, the
last one pieces of packed sequences. Between stages the documents are written as Parquet
to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import line_dedup, ngram_join, packing, quality, suffix_dedup
from tesserae.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither the fitted classifier nor the packing plan.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Documents with ``row``, a key of each row: its id, or a number in the order of ids where ids repeat or are null."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    order = [F.asc_nulls_last("doc_id"), *(c for c in COLUMNS if c != "doc_id")]
    return cut(docs.orderBy(*order).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose row isn't dropped."""
    return rows.join(dropped.select("row").distinct(), "row", "left_anti").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as low quality or toxic go.

    Each row is judged for itself, also where ids repeat or are null; labels hold for all rows of their id. A null
    text is an empty one. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _rows(docs)
    labels = rows.select("doc_id", "row").join(labels, "doc_id").select("row", "quality", "toxic")
    scores = quality.classify(rows, labels, id_col="row")
    return _without(rows, scores.where("not keep"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three lines go from the texts; rows of one id, or without one, are documents of their own."""
    out = line_dedup.dedup(docs, run=3, carry=("lang", "source"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document of the smallest id stays.

    Rows are documents of their own: of repeated ones the first stays, those with another text only go as copies of something;
    null ids come after all others. Texts without words, null ones too, resemble nothing and stay. An empty table stays empty.
    """
    rows = _rows(docs)
    groups = ngram_join.join(rows, words=5, num=8, den=10, id_col="row")
    return _without(rows, groups.where("component_id <> row"))


def suffix_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole characters within 100-byte strings that start earlier go from the texts; rows of one id, or without one, are documents of their own."""
    out = suffix_dedup.dedup(docs, length=100, keep_text=True, carry=("lang", "source"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 2048 tokens; a null text is an empty one, repeated rows are packed as often."""
    return packing.pack(docs, limit=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_dedup", suffix_deduplication),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return cut(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
