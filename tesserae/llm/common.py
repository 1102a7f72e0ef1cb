"""Helpers that several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to Python; long texts make larger batches risky.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def session(df: DataFrame) -> SparkSession:
    """The session of a frame, with Arrow batches small enough for long texts."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/tesserae"
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again, which cuts its lineage."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stands for a null id.
NO_ID = -(1 << 63)


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (id bigint, t, other columns) with ``doc``, a key of each row in the order of ids, and nulls of id as NO_ID.

    Unique ids are the keys. Where ids repeat or are null, rows are sorted by id (null ones last), text
    and the other columns and numbered, so that each row is a document of its own.
    """
    known = F.coalesce(F.col("id"), F.lit(NO_ID))  # a key that can't be null, so that joins agree on its exchange
    if rows.groupBy("id").count().where("id is null or count > 1").isEmpty():
        return rows.withColumn("doc", known)
    order = [F.asc_nulls_last("id"), *(F.col(c).cast("string") for c in rows.columns if c != "id")]
    numbered = cut(rows.orderBy(*order).withColumn("doc", F.monotonically_increasing_id()), "row-keys")
    return numbered.withColumn("id", known).withColumn("doc", F.coalesce("doc", F.lit(NO_ID)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph of bigint ids: (id, component_id), the smallest id of each.

    Min-label contraction: each round every vertex takes the vertex of least hashed
    priority in its closed neighbourhood, follows that pointer once more, and the graph is
    rewritten over the chosen vertices. Priorities change with each round, so the number
    of vertices falls by a constant factor in expectation, also on long chains. Only
    written tables connect the rounds. Vertices without an edge are not returned.
    """
    spark = edges.sparkSession
    links = cut(
        edges.select(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"))
        .where("a < b").distinct(), "edges")
    labels = None
    for turn in range(200):
        if links.isEmpty():
            break
        if turn == 199:
            raise RuntimeError("components are unfinished after 199 rounds")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
        chosen = cut(
            both.groupBy("a").agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("v"), F.least(F.col("m"), rank("a"))["v"].alias("p")), "chosen")
        jumped = cut(
            chosen.alias("x").join(chosen.alias("y"), F.col("x.p") == F.col("y.v"))
            .select(F.col("x.v").alias("v"), F.col("y.p").alias("p")), "jumped")
        moved = (
            links.join(jumped.withColumnsRenamed({"v": "a", "p": "pa"}), "a")
            .join(jumped.withColumnsRenamed({"v": "b", "p": "pb"}), "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")))
        links = cut(moved.distinct(), "edges")
        if labels is None:
            labels = jumped
        else:
            labels = cut(
                labels.join(jumped.select(F.col("v").alias("p"), F.col("p").alias("next")), "p", "left")
                .select("v", F.coalesce("next", "p").alias("p")), "labels")
    if labels is None:
        return spark.createDataFrame([], "id bigint, component_id bigint")
    least = cut(labels.groupBy("p").agg(F.min("v").alias("component_id")), "least")
    return labels.join(least, "p").select(F.col("v").alias("id"), "component_id")
