"""Sharding by longest-processing-time scheduling over groups of equal texts."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, session

#: Groups above this part of all bytes are scheduled one by one, so there are at most this many.
SINGLE_GROUPS = 1 << 14
#: The smaller groups are scheduled in so many bundles.
BUNDLES = 1 << 12
#: Parts of a shard in which rows are numbered.
SLOT_PARTS = 1 << 10


def schedule(items: list[tuple[object, int]], n_shards: int) -> dict[object, int]:
    """LPT: items by descending size, each to the shard with the least load so far."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        load, s = heapq.heappop(heap)
        placed[key] = s
        heapq.heappush(heap, (load + size, s))
    return placed


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to shards of nearly equal bytes; equal texts stay together.

    A row's size is its UTF-8 bytes plus 1; a null text counts and groups as an empty one.
    Groups of over 1/16384 of all bytes are scheduled singly, the rest in 4,096 bundles of
    groups by hash, so the driver's heap sees a bounded number of items whatever the input.
    A group larger than an even share gets a shard to itself and the others stay even.
    Repeated rows, null ids and an empty table are kept as they are; other columns are
    ignored. Returns id, size, text_crc32, law, shard, slot (gapless from 0 within a
    shard), grown_shard (null: this law doesn't grow).
    """
    spark = session(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
                    F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
        .withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(BUNDLES)).cast("int")), "shard-rows")
    groups = cut(rows.groupBy("group", "bundle").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    single = F.col("bytes") * SINGLE_GROUPS > total
    singles = {bytes(r[0]): r[1] for r in groups.where(single).select("group", "bytes").collect()}
    bundles = {r[0]: r[1] for r in groups.where(~single).groupBy("bundle").agg(F.sum("bytes")).collect()}
    placed = schedule([*singles.items(), *bundles.items()], n_shards)
    of_group = spark.createDataFrame([(bytearray(k), placed[k]) for k in singles], "group binary, own int")
    of_bundle = spark.createDataFrame([(k, placed[k]) for k in bundles], "bundle int, shared int")
    # at most 16,384 and 4,096 rows by the bounds above
    dealt = (
        rows.join(F.broadcast(of_group), "group", "left").join(F.broadcast(of_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shared"))
        .withColumn("part", F.pmod(F.xxhash64(id_col, "group"), F.lit(SLOT_PARTS)).cast("int")))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # at most n_shards * 1,024 rows
    within = Window.partitionBy("shard", "part").orderBy(id_col, "text_crc32")
    return (
        dealt.withColumn("slot", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "part"])
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("slot") + F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
