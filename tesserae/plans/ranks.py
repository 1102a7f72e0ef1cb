"""Ranks, running sums and greedy cuts over a global order, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import hops, written


def running(rows: DataFrame, order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """A gapless ``n`` from 0 in order, and the sum of each expression over all rows before.

    Rows go once into range partitions, which are written with their number: rows and totals then come from the same
    table, whatever the planner does later. A running number breaks ties, so that the order is total and equal keys may lie
    in several partitions. Only a row for each partition meets in one place.
    """
    sums = sums or {}
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    spread = written(tied.repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy("_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    within = spread.withColumn("_row", F.count("*").over(ahead)).withColumns({f"_in_{k}": F.coalesce(F.sum(v).over(ahead), F.lit(0)) for k, v in sums.items()})
    totals = spread.groupBy("_part").agg(F.count("*").alias("_n"), *(F.coalesce(F.sum(v), F.lit(0)).alias(f"_n_{k}") for k, v in sums.items()))
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = lambda c: F.coalesce(F.sum(c).over(parts), F.lit(0))
    firsts = totals.select("_part", before("_n").alias("_first"), *(before(f"_n_{k}").alias(f"_first_{k}") for k in sums))
    out = within.join(F.broadcast(firsts), "_part", "left")
    first = F.coalesce("_first", F.raise_error(F.lit("a partition has no count")).cast("bigint"))
    named = {"n": F.col("_row") + first, **{k: F.col(f"_in_{k}") + F.col(f"_first_{k}") for k in sums}}
    return out.withColumns(named).drop("_part", "_tie", "_row", "_first", *(f"{p}_{k}" for k in sums for p in ("_in", "_first")))


def greedy_batches(rows: DataFrame, group: str, order: str, size: str, most: int = 32, most_bytes: int = 700_000) -> DataFrame:
    """Batches closed before a number of rows or bytes would be exceeded, never empty (E03). Adds ``batch``, from 0 in each group.

    For each row, running sums give the row at which the next batch would begin if one began here: rows, and what they would have to
    stay below, are merged in one order. The batches that do begin are those that a group's first row leads to, found by
    doubling, so that a group may hold any number of rows. Sizes aren't negative; a null one counts as 0.
    """
    own = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    placed = written(running(rows.withColumn("_size", own), [group, order], {"_before": F.col("_size")}).withColumnRenamed("n", "_n"))
    ends = written(placed.groupBy(F.col(group).alias("_g")).agg(F.min("_n").alias("_low"), F.max("_n").alias("_high")))
    few = F.broadcast(ends) if ends.count() < 10_000 else ends
    # a row ends at its own sum; a batch that begins here ends where a sum passes its limit
    sums = placed.select(F.col(group).alias("_g"), (F.col("_before") + F.col("_size")).alias("_at"), F.lit(0).alias("_asks"), F.lit(None).cast("bigint").alias("_from"))
    asks = placed.select(F.col(group).alias("_g"), (F.col("_before") + most_bytes).alias("_at"), F.lit(1).alias("_asks"), F.col("_n").alias("_from"))
    met = running(sums.unionByName(asks), ["_g", "_at", "_asks"], {"_below": 1 - F.col("_asks")}).where("_asks = 1")
    found = met.select(F.col("_g").alias("_of"), F.col("_from").alias("node"), F.least(F.greatest("_below", F.col("_from") + 1), F.col("_from") + most).alias("p"))
    steps = written(found.join(few, F.col("_of").eqNullSafe(F.col("_g"))).where("p <= _high").select("node", "p"))
    marks = written(ends.select(F.col("_low").alias("node")))
    for two, three, steps in hops(steps):
        reached = [marks, marks.join(two, "node").select(F.explode(F.array_compact(F.array("p", "p2"))).alias("node")), marks.join(three, "node").select(F.col("p3").alias("node"))]
        marks = written(reached[0].unionByName(reached[1]).unionByName(reached[2]))
    begun = placed.join(marks.select(F.col("node").alias("_n"), F.lit(1).alias("_begins")), "_n", "left")
    counted = written(running(begun, ["_n"], {"batch": F.coalesce("_begins", F.lit(0))}).withColumn("batch", F.col("batch") + F.coalesce("_begins", F.lit(0))))
    begins = written(counted.groupBy(F.col(group).alias("_g")).agg(F.min("batch").alias("_base")))
    out = counted.join(F.broadcast(begins) if begins.count() < 10_000 else begins, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("batch", F.col("batch") - F.col("_base")).select(*rows.columns, "batch")
