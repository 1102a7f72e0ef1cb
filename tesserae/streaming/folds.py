"""Event streams: ordered folds, count-or-time batches, liveness and incremental indexing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..plans.graph import written

#: Items that seal a batch, and milliseconds: until it is sealed, between ready and joining, until a silent intent is gone.
ITEMS, WAIT_MS, GRACE_MS, STALE_MS = 3, 120_000, 100, 30_000
#: Kinds of events, in the order in which those of one instant count.
KINDS = ("gone", "intent", "beat", "ready")


def concatenated(deltas: DataFrame, key: str = "id", part: str = "part", order: str = "seq") -> DataFrame:
    """Deltas of each part in order; a final text replaces them; parts in the order of their first delta."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("done"), F.struct(order, "delta")))), lambda x: x["delta"]), "")
    whole = deltas.groupBy(key, part).agg(F.min(order).alias("first"), ordered.alias("pieces"), F.max_by(F.when(F.col("done"), F.col("delta")), F.when(F.col("done"), F.col(order))).alias("final"))
    text = F.coalesce("final", "pieces")
    return whole.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), "").alias("text"))


def gap_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = 30) -> DataFrame:
    """Runs of events whose gaps stay below a limit (J04): key, session, first, last, n."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce((at - F.lag(at).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def live_sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """The same on a stream, by session windows and a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).count().select(key, "w.start", "w.end", F.col("count").alias("n"))


def latest(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last row of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def leading_run(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Length of the run of equal values that each group begins with."""
    w = Window.partitionBy(group).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.first(value).over(w))).cast("int")
    flagged = rows.withColumn("_c", F.max(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return flagged.where("_c = 0").groupBy(group).agg(F.count("*").alias("run"), F.first(value).alias("value"))


def usage(rows: DataFrame, *keys: str) -> DataFrame:
    """Token counters added, and input that no cache served."""
    names = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")
    out = rows.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))
    return out.withColumn("uncached_input_tokens", F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_input_tokens")))


class Intake:
    """One key's intents and its open batch, moved from one instant to the next.

    An intent is announced, gives signs of life, and when it is ready joins the open batch after a grace time; one that
    is silent for too long, or leaves, is gone. A batch opens with the first that joins; it is sealed by its number of items ("count"), when
    no intent lives any more ("idle"), or so long after it opened ("time"). Who is ready after being gone is told ("expired").
    """

    def __init__(self, items: int, wait: int, grace: int, stale: int, intents: dict | None = None, batch: list | None = None, opened: int = 0, number: int = 0) -> None:
        self.items, self.wait, self.grace, self.stale = items, wait, grace, stale
        #: Last sign and time of joining (-1: not ready) by id.
        self.intents: dict[str, tuple[int, int]] = intents or {}
        self.batch, self.opened, self.number = batch or [], opened, number

    def due(self) -> int | None:
        """When something happens if no event comes."""
        times = [t for beat, joins in self.intents.values() for t in ([joins] if joins >= 0 else [beat + self.stale])]
        return min([*times, *([self.opened + self.wait] if self.batch else [])], default=None)

    def _seal(self, reason: str) -> list[tuple]:
        out = [(self.number, i, reason) for i in self.batch]
        self.batch, self.number = [], self.number + 1
        return out

    def at(self, now: int, events: list[tuple[str, str]]) -> list[tuple]:
        """Events of an instant, then what falls due: rows (batch, id, reason)."""
        out = []
        for kind, i in sorted(events, key=lambda e: (KINDS.index(e[0]), e[1])):
            if kind == "gone":
                self.intents.pop(i, None)
            elif kind == "intent":
                self.intents.setdefault(i, (now, -1))
            elif i not in self.intents:
                out += [(-1, i, "expired")] if kind == "ready" else []
            else:
                joins = self.intents[i][1]
                self.intents[i] = now, (now + self.grace if kind == "ready" and joins < 0 else joins)
        for i in sorted(i for i, (beat, joins) in self.intents.items() if joins < 0 and beat + self.stale <= now):
            del self.intents[i]
        for joins, i in sorted((joins, i) for i, (_, joins) in self.intents.items() if 0 <= joins <= now):
            del self.intents[i]
            self.opened = self.opened if self.batch else now
            self.batch.append(i)
            if len(self.batch) == self.items:
                out += self._seal("count")
        if self.batch and not self.intents:
            out += self._seal("idle")
        elif self.batch and self.opened + self.wait <= now:
            out += self._seal("time")
        return out

    def until(self, now: int, events: list[tuple[int, str, str]]) -> list[tuple]:
        """All instants up to one, in order."""
        out, left = [], sorted(events)
        while True:
            times = [t for t in (left[0][0] if left else None, self.due()) if t is not None and t <= now]
            if not times:
                return out
            t = min(times)
            here = [(k, i) for x, k, i in left if x == t]
            left = left[len(here) :]
            out += self.at(t, here)


def _replace(state, rows: list[tuple]) -> None:
    """Set a list state, which can't be empty and there."""
    state.clear()
    if rows:
        state.put(rows)


class CountOrTime(StatefulProcessor):
    """``Intake`` on a stream: events wait until the watermark has passed them, so that their order doesn't depend on how they arrive."""

    def __init__(self, items: int, wait_ms: int, grace_ms: int, stale_ms: int) -> None:
        self.limits = items, wait_ms, grace_ms, stale_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, kind string, id string")
        self.intents = handle.getListState("intents", "id string, beat long, joins long")
        self.batch = handle.getListState("batch", "id string")
        self.facts = handle.getValueState("facts", "opened long, number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for b in rows:
            for at, kind, i in zip(b["at_ms"].tolist(), b["kind"].tolist(), b["id"].tolist(), strict=True):
                self.pending.appendValue((at, kind, i))
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        opened, number = self.facts.get() if self.facts.exists() else (0, 0)
        known = {i: (beat, joins) for i, beat, joins in self.intents.get()} if self.intents.exists() else {}
        intake = Intake(*self.limits, known, [x[0] for x in self.batch.get()] if self.batch.exists() else [], opened, number)
        out = intake.until(now, [x for x in held if x[0] <= now])
        _replace(self.pending, [x for x in held if x[0] > now])
        _replace(self.intents, [(i, *v) for i, v in intake.intents.items()])
        _replace(self.batch, [(i,) for i in intake.batch])
        self.facts.update((intake.opened, intake.number))
        if (due := intake.due()) is not None:
            self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "batch", "id", "reason"])

    def close(self) -> None:
        pass


def batched(stream: DataFrame, items: int = ITEMS, wait_ms: int = WAIT_MS, grace_ms: int = GRACE_MS, stale_ms: int = STALE_MS, late: str = "1 second") -> DataFrame:
    """Events (key, id, kind, at) of a stream in count-or-time batches: key, batch, id, reason.

    Kinds: intent, beat, ready, gone. Needs the RocksDB state store.
    """
    timed = stream.where(F.col("kind").isin(*KINDS)).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CountOrTime(items, wait_ms, grace_ms, stale_ms), outputStructType="key string, batch long, id string, reason string", outputMode="Append", timeMode="EventTime")


#: Buckets of an incremental index.
BUCKETS = 64
_KEY = "embedding_input_hash"


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(_KEY), F.lit(buckets)).cast("int")


def _sides(spark: SparkSession, store_: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The settled rows of an index and those of its batches, with bucket and batch."""
    from ..operators import store

    whole = StructType.fromDDL(f"{schema}, bucket int")
    settled = store.current(spark, f"{store_}/base").select(*whole.names) if store.current_manifest(spark, f"{store_}/base") else spark.createDataFrame([], whole)
    batches = store.stored(spark, f"{store_}/data", StructType.fromDDL(f"{schema}, batch string, bucket int"))
    return settled, batches


def index_entries(spark: SparkSession, store_: str, schema: str) -> DataFrame:
    """All entries of an incremental index, one of each hash."""
    settled, batches = _sides(spark, store_, schema)
    return settled.unionByName(batches.select(*settled.columns)).drop("bucket").dropDuplicates([_KEY])


def settle(spark: SparkSession, store_: str, schema: str) -> int:
    """Bring the batches of an index into its base; how many rows it has then.

    The base is saved before the batches' folders go: a kill between leaves rows twice, which readers pass over.
    No stream may write meanwhile.
    """
    from ..operators import store

    _, batches = _sides(spark, store_, schema)
    names = [r.batch for r in batches.select("batch").distinct().collect()]  # micro-batches since the last time
    store.publish(index_entries(spark, store_, schema).withColumn("bucket", bucket()).repartition("bucket"), f"{store_}/base", "base", partition_by=("bucket",))
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store_}/data/batch={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return store.current(spark, f"{store_}/base").count()


def indexed(stream: DataFrame, store_: str, chunk, embed, schema: str = f"{_KEY} string, vector array<float>", buckets: int = BUCKETS):
    """Chunk arriving files, embed the inputs that the store lacks, add them (J01). Returns a writer to start.

    ``chunk`` gives rows with ``embedding_input_hash``; ``embed`` gets one row of each hash that is new. A micro-batch reads
    only the buckets of its hashes, and writes a folder named by the query and its own number: when it is
    replayed it replaces what it wrote, and adds nothing. ``settle`` keeps the number of folders small.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        rows = written(chunk(batch).dropDuplicates([_KEY]).withColumn("bucket", bucket(buckets)))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most as many as there are
        settled, batches = _sides(spark, store_, schema)
        known = settled.select(_KEY, "bucket").unionByName(batches.where(F.col("batch") != own).select(_KEY, "bucket")).where(F.col("bucket").isin(touched))
        fresh = rows.join(known.select(_KEY), _KEY, "left_anti").drop("bucket")
        new = embed(fresh).select(*StructType.fromDDL(schema).names).withColumn("bucket", bucket(buckets))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{store_}/data/batch={own}")

    return stream.writeStream.foreachBatch(each)
