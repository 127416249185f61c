"""Agent event log in batch and as Structured Streaming queries (ids F12, J1-J9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from equityspark.functions.core import latest_per
from equityspark.sources.sinks import upsert

# The event kinds.
EVENT_TYPES = [
    "analysis_started", "analysis_complete", "analysis_failed", "signal_generated", "recommendation_made",
    "data_collected", "insight_discovered", "risk_detected", "opportunity_detected", "conflict_detected",
    "consensus_reached", "memory_stored", "memory_retrieved",
]
KEEP_EVENTS = 1000

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source_agent", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    ]
)


# Batch --------------------------------------------------------------------------
def filtered(events: DataFrame, event_type: str | None = None, ticker: str | None = None, source: str | None = None) -> DataFrame:
    for name, value in (("event_type", event_type), ("ticker", ticker), ("source_agent", source)):
        if value is not None:
            events = events.where(F.col(name) == value)
    return events


def history(events: DataFrame, limit: int, **filters: str | None) -> DataFrame:
    """Newest ``limit`` events that match; a top-k, each task keeps ``limit`` rows."""
    return filtered(events, **filters).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def strong_signals(events: DataFrame, confidence: Column, minimum: float = 50.0) -> DataFrame:
    """Events whose confidence exceeds the minimum; works on streams too."""
    return events.withColumn("confidence", confidence).where(F.col("confidence") > minimum)


def progress(events: DataFrame, block: str = "hour") -> DataFrame:
    """Ordered (ticker, seq, agent, event) rows.

    A ticker may hold a large part of the log, so its sequence numbers are not made in
    one window: events are numbered inside (ticker, hour) and shifted by the number of
    events in the ticker's earlier hours, which is one small row per (ticker, hour).
    """
    e = events.withColumn("_b", F.date_trunc(block, F.col("ts")))
    sizes = e.groupBy("ticker", "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("ticker").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("ticker", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("ticker", "_b").orderBy("ts", "event_id")
    return (
        e.withColumn("_rn", F.row_number().over(inside)).join(offsets, ["ticker", "_b"])
        .select("ticker", (F.col("_rn") + F.col("_off")).alias("seq"), F.col("source_agent").alias("agent"), F.col("event_type").alias("event"), "ts")
    )


def conflicts(recommendations: DataFrame, order: list[str] | tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Tickers whose sources' newest recommendations differ.

    Reduced to one row per (ticker, source) before anything is grouped by ticker; the
    map has one entry per source. Rows without a source say nothing.
    """
    last = latest_per(recommendations.where(F.col("source").isNotNull()), ["ticker", "source"], F.struct(*order), ["recommendation"])
    g = last.groupBy("ticker").agg(
        F.count("*").alias("n_sources"),
        F.count_distinct("recommendation").alias("n_recommendations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "recommendation")))).alias("recommendations"),
    )
    return g.where((F.col("n_sources") >= 2) & (F.col("n_recommendations") > 1))


# Streams ------------------------------------------------------------------------
def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_defaults(events: DataFrame) -> DataFrame:
    """Missing time becomes now, missing data an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return events.withColumns({"ts": F.coalesce("ts", F.current_timestamp()), "data": F.coalesce("data", empty)})


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the Parquet log, foldered by day."""
    out = with_defaults(events).withColumn("day", F.to_date("ts"))
    return (
        out.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(path)
    )


def newest(log: DataFrame, keep: int = KEEP_EVENTS) -> DataFrame:
    """The ``keep`` newest events of the log (what a compaction retains)."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)


def compact_log(spark: SparkSession, path: str, target: str, keep: int = KEEP_EVENTS) -> None:
    newest(spark.read.parquet(path), keep).write.mode("overwrite").parquet(target)


def react(events: DataFrame, event_type: str, derive: list[Column]) -> DataFrame:
    """Derived record for every event of one type."""
    return events.where(F.col("event_type") == event_type).select(*derive)


def each_batch(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """User callback per micro-batch."""
    return events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per type and time window; the watermark bounds the state."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    )


STATE_BUCKETS = 64


def conflict_stream(recommendations: DataFrame, path: str, checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Conflicts as they arise on a stream of (ticker, source, recommendation, ts, event_id).

    State is the newest recommendation per (ticker, source), by (ts, event_id). Each
    micro-batch is first reduced to that shape with map-side combining, so a hot ticker is
    a handful of rows before anything is keyed by ticker; then the touched tickers' state is
    merged in. A ticker whose picture changed and now disagrees is written to
    ``path/conflicts``. State changes and conflicts of a batch go to their own folders and
    are overwritten when the batch is retried; a batch only reads the state of earlier ones.

    Every ``compact_every`` batches the state is rewritten as a snapshot in bucket folders;
    later batches read the touched buckets of the newest snapshot and at most that many
    change folders, and what an older snapshot covers is deleted.
    """
    keys, order = ["ticker", "source"], ["ts", "event_id"]
    cols = [*keys, "recommendation", *order]
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(STATE_BUCKETS)).cast("int")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = upsert(None, batch.select(*cols), keys, order)
        base = (batch_id - 1) // compact_every * compact_every if batch_id else 0  # state before ``base`` is in its snapshot
        stored = _folders(spark, f"{path}/state", range(base, batch_id), fresh.schema)
        if base:
            touched = fresh.select(bucket.alias("bucket")).distinct()  # at most STATE_BUCKETS rows
            snapshot = spark.read.parquet(f"{path}/snapshot/upto={base}").join(F.broadcast(touched), "bucket", "left_semi")
            stored = stored.unionByName(snapshot.select(*cols))
        known = upsert(None, stored.join(fresh.select("ticker").distinct(), "ticker", "left_semi"), keys, order)
        old = known.select(*keys, F.col("recommendation").alias("_old"), F.struct(*order).alias("_seen"))
        moved = fresh.join(old, keys, "left").where(F.col("_seen").isNull() | (F.struct(*order) > F.col("_seen")))
        changed = moved.where(~F.col("recommendation").eqNullSafe(F.col("_old"))).select("ticker").distinct()
        merged = upsert(known, fresh, keys, order)
        found = conflicts(merged.join(changed, "ticker", "left_semi"), order)
        found.write.mode("overwrite").parquet(f"{path}/conflicts/batch={batch_id}")
        moved.select(*cols).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            upto = batch_id + 1
            parts = _folders(spark, f"{path}/state", range(base, upto), fresh.schema)
            if base:
                parts = parts.unionByName(spark.read.parquet(f"{path}/snapshot/upto={base}").select(*cols))
            whole = upsert(None, parts, keys, order).withColumn("bucket", bucket)
            whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/snapshot/upto={upto}")
            # a retry of this batch still needs ``base``; what lies before it is covered
            _delete(spark, [f"{path}/snapshot/upto={base - compact_every}", *[f"{path}/state/batch={i}" for i in range(base - compact_every, base)]])

    return each_batch(recommendations, handle, checkpoint)


def _folders(spark: SparkSession, root: str, batches: range, schema) -> DataFrame:
    paths = [f"{root}/batch={i}" for i in batches]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def upsert_stream(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keyed snapshots from a stream: each micro-batch is reduced to its latest row per key
    and written to its own folder, so a retried batch overwrites itself. ``read_snapshots``
    merges; the stored table is never rewritten per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(None, batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(changes, write, checkpoint)


def read_snapshots(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    return upsert(None, spark.read.parquet(path).drop("batch"), keys, order)


def split_valid(raw: DataFrame, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): parsed events, and the texts that are not valid JSON events, for a
    dead-letter sink; one bad event never stops the others."""
    parsed = raw.withColumn("_e", F.from_json(body, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_e").isNull() | F.col("_e._corrupt").isNotNull() | F.col("_e.event_type").isNull()
    return parsed.where(~bad).select("_e.*").drop("_corrupt"), parsed.where(bad).select(F.col(body).alias("body"))
