"""Structured Streaming: bronze ingestion from Kafka-shaped records, deduplication under a watermark, and rolling features."""

from __future__ import annotations

import signal
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenflow.operators import features
from lumenflow.operators.bronze import parse_kafka
from lumenflow.schemas import KAFKA

#: Events arrive up to this late.
LATENESS = "48 hours"


def kafka_options(servers: str, topic: str, starting: str = "earliest", per_trigger: int | None = None, group: str | None = None) -> dict[str, str]:
    """Options of Kafka's source. starting "error" begins at the earliest offset of a new checkpoint and fails where a committed one is gone.

    group names the consumer group that brokers see; offsets are kept in the checkpoint.
    """
    if starting not in ("earliest", "latest", "error"):
        raise ValueError("starting must be earliest, latest or error")
    if per_trigger is not None and per_trigger <= 0:
        raise ValueError("per_trigger must be positive")
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest" if starting == "latest" else "earliest", "failOnDataLoss": str(starting == "error").lower()}
    return out | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {}) | ({"kafka.group.id": group} if group else {})


def kafka_records(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", per_trigger: int | None = None, group: str | None = None) -> DataFrame:
    """A topic as a stream, with Kafka's own columns; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, starting, per_trigger, group)).load()


def consume(query: StreamingQuery, max_records: int | None = None, seconds: float | None = None, poll: float = 0.5) -> int:
    """Waits until a query ends, has taken max_records (it stops after the batch that reaches them), some seconds are over, or SIGINT or SIGTERM asks to stop.

    Returns the records taken. A batch that has begun is finished, so its offsets and files are committed together. Signals are heeded in the
    main thread only; handlers are restored.
    """
    if max_records is not None and max_records < 0:
        raise ValueError("max_records must not be negative")
    asked, old, began = threading.Event(), {}, time.monotonic()
    if threading.current_thread() is threading.main_thread():
        old = {s: signal.signal(s, lambda *_: asked.set()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        taken: dict[int, int] = {}
        while True:
            ended = query.awaitTermination(poll)
            taken |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
            full = max_records is not None and sum(taken.values()) >= max_records
            if ended or asked.is_set() or full or seconds is not None and time.monotonic() - began > seconds:
                break
        while query.isActive and query.status["isTriggerActive"] and not query.awaitTermination(poll):
            pass
        query.stop()
        return sum((taken | {p["batchId"]: p["numInputRows"] for p in query.recentProgress}).values())
    finally:
        for s, handler in old.items():
            signal.signal(s, handler)


def refresh_features(events: DataFrame, path: str, checkpoint: str, every: str = "15 minutes", once: bool = False, **features_options) -> StreamingQuery:
    """Rolling features of a stream, refreshed every quarter of an hour: each refresh replaces the snapshot at path by all windows so far."""
    live = rolling_features(events, **features_options).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    timed = live.trigger(availableNow=True) if once else live.trigger(processingTime=every)
    return timed.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()


def file_records(spark: SparkSession, path: str, per_trigger: int = 1_000) -> DataFrame:
    """Parquet files of Kafka's columns as a stream: a replay of a topic, and its stand-in without a broker."""
    return spark.readStream.schema(KAFKA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def bronze_sink(records: DataFrame, path: str, checkpoint: str, source_file: str | None = None, once: bool = True) -> StreamingQuery:
    """Append parsed records to raw_media_events by ingest_hour. Offsets are committed with the files: each record lands once."""
    out = parse_kafka(records, source_file=source_file).withColumn("ingest_hour", F.date_format("ingest_ts", "yyyyMMddHH"))
    writer = out.writeStream.format("parquet").outputMode("append").partitionBy("ingest_hour").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def with_event_time(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """events with event_ts, their time as a timestamp, under a watermark."""
    return events.withColumn("event_ts", F.timestamp_millis("event_timestamp")).withWatermark("event_ts", lateness)


def dedup_events(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One event per event_id as far back as the watermark; state is dropped beyond it."""
    return with_event_time(events, lateness).dropDuplicatesWithinWatermark(["event_id"])


def rolling_features(events: DataFrame, burst: int = 100, early_seconds: int = 10, lateness: str = LATENESS) -> DataFrame:
    """The stream features of every user at every quarter of an hour, over (end - 60 min, end].

    Batch and streaming; the half hour's starts are conditional on the window's own end, so one state serves all four.
    """
    t = F.timestamp_millis(F.col("event_timestamp") - 1)  # windows are closed on the left, these on the right
    rows = events.where("user_id is not null").withColumn("event_ts", t).withWatermark("event_ts", lateness)
    rows = rows.withColumn("w", F.window("event_ts", "60 minutes", "15 minutes"))
    started = F.col("event_timestamp") > F.unix_millis("w.end") - 30 * 60_000
    out = rows.groupBy("user_id", "w").agg(*features.stream_aggregates(started, burst, early_seconds))
    return out.select("user_id", F.unix_millis("w.end").alias("window_end_ms"), *features.STREAM)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what there is, into Parquet, and read it back (complete and update modes replace the table per batch)."""
    spark = df.sparkSession
    if mode == "append":
        query = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.parquet(path)
