"""Bronze layer: source rows and Kafka records with where they came from; append-only, nothing dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenflow.schemas import EVENT, PROMOTED
from lumenflow.sources.staging import stage
from lumenflow.sources.tables import resolve_source


def row_ordinal(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """source_row_number: 0-based and dense in the order of some columns.

    Rows are sorted across tasks by range and written once with their task's number and their place in it, so that the counts of the tasks
    and the numbers are of the same rows however a second run would cut the ranges. No task sees more than its own range.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ordered.withColumn("__id", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = placed.withColumn("__p", part).join(F.broadcast(sizes), "__p")  # sizes: a row for each task
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("source_row_number", F.col("__base") + local).drop("__id", "__p", "__base")


def with_metadata(df: DataFrame, table: str, source_file: str, batch_id: str, ingest_ts: Column | str, order: Sequence[str]) -> DataFrame:
    """Source columns, then ingest_ts, source_file, source_table, batch_id and source_row_number (by a total order of the rows)."""
    ts = ingest_ts if isinstance(ingest_ts, Column) else F.lit(ingest_ts).cast("timestamp")
    out = row_ordinal(df, order)
    return out.select(*df.columns, ts.alias("ingest_ts"), F.lit(source_file).alias("source_file"), F.lit(table).alias("source_table"), F.lit(batch_id).alias("batch_id"), "source_row_number")


def ingest_table(spark: SparkSession, source_root: str, target_root: str, table: str, batch_id: str, ingest_ts: str, order: Sequence[str]) -> str:
    """Append a table to raw_{table}; the same batch on the same day replaces itself and nothing else."""
    source = resolve_source(spark, source_root, table)
    out = with_metadata(spark.read.parquet(source), table, source, batch_id, ingest_ts, order)
    target = f"{target_root}/raw_{table}"
    out = out.withColumn("ingest_date", F.date_format("ingest_ts", "yyyyMMdd")).withColumn("batch", F.col("batch_id"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_date", "batch").parquet(target)
    return target


_ANY = T.StructType([*[T.StructField(f.name, f.dataType) for f in EVENT if f.name in PROMOTED], T.StructField("_corrupt", T.StringType())])


def parse_kafka(records: DataFrame, ingest_ts: Column | None = None, source_file: str | None = None) -> DataFrame:
    """Kafka's columns (key, value, topic, partition, offset) to raw_media_events; works on batches and streams.

    parse_error is "missing payload", "payload is not valid UTF-8", "payload is not JSON" or "payload is not a JSON object"; the row stays.
    """
    text = F.try_validate_utf8(F.col("value").cast("string"))
    trimmed = F.trim(text)
    rows = records.withColumn("raw_payload", text).withColumn("p", F.from_json(text, _ANY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    object_like = trimmed.startswith("{")
    valid = F.try_parse_json(text).isNotNull()
    error = F.when(F.col("value").isNull(), "missing payload").when(F.col("raw_payload").isNull(), "payload is not valid UTF-8").when(~valid, "payload is not JSON").when(~object_like, "payload is not a JSON object")
    good = F.col("parse_error").isNull()
    return rows.withColumn("parse_error", error).select(
        "raw_payload", (ingest_ts if ingest_ts is not None else F.current_timestamp()).alias("ingest_ts"), F.lit(source_file).cast("string").alias("source_file"), F.col("topic").alias("kafka_topic"), F.col("partition").cast("long").alias("kafka_partition"), F.col("offset").cast("long").alias("kafka_offset"),
        F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("source_offset"), F.col("key").cast("string").alias("kafka_key"), "parse_error", *[F.when(good, F.col(f"p.{c}")).alias(c) for c in PROMOTED],
    )


def to_kafka(events: DataFrame, topic: str) -> DataFrame:
    """key (user_id) and value (compact JSON with sorted keys, nulls kept) of events; an event without user_id fails the job.

    checks.event_violations lists such events beforehand.
    """
    names = sorted(events.columns)
    value = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    missing = F.raise_error(F.lit("an event without user_id has no key")).cast("string")
    return events.select(F.coalesce(F.col("user_id").cast("string"), missing).cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit(topic).alias("topic"))
