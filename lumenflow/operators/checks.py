"""Data-quality checks; each is one row, so results of many checks can be unioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def duplicate_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """row_count, duplicate_count (rows beyond the first of each key; null keys equal each other)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("row_count"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("duplicate_count"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    stats = duplicate_stats(df, keys)
    return stats.select(F.lit("unique").alias("check"), F.lit(",".join(keys)).alias("columns"), (F.col("duplicate_count") == 0).alias("passed"), "duplicate_count")


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: check, column, passed, null_count; one scan for all columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "column", "null_count")
    return long.select(F.lit("not_null").alias("check"), "column", (F.col("null_count") == 0).alias("passed"), F.col("null_count").cast("long").alias("null_count"))


def missing_keys(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Distinct non-null keys of fact that dim lacks."""
    keys = fact.where(F.col(fact_key).isNotNull()).select(F.col(fact_key).alias("key")).distinct()
    return keys.join(dim.select(F.col(dim_key).alias("key")), "key", "left_anti")


def check_referential_subset(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    lost = missing_keys(fact, dim, fact_key, dim_key).agg(F.count(F.lit(1)).alias("missing_count"))
    return lost.select(F.lit("referential_subset").alias("check"), F.lit(f"{fact_key}->{dim_key}").alias("columns"), (F.col("missing_count") == 0).alias("passed"), "missing_count")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Declared columns first, in order and cast to their types, then extras; a missing column or a null in a required one is a ValueError."""
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    require_columns(df, schema.names)
    required = [f.name for f in schema if not f.nullable]
    if required:
        bad = [r.column for r in check_not_null(df, required).where("not passed").collect()]
        if bad:
            raise ValueError(f"nulls in required columns: {', '.join(sorted(bad))}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *[c for c in df.columns if c not in schema.names])


def event_violations(events: DataFrame, schema: StructType) -> DataFrame:
    """Events that break the schema: their event_id and the first required field that is null."""
    why = F.coalesce(*[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in schema if not f.nullable])
    return events.select("event_id", why.alias("null_field")).where("null_field is not null")


def validated(events: DataFrame, schema: StructType) -> DataFrame:
    """events in the order of schema. Missing or additional columns are a ValueError, other types a TypeError, a null in a required field fails the job."""
    require_columns(events, schema.names)
    if extra := sorted(set(events.columns) - set(schema.names)):
        raise ValueError(f"columns that the schema lacks: {', '.join(extra)}")
    if wrong := [f"{f.name} is {events.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}" for f in schema if events.schema[f.name].dataType != f.dataType]:
        raise TypeError("; ".join(wrong))
    needed = lambda f: F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{f.name} must not be null")).cast(f.dataType))
    return events.select(*[(F.col(f.name) if f.nullable else needed(f)).alias(f.name) for f in schema])


def drop_duplicates_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the least by order; rows aggregate before the shuffle, so a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in order and c != key]
    row = F.struct(*order, *rest)
    return df.groupBy(key).agg(F.min(row).alias("r")).select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])
