"""Parquet sources and sinks of the media tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lumenflow.schemas import TABLES


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store its scheme names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet file or directory, under a declared schema where one is given; columns prunes the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def load_offline(spark: SparkSession, root: str, names: Sequence[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The five media tables below root. A missing one is an empty table of its declared schema, so later columns resolve."""
    out = {}
    for name in names:
        path = f"{root}/{name}.parquet"
        out[name] = read_table(spark, path) if exists(spark, path) else spark.createDataFrame([], TABLES[name])
    return out


def resolve_source(spark: SparkSession, root: str, name: str) -> str:
    """{root}/{name}.parquet, else the directory {root}/{name}; neither is a FileNotFoundError."""
    for path in (f"{root}/{name}.parquet", f"{root}/{name}"):
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"no source for table {name} below {root}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, over one that is there, in whatever store the path's scheme names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, partition_by: Sequence[str] = (), mode: str = "overwrite", single_file: bool = False) -> None:
    """Write Parquet, of some columns if asked. single_file is for small reference tables only."""
    out = df.select(*columns) if columns else df
    if single_file:
        out = out.coalesce(1)
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_features(features: DataFrame, path: str, refresh_ts: str) -> str:
    """A snapshot of the feature table below refresh_ts=YYYYMMDDHHMM; writing the same one again replaces it."""
    target = f"{path}/refresh_ts={refresh_ts}"
    features.write.mode("overwrite").parquet(target)
    return target
