"""Spark session with the settings that the engine's queries expect."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app_name: str = "lumenflow", extra: Mapping[str, str] | None = None) -> SparkSession:
    """The active session, or a new one; extra settings win over DEFAULTS. The master comes from the environment."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in (DEFAULTS | dict(extra or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
