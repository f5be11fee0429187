"""Quality report of a platform's files: sections of metrics, their text and the file it is written to.

A section is a dict. A missing or empty input gives one with an error or a count of 0 instead of an exception, so that one bad path
doesn't stop the report. Only aggregates reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.operators import profiles
from lumenflow.schemas import DEDUP_KEYS, TABLES
from lumenflow.sources import avro_ocf, tables
from lumenflow.sources.domain import CHANGE_DATE

#: Columns whose values' shares a section lists.
SHARES = {"users": "user_subscription", "videos": "video_genre", "interactions": "interaction_type"}


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


def _metrics(df: DataFrame) -> dict[str, Any]:
    """A long profile (metric, value) as a dict; whole numbers as int."""
    return {r.metric: int(r.value) if r.value is not None and float(r.value).is_integer() else r.value for r in df.collect()}


def _shares(df: DataFrame, column: str) -> dict[str, float]:
    """Shares in percent by falling count, ties by value: ordered where the rows are few, a row for each value."""
    return {str(r.value): round(r.pct, 1) for r in profiles.distribution(df, column).orderBy(F.desc("count"), "value").collect()}


class QualityReport:
    """Sections in the order in which they were profiled; write() renders them into {output}/quality_report.txt."""

    def __init__(self, spark: SparkSession, output: str, change_date: str = CHANGE_DATE):
        self.spark, self.output, self.change_date = spark, output.rstrip("/"), change_date
        self.sections: dict[str, dict[str, Any]] = {}
        self.text = ""

    def _keep(self, name: str, section: dict[str, Any]) -> dict[str, Any]:
        self.sections[name] = section
        return section

    def _parquet(self, path: str) -> DataFrame | str:
        """The table at path, or what is wrong with it."""
        if not tables.exists(self.spark, path):
            return f"no such path: {path}"
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:
            return f"no Parquet files in {path}"

    def offline(self, name: str, path: str) -> dict[str, Any]:
        """The section of one of the five tables; an unknown name has counts alone."""
        df = self._parquet(path)
        if isinstance(df, str):
            return self._keep(name, {"error": df})
        out = {"row_count": df.count(), "column_count": len(df.columns)}
        if not out["row_count"]:
            return self._keep(name, {"row_count": 0})
        if name in TABLES:
            out |= _metrics(profiles.PROFILES[name](df))
        if name in SHARES:
            out["shares"] = _shares(df, SHARES[name])
        if name == "users":
            out["top_countries"] = {r.value: r["count"] for r in profiles.top(df, "country").orderBy(F.desc("count"), "value").collect()}
        if name == "videos":
            out["genre_skew"] = _one(profiles.genre_skew(df))
        if name == "playback_history":
            out["popularity"] = _one(profiles.popularity(df))
        if name in ("playback_history", "interactions"):
            out["duplicates"] = {"key": DEDUP_KEYS[name]} | _one(profiles.duplicate_rate(df, [DEDUP_KEYS[name]]))
        if name == "ad_impressions":
            out["schema_evolution"] = {r.period: {k: v for k, v in r.asDict().items() if k != "period"} for r in profiles.schema_evolution(df, self.change_date).collect()}
        return self._keep(name, out)

    def stream(self, path: str) -> dict[str, Any]:
        """The section of the Avro events below path."""
        try:
            events = avro_ocf.read_events(self.spark, path)
        except FileNotFoundError:
            return self._keep("streaming", {"error": f"no events below {path}"})
        count = events.count()
        if not count:
            return self._keep("streaming", {"event_count": 0})
        out = {"event_count": count} | _metrics(profiles.stream_profile(events).where("metric <> 'row_count'"))
        out |= {"first": datetime.fromtimestamp(out["first_ms"] / 1000, UTC).isoformat(), "last": datetime.fromtimestamp(out["last_ms"] / 1000, UTC).isoformat()}
        out["event_types"] = {r.value: r["count"] for r in profiles.distribution(events, "event_type").orderBy(F.desc("count"), "value").collect()}
        out["late_arrivals"], out["bursts"] = _one(profiles.late_arrivals(events)), _one(profiles.bursts(events))
        out["duplicates"] = {"key": "event_id"} | _one(profiles.duplicate_rate(events, ["event_id"]))
        return self._keep("streaming", out)

    def features(self, path: str) -> dict[str, Any]:
        """The section of feature snapshots below path: a profile of each numeric f_ column and the times that they cover."""
        df = self._parquet(path)
        if isinstance(df, str):
            return self._keep("features", {"error": df})
        out = {"row_count": df.count(), "column_count": len(df.columns), "feature_count": sum(c.startswith("f_") for c in df.columns)}
        if not out["row_count"]:
            return self._keep("features", {"row_count": 0})
        for r in profiles.feature_profile(df).collect():
            pct = lambda n: round(n * 100 / out["row_count"], 2)
            out[r.feature] = {k: v for k, v in r.asDict().items() if k != "feature"} | {"null_pct": pct(r.null_count), "nonzero_pct": pct(r.nonzero_count)}
        if "feature_ts" in df.columns:
            out["feature_ts"] = _one(profiles.time_range(df, "feature_ts"))
        return self._keep("features", out)

    def render(self) -> str:
        """The report's text: a section a heading, nested metrics indented."""

        def lines(item: dict[str, Any], depth: int) -> Iterator[str]:
            for name, value in item.items():
                head = "  " * depth + f"{name}:"
                if isinstance(value, dict):
                    yield head
                    yield from lines(value, depth + 1)
                else:
                    shown = "-" if value is None else f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else f"{value:,.2f}" if isinstance(value, float) else str(value)
                    yield f"{head} {shown}"

        out = [f"DATA QUALITY REPORT ({datetime.now(UTC).isoformat(timespec='seconds')})"]
        for name, section in self.sections.items():
            out += ["", name.upper().replace("_", " "), *lines(section, 1)]
        return "\n".join(out) + "\n"

    def write(self) -> str:
        """Renders the report and writes it; returns its path."""
        self.text = self.render()
        path = f"{self.output}/quality_report.txt"
        tables.write_text(self.spark, path, self.text)
        return path

    def summary(self) -> dict[str, Any]:
        return {"component": "quality_report", "output": self.output, "report_length": len(self.text), "sections": list(self.sections)}
