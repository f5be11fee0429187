"""The whole platform run in order: offline tables, their bronze copies, stream events, unified features, the quality report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenflow.operators import bronze, features
from lumenflow.quality import QualityReport
from lumenflow.schemas import DEDUP_KEYS, TABLES
from lumenflow.sources import avro_ocf, tables
from lumenflow.synth import offline, stream


@dataclass
class Platform:
    """Where a run writes (root/offline, bronze, streaming, features, reports) and what it makes; every step can run on its own."""

    spark: SparkSession
    root: str
    shape: offline.Shape = field(default_factory=offline.Shape)
    burst: int = 100
    early_seconds: int = 10
    done: dict[str, Any] = field(default_factory=dict)

    def run_offline(self) -> dict[str, str]:
        """Generates and writes the five tables; returns their paths."""
        paths = {}
        for name, df in offline.generate(self.spark, self.shape).items():
            paths[name] = f"{self.root}/offline/{name}.parquet"
            tables.write_table(df, paths[name])
        self.done["offline"] = paths
        return paths

    def run_bronze(self, batch_id: str, ingest_ts: str) -> dict[str, str]:
        """Appends the tables to bronze; a missing one is a FileNotFoundError."""
        order = {n: [DEDUP_KEYS[n], *[c for c in TABLES[n].names if c != DEDUP_KEYS[n]]] for n in TABLES}
        paths = {n: bronze.ingest_table(self.spark, f"{self.root}/offline", f"{self.root}/bronze", n, batch_id, ingest_ts, order[n]) for n in TABLES}
        self.done["bronze"] = paths
        return paths

    def run_stream(self, start: dt.datetime, minutes: int) -> str:
        """Generates some minutes of events from start, with the genres of the videos table, and writes them by the hour."""
        start_ms = int(start.timestamp() * 1000)
        change_ms = int(dt.datetime.combine(self.shape.change, dt.time(), dt.UTC).timestamp() * 1000)
        shape = stream.StreamShape(start_ms=start_ms, minutes=minutes, users=self.shape.users, videos=self.shape.videos, click_rate=self.shape.click_rate, change_ms=change_ms, seed=self.shape.seed)
        path = f"{self.root}/streaming"
        made = stream.events(self.spark, shape)
        genres = tables.load_offline(self.spark, f"{self.root}/offline", ["videos"])["videos"].select("video_id", "video_genre")
        named = made.join(genres, "video_id", "left").withColumn("genre_id", F.coalesce("video_genre", "genre_id"))
        avro_ocf.write_hourly(named.select(*made.columns), path)
        self.done["streaming"] = path
        return path

    def run_features(self, window_end: dt.datetime) -> str:
        """Unified features as of window_end, sorted by user, in a snapshot of its own; repeating it replaces the snapshot."""
        media = tables.load_offline(self.spark, f"{self.root}/offline")
        events = avro_ocf.read_events(self.spark, f"{self.root}/streaming", missing_ok=True)
        end_ms = int(window_end.timestamp() * 1000)
        both = features.unified(features.user_90d(media, features.latest_date(media["playback_history"], None)), features.stream_60m(events, end_ms, self.burst, self.early_seconds), end_ms)
        path = tables.save_features(both.orderBy("user_id"), f"{self.root}/features", window_end.astimezone(dt.UTC).strftime("%Y%m%d%H%M"))
        self.done["features"] = path
        return path

    def run_report(self) -> str:
        """Profiles all that the run has written; returns the report's path."""
        report = QualityReport(self.spark, f"{self.root}/reports", self.shape.change.isoformat())
        for name in TABLES:
            report.offline(name, f"{self.root}/offline/{name}.parquet")
        report.stream(f"{self.root}/streaming")
        report.features(f"{self.root}/features")
        self.done["report"] = report.write()
        return self.done["report"]

    def run_all(self, batch_id: str, now: dt.datetime, minutes: int = 60) -> dict[str, Any]:
        """Every step in order, the stream's last minute ending at now; returns the paths of all outputs."""
        if minutes < 0:
            raise ValueError("minutes must not be negative")
        self.run_offline()
        self.run_bronze(batch_id, now.astimezone(dt.UTC).strftime("%Y-%m-%d %H:%M:%S"))
        self.run_stream(now - dt.timedelta(minutes=minutes), minutes)
        self.run_features(now)
        self.run_report()
        return dict(self.done)

    def summary(self) -> dict[str, Any]:
        return {"component": "platform", "root": self.root, "shape": self.shape.summary(), "done": list(self.done)}
