import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenflow import cli
from lumenflow.operators import bronze, checks
from lumenflow.platform import Platform
from lumenflow.quality import QualityReport
from lumenflow.schemas import EVENT, KAFKA, TABLES
from lumenflow.streaming import pipelines
from lumenflow.synth import offline, stream

NOW = dt.datetime(2026, 1, 31, 18, 10, tzinfo=dt.UTC)


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    shape = offline.Shape(users=30, videos=12, sessions=200, interactions=100, impressions=80)
    made = Platform(spark, str(tmp_path_factory.mktemp("platform")), shape)
    return made, made.run_all("b1", NOW, minutes=3)


def test_run_in_order(spark, ran):
    made, paths = ran
    assert list(paths) == ["offline", "bronze", "streaming", "features", "report"] == made.summary()["done"]
    assert set(paths["offline"]) == set(paths["bronze"]) == set(TABLES)
    assert spark.read.parquet(paths["bronze"]["playback_history"]).count() == spark.read.parquet(paths["offline"]["playback_history"]).count() == 204
    users = [r.user_id for r in spark.read.parquet(paths["features"]).collect()]
    assert len(users) == 30 and users == sorted(users)
    with pytest.raises(ValueError):
        made.run_all("b", NOW, minutes=-1)


def test_report_has_every_section(ran):
    made, paths = ran
    text = open(paths["report"]).read()
    for part in ("USERS", "shares:", "top_countries:", "genre_skew:", "popularity:", "before_dedup_pct:", "schema_evolution:", "ctr_pct:", "late_arrivals:", "bursts:", "event_types:", "FEATURES", "feature_ts:", "nonzero_pct:", "column_count:"):
        assert part in text
    report = QualityReport(made.spark, f"{made.root}/again")
    assert report.offline("playback_history", paths["offline"]["playback_history"])["duplicates"]["duplicate_count"] == 4
    assert list(report.offline("users", paths["offline"]["users"])["shares"].values()) == sorted(report.sections["users"]["shares"].values(), reverse=True)
    assert report.summary()["sections"] == ["playback_history", "users"]


def test_report_of_what_is_missing_or_empty(spark, tmp_path):
    report = QualityReport(spark, str(tmp_path / "out"))
    (tmp_path / "folder").mkdir()
    spark.createDataFrame([], TABLES["users"]).write.parquet(str(tmp_path / "empty"))
    assert "no such path" in report.offline("users", str(tmp_path / "none"))["error"]
    assert "no Parquet files" in report.offline("users", str(tmp_path / "folder"))["error"]
    assert report.offline("users", str(tmp_path / "empty")) == {"row_count": 0}
    assert "no events" in report.stream(str(tmp_path / "folder"))["error"] and "error" in report.features(str(tmp_path / "none"))
    assert report.features(str(tmp_path / "empty")) == {"row_count": 0}
    assert "no events" in open(report.write()).read()


def test_command_runs_everything(spark, tmp_path, capsys):
    cli.main(["run", "--out", str(tmp_path), "--now", "2026-01-31T18:10", "--users", "5", "--videos", "4", "--sessions", "20", "--interactions", "5", "--impressions", "5", "--minutes", "1"])
    assert "report" in capsys.readouterr().out and (tmp_path / "reports" / "quality_report.txt").exists()


def test_bounded_consumer(spark, tmp_path):
    rows = [(f"u{i}".encode(), b"{}", "t", 0, i, NOW.replace(tzinfo=None)) for i in range(40)]
    spark.createDataFrame(rows, KAFKA).repartition(4).write.parquet(str(tmp_path / "in"))
    sink = lambda name: pipelines.bronze_sink(pipelines.file_records(spark, str(tmp_path / "in"), 1), str(tmp_path / name), str(tmp_path / f"{name}-c"))
    assert pipelines.consume(sink("all")) == 40 and spark.read.parquet(str(tmp_path / "all")).count() == 40
    live = pipelines.bronze_sink(pipelines.file_records(spark, str(tmp_path / "in"), 1), str(tmp_path / "some"), str(tmp_path / "some-c"), once=False)
    taken = pipelines.consume(live, max_records=1)
    assert taken >= 1 and spark.read.parquet(str(tmp_path / "some")).count() == taken
    assert pipelines.kafka_options("s", "t", "error", 5, "g") == {"kafka.bootstrap.servers": "s", "subscribe": "t", "startingOffsets": "earliest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": "5", "kafka.group.id": "g"}
    for bad in (lambda: pipelines.kafka_options("s", "t", "never"), lambda: pipelines.kafka_options("s", "t", per_trigger=0), lambda: pipelines.consume(live, -1)):
        with pytest.raises(ValueError):
            bad()


def test_event_without_user_has_no_key(spark):
    events = spark.createDataFrame([("e1", "u1"), ("e2", None)], "event_id string, user_id string")
    assert bronze.to_kafka(events.where("user_id is not null"), "t").count() == 1
    with pytest.raises(Exception, match="without user_id"):
        bronze.to_kafka(events, "t").collect()


def test_standalone_events_have_their_default_positions(spark):
    shape = stream.StreamShape(start_ms=1_767_225_600_000, users=9, videos=4)
    for kind, (low, high) in stream.POSITIONS.items():
        got = stream.standalone(spark, shape, kind, 2_000)
        checks.validated(got, EVENT).write.format("noop").mode("overwrite").save()
        lowest, highest = got.agg(F.min("playback_position_seconds"), F.max("playback_position_seconds")).first()
        assert low <= lowest <= low + (high - low) * 0.05 and high - (high - low) * 0.05 <= highest <= high
    assert stream.standalone(spark, shape, "subscription_cancel", 5).where("video_id is null").count() == 5
    assert stream.standalone(spark, shape, "ad_impression", 50).where("midpoint is null or ad_campaign_id is null").count() == 0
    with pytest.raises(ValueError):
        stream.standalone(spark, shape, "skip", -1)


def test_refresh_replaces_the_snapshot(spark, tmp_path):
    shape = stream.StreamShape(start_ms=1_767_225_600_000, minutes=3, chains_per_minute=5, users=4, videos=3, late_rate=0.0)
    events = stream.events(spark, shape)
    events.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        pipelines.refresh_features(live, str(tmp_path / "out"), str(tmp_path / "c"), once=True, burst=2).awaitTermination()
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(pipelines.rolling_features(spark.read.parquet(str(tmp_path / "in")), burst=2))
