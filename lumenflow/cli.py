"""Command line: python -m lumenflow.cli {run,generate,bronze,features,report,consume,publish,schemas} ..."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import functions as F

from lumenflow.lineage import SchemaRegistry
from lumenflow.operators import bronze, features
from lumenflow.platform import Platform
from lumenflow.quality import QualityReport
from lumenflow.schemas import DEDUP_KEYS, TABLES
from lumenflow.session import get_session
from lumenflow.sources import avro_ocf, kafka, tables
from lumenflow.streaming import pipelines
from lumenflow.synth import offline, stream


def generate(a: argparse.Namespace) -> None:
    spark = get_session("generate")
    shape = offline.Shape(users=a.users, videos=a.videos, sessions=a.sessions, seed=a.seed)
    for name, df in offline.generate(spark, shape).items():
        tables.write_table(df, f"{a.out}/{name}.parquet")
    start = int(dt.datetime.fromisoformat(a.start).replace(tzinfo=dt.UTC).timestamp() * 1000)
    events = stream.events(spark, stream.StreamShape(start_ms=start, minutes=a.minutes, users=a.users, videos=a.videos, seed=a.seed))
    avro_ocf.write_hourly(events, f"{a.out}/events")


def ingest(a: argparse.Namespace) -> None:
    spark = get_session("bronze")
    for name in a.tables:
        order = [DEDUP_KEYS[name], *[c for c in TABLES[name].names if c != DEDUP_KEYS[name]]]
        bronze.ingest_table(spark, a.source, a.out, name, a.batch, a.ingest_ts, order)


def unified(a: argparse.Namespace) -> None:
    spark = get_session("features")
    media = tables.load_offline(spark, a.source)
    events = avro_ocf.read_events(spark, f"{a.source}/events", missing_ok=True)
    end = int(dt.datetime.fromisoformat(a.window_end).replace(tzinfo=dt.UTC).timestamp() * 1000)
    as_of = features.latest_date(media["playback_history"], a.as_of)
    both = features.unified(features.user_90d(media, as_of), features.stream_60m(events, end, a.burst, a.early_seconds), end)
    tables.save_features(both.orderBy("user_id"), a.out, dt.datetime.fromtimestamp(end / 1000, dt.UTC).strftime("%Y%m%d%H%M"))


def quality(a: argparse.Namespace) -> None:
    spark = get_session("report")
    report = QualityReport(spark, a.out or a.source)
    for name in TABLES:
        report.offline(name, f"{a.source}/{name}.parquet")
    report.stream(f"{a.source}/events")
    report.features(a.features or f"{a.source}/features")
    report.write()
    print(report.text)


def consume(a: argparse.Namespace) -> None:
    records = pipelines.kafka_records(get_session("consume"), a.servers, a.topic, a.starting, a.per_trigger, a.group)
    print(pipelines.consume(pipelines.bronze_sink(records, a.out, a.checkpoint, once=not a.follow), int(a.max_records) if a.max_records else None))


def run_all(a: argparse.Namespace) -> None:
    now = dt.datetime.fromisoformat(a.now).replace(tzinfo=dt.UTC) if a.now else dt.datetime.now(dt.UTC)
    shape = offline.Shape(users=a.users, videos=a.videos, sessions=a.sessions, interactions=a.interactions, impressions=a.impressions, seed=a.seed, end=now.date())
    for name, path in Platform(get_session("run"), a.out, shape).run_all(a.batch, now, a.minutes).items():
        print(name, path)


def publish(a: argparse.Namespace) -> None:
    print(kafka.publish(avro_ocf.read_events(get_session("publish"), a.source), a.servers, a.topic, a.limit))


def schemas(a: argparse.Namespace) -> None:
    for path in SchemaRegistry(a.out).register_all():
        print(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenflow")
    sub = p.add_subparsers(required=True)

    def add(name: str, run, **options) -> None:
        one = sub.add_parser(name)
        for key, value in options.items():
            flag = "--" + key.replace("_", "-")
            if value is bool:
                one.add_argument(flag, action="store_true")
            elif value is None or isinstance(value, type):
                one.add_argument(flag, type=value or str, required=value is not None)
            elif isinstance(value, list):
                one.add_argument(flag, nargs="+", default=value)
            else:
                one.add_argument(flag, type=type(value), default=value)
        one.set_defaults(run=run)

    add("generate", generate, out=str, users=2_500, videos=1_000, sessions=25_000, minutes=90, start="2026-01-31T18:00", seed=42)
    add("bronze", ingest, source=str, out=str, batch=str, ingest_ts=str, tables=list(TABLES))
    add("features", unified, source=str, out=str, window_end=str, as_of=None, burst=100, early_seconds=10)
    add("report", quality, source=str, out=None, features=None)
    add("run", run_all, out=str, batch="batch", now=None, users=2_500, videos=1_000, sessions=25_000, interactions=15_000, impressions=10_000, minutes=60, seed=42)
    add("consume", consume, servers=str, topic="media_events", out=str, checkpoint=str, starting="earliest", per_trigger=100_000, group=None, max_records=None, follow=bool)
    add("publish", publish, source=str, servers=str, topic="media_events", limit=None)
    add("schemas", schemas, out=str)
    return p


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if getattr(args, "limit", None) is not None:
        args.limit = int(args.limit)
    args.run(args)


if __name__ == "__main__":
    main()
