import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenflow.functions import sampling
from lumenflow.lineage import Lineage, SchemaRegistry
from lumenflow.operators import bronze, checks, models, profiles
from lumenflow.schemas import EVENT, KAFKA, TABLES, avro_record, table_schema
from lumenflow.sources import avro_ocf, config, tables
from lumenflow.streaming import pipelines
from lumenflow.synth import offline, stream

PAYLOAD = {"event_id": "e1", "event_type": "skip", "event_timestamp": 1, "created_ts": 2, "user_id": "user_1", "session_id": "s", "video_id": "v"}
VALUES = [json.dumps(PAYLOAD).encode(), None, b"x{", b"[1]", b"\xff\xfe", b'"text"', b'{"event_id": "e2"}', b'{"event_id": 5, "event_timestamp": "no"}']


def records(spark):
    return spark.createDataFrame([(b"user_1", v, "media_events", 1, 42 + i, dt.datetime(2026, 1, 1)) for i, v in enumerate(VALUES)], KAFKA)


def test_kafka_records_become_bronze(spark):
    got = bronze.parse_kafka(records(spark), F.lit("2026-01-01").cast("timestamp")).orderBy("kafka_offset").collect()
    assert [r.parse_error for r in got] == [None, "missing payload", "payload is not JSON", "payload is not a JSON object", "payload is not valid UTF-8", "payload is not a JSON object", None, None]
    first = got[0]
    assert first.source_offset == "media_events:1:42" and first.kafka_key == "user_1" and (first.event_timestamp, first.created_ts, first.user_id) == (1, 2, "user_1")
    assert got[6].event_id == "e2" and got[6].user_id is None and got[3].event_id is None


def test_bronze_stream_appends_once(spark, tmp_path):
    records(spark).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        pipelines.bronze_sink(pipelines.file_records(spark, f"{tmp_path}/in"), f"{tmp_path}/raw", f"{tmp_path}/ck").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/raw")
    assert out.count() == len(VALUES) and "ingest_hour" in out.columns


def test_bronze_table_metadata(spark, tmp_path):
    spark.createDataFrame([("user_1", "US"), ("user_2", "GB")], "user_id string, country string").write.parquet(f"{tmp_path}/src/users.parquet")
    for batch in ("batch_test", "batch_test", "other"):
        target = bronze.ingest_table(spark, f"{tmp_path}/src", f"{tmp_path}/bronze", "users", batch, "2026-01-02 03:04:05", ["user_id"])
    rows = spark.read.parquet(target).where("batch_id = 'batch_test'").orderBy("source_row_number").collect()
    assert [(r.user_id, r.source_row_number) for r in rows] == [("user_1", 0), ("user_2", 1)] and {r.ingest_date for r in rows} == {20260102}
    assert spark.read.parquet(target).count() == 4
    with pytest.raises(FileNotFoundError):
        tables.resolve_source(spark, str(tmp_path), "nothing")


def test_row_ordinals_are_dense(spark):
    got = bronze.row_ordinal(spark.range(997).repartition(7), ["id"]).collect()
    assert all(r.id == r.source_row_number for r in got) and len(got) == 997


@pytest.mark.parametrize("advisory", [None, "64k"])
def test_row_ordinals_over_several_partitions(spark, tmp_path, advisory):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if advisory:
        spark.conf.set(key, advisory)
    try:
        rows = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("v"))
        bronze.row_ordinal(rows, ["k"]).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset(key)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = out.agg(F.count("*"), F.countDistinct("source_row_number"), F.min("source_row_number"), F.max("source_row_number")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 0, 999_999)
    assert out.groupBy(F.floor(F.col("source_row_number") / 100_000).alias("g")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).withColumn("before", F.expr("lag(hi) over (order by g)")).where("before >= lo").count() == 0


def test_silver_keeps_the_newest_and_the_earliest(spark):
    raw = bronze.parse_kafka(records(spark), F.lit("2026-01-01").cast("timestamp"))
    later = raw.where("event_id = 'e1'").withColumn("raw_payload", F.lit(json.dumps(PAYLOAD | {"created_ts": 9})))
    got = models.stg_stream_events(raw.unionByName(later)).where("event_id = 'e1'").collect()
    assert len(got) == 1 and (got[0].created_ts, got[0].is_late, got[0].delay_ms) == (2, True, 1)
    users = spark.createDataFrame([("a", "US"), ("a", "GB"), (None, "X")], "user_id string, country string")
    bronze_rows = bronze.with_metadata(users, "users", "f", "b", "2026-01-01", ["user_id", "country"])
    assert [tuple(r) for r in models.stg_users(bronze_rows).collect()] == [("a", "US")]


def test_checks_count_nulls_as_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3), ("x", None)], "k string, v int")
    assert checks.check_unique(df, ["k"]).first().duplicate_count == 2
    assert {r["column"]: r.null_count for r in checks.check_not_null(df, ["k", "v"]).collect()} == {"k": 2, "v": 1}
    dim = spark.createDataFrame([("y",)], "id string")
    assert checks.check_referential_subset(df, dim, "k", "id").first().missing_count == 1
    assert checks.check_unique(df.limit(0), ["k"]).first().passed


def test_conform(spark):
    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(1, "x", 2)], "extra int, b string, a int")
    assert checks.conform(df, schema).dtypes == [("a", "bigint"), ("b", "string"), ("extra", "int")]
    with pytest.raises(ValueError):
        checks.conform(df.drop("b"), schema)
    with pytest.raises(ValueError):
        checks.conform(df.withColumn("a", F.lit(None)), schema)
    with pytest.raises(TypeError):
        checks.conform([1], schema)


def test_profiles_of_edge_cases(spark):
    f = spark.createDataFrame([(0.0,), (None,), (2.0,)], "f_x double").withColumn("f_feature_y", F.lit(1))
    row = profiles.feature_profile(f).collect()
    assert len(row) == 1 and (row[0].null_count, row[0].nonzero_count) == (1, 2)
    ads = spark.createDataFrame([(dt.date(2026, 1, 1), True, None)], "playback_date date, midpoint boolean, third_quartile boolean")
    assert profiles.schema_evolution(ads, "2025-01-01").collect() == []
    assert {r.period: r.midpoint_null_pct for r in profiles.schema_evolution(ads, "2026-06-01").collect()} == {"legacy": 0.0}
    assert profiles.popularity(spark.createDataFrame([], "video_id string")).first().top_videos == 0
    videos = spark.createDataFrame([("a", "x"), ("b", "y")], "video_id string, video_genre string")
    assert profiles.genre_skew(videos).first().bottom3_pct == 0.0
    assert "USERS" in profiles.report({"users": profiles.metrics(videos, n=F.count(F.lit(1)))})


def test_avro_files_round_trip(spark, tmp_path):
    shape = stream.StreamShape(start_ms=1_767_225_600_000, minutes=3, chains_per_minute=4, users=5, videos=3)
    events = stream.events(spark, shape)
    avro_ocf.write_hourly(events, str(tmp_path / "ev"))
    avro_ocf.write_hourly(events, str(tmp_path / "ev"), files=3)
    got = avro_ocf.read_events(spark, str(tmp_path / "ev"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, events.collect()), key=str)
    assert {p.name for p in (tmp_path / "ev").iterdir()} == {"hour=2026010100", "hour=2026010101"} - ({"hour=2026010101"} if events.where("event_timestamp >= 1767229200000").count() == 0 else set())
    avro_ocf.write_hourly(events.limit(0), str(tmp_path / "ev"))
    assert got.count() == events.count()
    for bad, error in ((events.withColumn("more", F.lit(1)), ValueError), (events.drop("platform"), ValueError), (events.withColumn("user_id", F.lit(1)), TypeError)):
        with pytest.raises(error):
            avro_ocf.write_hourly(bad, str(tmp_path / "ev"))
    with pytest.raises(Exception, match="session_id must not be null"):
        avro_ocf.write_hourly(events.withColumn("session_id", F.lit(None).cast("string")), str(tmp_path / "ev"))
    assert avro_ocf.read_events(spark, str(tmp_path / "ev")).count() == events.count()
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        avro_ocf.read_events(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        avro_ocf.read_events(spark, str(tmp_path / "no"))
    assert avro_ocf.read_events(spark, str(tmp_path / "no"), missing_ok=True).collect() == []


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_codec(codec):
    schema = avro_record("r", T.StructType([T.StructField("n", T.LongType(), False), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType())]))
    rows = [{"n": n, "s": s, "b": b} for n in (0, -1, 63, 64, -(2**63), 2**63 - 1) for s in (None, "é") for b in (None, True, False)] * 700
    data = avro_ocf.encode(schema, iter(rows), codec)
    assert list(avro_ocf.decode(data)) == rows
    with pytest.raises(ValueError):
        list(avro_ocf.decode(b"no" + data))
    with pytest.raises(ValueError):
        list(avro_ocf.decode(data[:-1] + bytes([data[-1] ^ 1])))
    with pytest.raises(ValueError):
        avro_ocf.encode(schema, iter([{"n": None}]))


def test_sampling(spark):
    w = [r.weight for r in sampling.zipf_weights(spark, 4, 1.0).orderBy("rank").collect()]
    assert w == pytest.approx([0.48, 0.24, 0.16, 0.12])
    assert {round(r.weight, 9) for r in sampling.zipf_weights(spark, 4, 0).collect()} == {0.25}
    df = spark.range(2_000)
    assert sampling.inject_duplicates(df, 0.0, "id", 1).count() == 2_000 and sampling.inject_duplicates(df, 1.0, "id", 1).count() == 4_000
    assert sampling.inject_duplicates(df, 0.0333, "id", 1).count() == 2_067 and sampling.inject_duplicates(df, 0.5, "id", 1).groupBy("id").count().where("count > 2").count() == 0
    assert sampling.sample_exact(df, 77, 3, "id").count() == 77
    late = df.select(sampling.late_timestamp(F.col("id"), 1, 1.0, 1, 1, "id").alias("t"), "id")
    assert late.where("t - id <> 3600000").count() == 0
    kinds = {r.k: r["count"] for r in df.select(sampling.categorical(sampling.uniform(5, "id"), {"a": 3, "b": 1}).alias("k")).groupBy("k").count().collect()}
    assert 1_350 < kinds["a"] < 1_650
    ranks = [r.r for r in df.select(sampling.zipf_rank(sampling.uniform(6, "id"), 50, 1.0).alias("r")).collect()]
    assert min(ranks) >= 1 and max(ranks) <= 50 and ranks.count(1) > 200
    for n, skew in ((10, 0.75), (50, 1.0), (1_000, 0.8), (40, 0.0), (3_000, 1.7), (33, 2.0), (1, 0.5)):
        sums = np.cumsum(np.arange(1, n + 1) ** -float(skew))
        draws = [r.u for r in spark.range(4_000).select(sampling.uniform(3, "id").alias("u")).collect()] + [0.0, 1 - 2**-53]
        got = [r.r for r in spark.createDataFrame([(u,) for u in draws], "u double").select(sampling.zipf_rank(F.col("u"), n, skew).alias("r")).collect()]
        assert got == [min(n, int(np.searchsorted(sums, u * sums[-1], "right")) + 1) for u in draws]
    for bad in (lambda: sampling.zipf_weights(spark, 0, 1), lambda: sampling.bernoulli(1, 2.0, "id"), lambda: sampling.inject_duplicates(df, -1, "id", 1), lambda: sampling.inject_duplicates(df, 1.01, "id", 1), lambda: sampling.late_timestamp(F.col("id"), 1, 0.5, 3, 1, "id"), lambda: sampling.categorical(F.rand(), {})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        sampling.inject_duplicates(df, 0.5, "nothing", 1)


def test_stream_chains_and_bursts(spark):
    start = 1_767_297_600_000  # 2026-01-01 20:00 UTC
    shape = stream.StreamShape(start_ms=start, minutes=1, chains_per_minute=2, bursts=("20:00-20:01",), duplicate_rate=1.0, click_rate=0.0, cancel_rate=0.0)
    events = stream.events(spark, shape)
    assert events.count() == 36 and events.select("event_id").distinct().count() == 18
    legacy = stream.events(spark, stream.StreamShape(start_ms=start, minutes=1, chains_per_minute=2, bursts=(), change_ms=start + 10**9, click_rate=1.0))
    assert legacy.where("midpoint is not null").count() == 0 and legacy.where("event_type = 'ad_click'").count() >= 2
    with pytest.raises(ValueError):
        stream.StreamShape(start_ms=0, minutes=-1)


def test_empty_platform(spark):
    made = offline.generate(spark, offline.Shape(users=0, videos=0, sessions=0, interactions=0, impressions=0))
    assert {n: df.count() for n, df in made.items()} == dict.fromkeys(TABLES, 0)


def test_registry_lineage_config(spark, tmp_path):
    registry = SchemaRegistry(tmp_path)
    assert registry.get("streaming_event") is None and len(registry.register_all()) == 6
    assert registry.get("streaming_event") == EVENT
    seen = []
    lineage = Lineage(seen.append)
    lineage.record("job", ["b", "a"], ["c"])
    assert lineage.summary()["jobs"] == ["job"] and seen[0].inputs == ("a", "b")
    cfg = config.parse("n_users: 5\nrate: 0.5 # share\nflag: true\nname: 'x'\nitems: [1, 2]\ndata_dir:\n  offline: data/off\n")
    assert (cfg.get("n_users"), cfg.get("rate"), cfg.get("flag"), cfg.get("items"), cfg.data_dir("offline")) == (5, 0.5, True, [1, 2], "data/off")
    with pytest.raises(KeyError):
        cfg.data_dir("none")
    with pytest.raises(KeyError):
        table_schema("none")


def test_missing_tables_are_empty(spark, tmp_path):
    found = tables.load_offline(spark, str(tmp_path))
    assert set(found) == set(TABLES) and found["users"].columns == TABLES["users"].names and found["users"].count() == 0
    target = tables.save_features(spark.range(3), str(tmp_path / "f"), "202601010000")
    tables.save_features(spark.range(2), str(tmp_path / "f"), "202601010000")
    assert spark.read.parquet(target).count() == 2
    tables.write_table(spark.range(3).withColumn("x", F.lit(1)), str(tmp_path / "t"), ["id"], single_file=True)
    assert tables.read_table(spark, str(tmp_path / "t")).columns == ["id"]
