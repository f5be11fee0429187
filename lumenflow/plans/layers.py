"""Registered queries of the bronze, silver and gold layers, of synthetic sources and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.functions import sampling
from lumenflow.operators import bronze, checks, features, models, profiles
from lumenflow.plans.registry import register, rounded
from lumenflow.schemas import EVENT
from lumenflow.sources import avro_ocf, domain
from lumenflow.sources.domain import CHANGE_DATE, with_views
from lumenflow.sources.staging import new_path, stage
from lumenflow.streaming import pipelines
from lumenflow.synth import offline, stream

INGEST = "2026-01-01 00:00:00"
_ORDER = {"users": ["user_id"], "videos": ["video_id"], "playback_history": ["history_id", "watch_hours", "playback_date", "video_id", "user_id"], "interactions": ["interaction_id"], "ad_impressions": ["impression_id", "cost_nanos", "playback_date", "advertiser_id", "video_id", "clicked"]}


def scratch(spark: SparkSession) -> str:
    return new_path(spark, "media")


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return bronze.with_metadata(domain.VIEWS[name](spark, d), name, f"{name}.parquet", "batch_test", INGEST, _ORDER[name])


# --- bronze ---------------------------------------------------------------------------------------------------------------------------
@register("bronze_metadata", with_views("SELECT *, 'interactions.parquet' AS source_file, 'interactions' AS source_table, 'batch_test' AS batch_id, row_number() OVER (ORDER BY interaction_id) - 1 AS source_row_number, '20260101' AS ingest_date FROM interactions", "interactions"))
def bronze_metadata(spark, d):
    return raw(spark, d, "interactions").withColumn("ingest_date", F.date_format("ingest_ts", "yyyyMMdd")).drop("ingest_ts")


def kafka_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stream events as a topic's records; some payloads are missing or broken, as a topic's may be."""
    e = domain.stream_events(spark, d).withColumns({c: F.col(c).cast("string") for c in ("event_id", "user_id", "session_id", "video_id")})
    i = F.col("event_id").cast("long")
    value = F.when(i % 50 == 7, None).when(i % 50 == 13, F.lit("x{")).when(i % 50 == 21, F.lit("[1]")).otherwise(F.to_json(F.struct("event_id", "event_type", "event_timestamp", "created_ts", "user_id", "session_id", "video_id")))
    return e.select(F.col("user_id").cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit("media_events").alias("topic"), (i % 3).cast("int").alias("partition"), F.floor(i / 3).cast("long").alias("offset"), F.lit(INGEST).cast("timestamp").alias("timestamp"))


@register(
    "bronze_parse_json",
    with_views(
        """SELECT source_offset, kafka_key, parse_error, CASE WHEN parse_error IS NULL THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN parse_error IS NULL THEN event_type END AS event_type,
  CASE WHEN parse_error IS NULL THEN event_timestamp END AS event_timestamp, CASE WHEN parse_error IS NULL THEN created_ts END AS created_ts, CASE WHEN parse_error IS NULL THEN CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN parse_error IS NULL THEN CAST(session_id AS VARCHAR) END AS session_id, CASE WHEN parse_error IS NULL THEN CAST(video_id AS VARCHAR) END AS video_id
  FROM (SELECT *, 'media_events:' || (event_id % 3) || ':' || (event_id // 3) AS source_offset, CAST(user_id AS VARCHAR) AS kafka_key,
    CASE event_id % 50 WHEN 7 THEN 'missing payload' WHEN 13 THEN 'payload is not JSON' WHEN 21 THEN 'payload is not a JSON object' END AS parse_error FROM stream_events)""",
        "stream_events",
    ),
)
def bronze_parse_json(spark, d):
    out = bronze.parse_kafka(kafka_rows(spark, d), F.lit(INGEST).cast("timestamp"))
    return out.select("source_offset", "kafka_key", "parse_error", "event_id", "event_type", "event_timestamp", "created_ts", "user_id", "session_id", "video_id")


@register("kafka_key_value_frame", with_views("""SELECT CAST(user_id AS VARCHAR) AS key, 'media_events' AS topic, '{"event_id":' || event_id || ',"event_timestamp":' || event_timestamp || ',"event_type":"' || event_type || '","midpoint":' || coalesce(CAST(midpoint AS VARCHAR), 'null') || ',"user_id":' || user_id || '}' AS value FROM stream_events""", "stream_events"))
def kafka_frame(spark, d):
    events = domain.stream_events(spark, d).select("event_id", "event_timestamp", "event_type", "midpoint", "user_id")
    return bronze.to_kafka(events, "media_events").select(F.col("key").cast("string").alias("key"), "topic", F.col("value").cast("string").alias("value"))


# --- silver ---------------------------------------------------------------------------------------------------------------------------
def _newest(view: str, key: str) -> str:
    order = ", ".join(f"{c} DESC" for c in _ORDER[view])
    return f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {view}) WHERE r = 1"


for _view, _key, _f in (("users", "user_id", models.stg_users), ("videos", "video_id", models.stg_videos), ("playback_history", "history_id", models.stg_playback_history), ("interactions", "interaction_id", models.stg_interactions)):

    @register(f"stg_{_view}", with_views(_newest(_view, _key), _view))
    def _silver(spark, d, view=_view, f=_f):
        return f(raw(spark, d, view))


@register("stg_ad_impressions", with_views(f"SELECT *, midpoint IS NOT NULL OR third_quartile IS NOT NULL AS has_vast_tracking FROM ({_newest('ad_impressions', 'impression_id')})", "ad_impressions"))
def stg_ad_impressions(spark, d):
    return models.stg_ad_impressions(raw(spark, d, "ad_impressions"))


_GOOD = "event_id % 50 NOT IN (7, 13, 21)"


@register("stg_stream_events", with_views(f"SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, event_timestamp, created_ts, CAST(user_id AS VARCHAR) AS user_id, created_ts > event_timestamp AS is_late, created_ts - event_timestamp AS delay_ms FROM stream_events WHERE {_GOOD}", "stream_events"))
def stg_stream_events(spark, d):
    rows = kafka_rows(spark, d)
    twice = bronze.parse_kafka(rows.unionByName(rows), F.lit(INGEST).cast("timestamp"))
    return models.stg_stream_events(twice).select("event_id", "event_type", "event_timestamp", "created_ts", "user_id", "is_late", "delay_ms")


# --- gold -----------------------------------------------------------------------------------------------------------------------------
@register("dim_user", with_views("SELECT user_id, user_age, CASE WHEN user_age < 18 THEN 'under 18' WHEN user_age < 25 THEN '18-24' WHEN user_age < 35 THEN '25-34' WHEN user_age < 50 THEN '35-49' ELSE '50+' END AS age_band, country, user_subscription AS tier FROM users", "users"))
def dim_user(spark, d):
    return models.dim_user(domain.users(spark, d))


@register("dim_video", with_views("SELECT video_id, video_title, video_genre, video_duration, CASE WHEN video_duration < 600 THEN 'short' WHEN video_duration < 1800 THEN 'medium' ELSE 'long' END AS duration_band FROM videos", "videos"))
def dim_video(spark, d):
    return models.dim_video(domain.videos(spark, d))


@register("dim_advertiser", with_views("SELECT advertiser_id, count(*) AS impressions, CAST(sum(CAST(clicked AS BIGINT)) AS BIGINT) AS clicks, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos FROM ad_impressions GROUP BY 1", "ad_impressions"))
def dim_advertiser(spark, d):
    return models.dim_advertiser(domain.ad_impressions(spark, d))


@register("dim_date", 'SELECT CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS iso_weekday FROM generate_series(TIMESTAMP \'2001-01-01\', TIMESTAMP \'2001-12-31\', INTERVAL 1 DAY) t(d)')
def dim_date(spark, d):
    return models.dim_date(spark, "2001-01-01", "2001-12-31")


@register("fact_playback_watch", with_views("SELECT history_id, session_id, user_id, video_id, playback_date, watch_hours FROM playback_history", "playback_history"))
def fact_playback_watch(spark, d):
    return models.fact_playback_watch(domain.playback_history(spark, d))


@register("fact_interaction", with_views("SELECT interaction_id, user_id, video_id, interaction_type, likes FROM interactions", "interactions"))
def fact_interaction(spark, d):
    return models.fact_interaction(domain.interactions(spark, d))


@register("fact_ad_impression", with_views("SELECT impression_id, user_id, video_id, advertiser_id, playback_date, cost_nanos, coalesce(midpoint, false) OR coalesce(third_quartile, false) AS completed, clicked FROM ad_impressions", "ad_impressions"))
def fact_ad_impression(spark, d):
    return models.fact_ad_impression(domain.ad_impressions(spark, d))


@register("fact_stream_event", with_views("SELECT event_id, event_type, user_id, session_id, video_id, event_timestamp AS event_ms, created_ts > event_timestamp AS is_late, created_ts - event_timestamp AS delay_ms FROM stream_events", "stream_events"))
def fact_stream_event(spark, d):
    delay = F.col("created_ts") - F.col("event_timestamp")
    rows = domain.stream_events(spark, d).withColumns({"is_late": delay > 0, "delay_ms": delay})
    return models.fact_stream_event(rows).withColumn("event_ms", F.unix_millis("event_ts")).drop("event_ts")


def _obt(key: str, watch: str, seen: str, dim: str, cols: str) -> str:
    return f"""SELECT {key}, date, {cols} FROM (SELECT {key}, playback_date AS date, {watch} FROM playback_history GROUP BY ALL) w
  FULL OUTER JOIN (SELECT {key}, playback_date AS date, {seen} FROM ad_impressions GROUP BY ALL) s USING ({key}, date) LEFT JOIN ({dim}) x USING ({key})"""


@register("obt_user_media_activity_daily", with_views(_obt("user_id", "count(*) AS watches, sum(watch_hours) AS watch_hours, count(DISTINCT video_id) AS videos", "count(*) AS impressions, sum(CAST(clicked AS BIGINT)) AS clicks", "SELECT user_id, country, user_subscription AS tier FROM users", "country, tier, coalesce(watches, 0) AS watches, round(coalesce(watch_hours, 0), 6) AS watch_hours, coalesce(videos, 0) AS videos, coalesce(impressions, 0) AS impressions, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks"), "users", "playback_history", "ad_impressions"))
def obt_user(spark, d):
    return rounded(models.obt_user_media_activity_daily(domain.playback_history(spark, d), domain.ad_impressions(spark, d), models.dim_user(domain.users(spark, d))))


@register("obt_video_performance_daily", with_views(_obt("video_id", "count(*) AS watches, sum(watch_hours) AS watch_hours, count(DISTINCT user_id) AS viewers", "count(*) AS impressions, sum(cost_nanos) AS cost_nanos", "SELECT video_id, video_genre, CASE WHEN video_duration < 600 THEN 'short' WHEN video_duration < 1800 THEN 'medium' ELSE 'long' END AS duration_band FROM videos", "video_genre, duration_band, coalesce(watches, 0) AS watches, round(coalesce(watch_hours, 0), 6) AS watch_hours, coalesce(viewers, 0) AS viewers, coalesce(impressions, 0) AS impressions, CAST(coalesce(cost_nanos, 0) AS BIGINT) AS cost_nanos"), "videos", "playback_history", "ad_impressions"))
def obt_video(spark, d):
    return rounded(models.obt_video_performance_daily(domain.playback_history(spark, d), domain.ad_impressions(spark, d), models.dim_video(domain.videos(spark, d))))


# --- deduplication, pairing, sampling ----------------------------------------------------------------------------------------------------
@register("dedup_events", with_views("SELECT event_id, min(created_ts) AS created_ts, any_value(event_type) AS event_type FROM stream_events GROUP BY event_id", "stream_events"))
def dedup_events(spark, d):
    e = domain.stream_events(spark, d).select("event_id", "event_type", "created_ts")
    return checks.drop_duplicates_first(e.unionByName(e.withColumn("created_ts", F.col("created_ts") + 1)), "event_id", ["created_ts"])


@register("dedup_playback", with_views("SELECT history_id, min(playback_date) AS playback_date FROM playback_history GROUP BY history_id", "playback_history"))
def dedup_playback(spark, d):
    return checks.drop_duplicates_first(domain.playback_history(spark, d).select("history_id", "playback_date"), "history_id", ["playback_date"])


@register("modulo_pairs", with_views("SELECT user_id, v.video_id FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM users) u JOIN (SELECT video_id, row_number() OVER (ORDER BY video_id) - 1 AS j, count(*) OVER () AS n FROM videos) v ON u.i % v.n = v.j", "users", "videos"))
def modulo_pairs(spark, d):
    """User i watches video i modulo the number of videos."""
    u = bronze.row_ordinal(domain.users(spark, d).select("user_id"), ["user_id"])
    v = bronze.row_ordinal(domain.videos(spark, d).select("video_id"), ["video_id"])
    n = v.agg(F.count(F.lit(1)).alias("n"))
    return u.crossJoin(F.broadcast(n)).withColumn("source_row_number", F.col("source_row_number") % F.col("n")).join(v, "source_row_number").select("user_id", "video_id")


@register("interval_union", with_views("SELECT user_id, 'watch' AS kind FROM playback_history UNION ALL SELECT user_id, 'ad' FROM ad_impressions", "playback_history", "ad_impressions"))
def interval_union(spark, d):
    return domain.playback_history(spark, d).select("user_id", F.lit("watch").alias("kind")).unionByName(domain.ad_impressions(spark, d).select("user_id", F.lit("ad").alias("kind")))


@register("zipf_weights", "SELECT i AS rank, round(pow(i, -0.8) / sum(pow(i, -0.8)) OVER (), 9) AS weight FROM (SELECT CAST(unnest(generate_series(1, 100)) AS BIGINT) AS i)")
def zipf_weights(spark, d):
    return rounded(sampling.zipf_weights(spark, 100, 0.8).select("rank", "weight"), 9)


# --- synthetic sources: their invariants --------------------------------------------------------------------------------------------------
_SHAPE = offline.Shape()


def _unlike(df: DataFrame, column: str, shares: dict[str, float], points: float) -> DataFrame:
    """A row for each value whose share of df is more than some percentage points off."""
    want = df.sparkSession.createDataFrame([(k, 100 * v / sum(shares.values())) for k, v in shares.items()], "value string, want double")
    got = profiles.distribution(df, column).select(F.col("value").cast("string").alias("value"), "pct")
    return want.join(got, "value", "full").where(F.abs(F.coalesce("pct", F.lit(0.0)) - F.coalesce("want", F.lit(0.0))) > points)


@register(
    "synthetic_invariants",
    """SELECT * FROM (VALUES ('ad_pairs_outside_playback', CAST(0 AS BIGINT)), ('ad_rows', 10000), ('interaction_pairs_outside_playback', 0), ('legacy_with_tracking', 0), ('legacy_rows', 6000), ('current_without_tracking', 0),
  ('sessions_with_two_users_or_days', 0), ('sessions_over_four_watches', 0), ('users', 2500), ('videos', 1000), ('wrong_likes', 0), ('playback_rows', 25500), ('playback_ids', 25000), ('interaction_rows', 15300), ('interaction_ids', 15000),
  ('ids_outside_1_to_n', 0), ('unlike_tiers', 0), ('unlike_genres', 0), ('unlike_countries', 0), ('unlike_top_videos', 0), ('unlike_interactions', 0), ('unlike_clicks', 0)) t(metric, value)""",
)
def synthetic_invariants(spark, d):
    """Referential, size, share and schema-evolution invariants of a generated platform of default size; each is a count."""
    t = offline.generate(spark, _SHAPE)
    p, ads, acts, users, videos = (stage(t[n], n) for n in ("playback_history", "ad_impressions", "interactions", "users", "videos"))
    old = F.col("playback_date") < F.lit(_SHAPE.change)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    sessions = p.dropDuplicates(["history_id"]).groupBy("session_id").agg(F.countDistinct("user_id").alias("u"), F.countDistinct("playback_date").alias("n"), F.count("*").alias("watches"))
    zipf = lambda names, skew: {n: (k + 1) ** -skew for k, n in enumerate(names)}
    number = lambda c: F.regexp_extract(c, "_([0-9]+)$", 1).cast("long")
    ids = users.select(number("user_id").alias("i"), F.lit(_SHAPE.users).alias("n")).unionByName(videos.select(number("video_id").alias("i"), F.lit(_SHAPE.videos).alias("n"))).unionByName(p.select(number("history_id").alias("i"), F.lit(_SHAPE.sessions).alias("n")))
    top_videos = p.withColumn("v", number("video_id")).select(F.when(F.col("v") <= 5, F.col("v").cast("string")).otherwise("rest").alias("v"))
    weights = [(k + 1) ** -_SHAPE.popularity_skew for k in range(_SHAPE.videos)]
    parts = [
        count(ads.join(p, ["user_id", "video_id", "playback_date"], "left_anti"), "ad_pairs_outside_playback"), count(ads, "ad_rows"), count(acts.join(p, ["user_id", "video_id"], "left_anti"), "interaction_pairs_outside_playback"),
        count(ads.where(old & (F.col("midpoint").isNotNull() | F.col("third_quartile").isNotNull())), "legacy_with_tracking"), count(ads.where(old), "legacy_rows"), count(ads.where(~old & (F.col("midpoint").isNull() | F.col("third_quartile").isNull())), "current_without_tracking"),
        count(sessions.where("u > 1 or n > 1"), "sessions_with_two_users_or_days"), count(sessions.where("watches > 4"), "sessions_over_four_watches"), count(users, "users"), count(videos, "videos"),
        count(acts.where("(interaction_type = 'like') <> coalesce(likes, false) or (interaction_type = 'dislike') <> coalesce(not likes, false)"), "wrong_likes"),
        count(p, "playback_rows"), count(p.select("history_id").distinct(), "playback_ids"), count(acts, "interaction_rows"), count(acts.select("interaction_id").distinct(), "interaction_ids"), count(ids.where("i < 1 or i > n"), "ids_outside_1_to_n"),
        count(_unlike(users, "user_subscription", zipf(_SHAPE.tiers, 1), 3), "unlike_tiers"), count(_unlike(videos, "video_genre", zipf(_SHAPE.genres, _SHAPE.genre_skew), 4), "unlike_genres"), count(_unlike(users, "country", dict.fromkeys(_SHAPE.countries, 1.0), 3), "unlike_countries"),
        count(_unlike(top_videos, "v", {str(k + 1): w for k, w in enumerate(weights[:5])} | {"rest": sum(weights[5:])}, 1), "unlike_top_videos"), count(_unlike(acts, "interaction_type", offline.INTERACTIONS, 2), "unlike_interactions"),
        count(_unlike(ads, "clicked", {"true": _SHAPE.click_rate, "false": 1 - _SHAPE.click_rate}, 1), "unlike_clicks"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return stage(out, "invariants")


for _n in ("users", "videos", "playback_history", "interactions", "ad_impressions"):

    @register(f"synthetic_{_n}")
    def _synthetic(spark, d, name=_n):
        return offline.generate(spark, _SHAPE)[name]


_STREAM = stream.StreamShape(start_ms=1_767_297_000_000, minutes=90, chains_per_minute=5, users=50, videos=20)  # 2026-01-01 19:50 UTC


@register("synthetic_stream_events")
def synthetic_stream(spark, d):
    return stream.events(spark, _STREAM)


@register("synthetic_stream_invariants", "SELECT * FROM (VALUES ('ad_without_start', CAST(0 AS BIGINT)), ('bad_late', 0), ('chains', 1250), ('click_before_ad', 0), ('two_of_an_id_beyond_copies', 0)) t(metric, value)")
def synthetic_stream_invariants(spark, d):
    """80 of the 90 minutes lie in the burst window, which has three times the 5 chains: 10 * 5 + 80 * 15 are 1,250."""
    e = stream.events(spark, _STREAM)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    chain = F.floor(F.regexp_extract("event_id", "_([0-9]+)$", 1).cast("long") / 5)
    one = checks.drop_duplicates_first(e, "event_id", ["created_ts"]).withColumn("chain", chain)
    per = one.groupBy("chain").agg(F.max(F.when(F.col("event_type") == "playback_start", F.col("event_timestamp"))).alias("start"), F.max(F.when(F.col("event_type") == "ad_impression", F.col("event_timestamp"))).alias("ad"), F.max(F.when(F.col("event_type") == "ad_click", F.col("event_timestamp"))).alias("click"))
    delay = F.col("created_ts") - F.col("event_timestamp")
    return count(per.where("start is null or ad is null or ad <= start"), "ad_without_start").unionByName(count(one.where((delay < 0) | (delay > 48 * 3_600_000 + 1)), "bad_late")).unionByName(count(per, "chains")).unionByName(count(per.where("click <= ad"), "click_before_ad")).unionByName(count(e.groupBy("event_id").count().where("count > 2"), "two_of_an_id_beyond_copies"))


# --- files and streams --------------------------------------------------------------------------------------------------------------------
def _events(spark: SparkSession, d: str) -> DataFrame:
    """Test events under the declared event schema."""
    e = domain.stream_events(spark, d)
    have = {c: F.col(c) for c in e.columns}
    have |= {"device_type": F.lit("web"), "platform": F.lit("web"), "genre_id": F.lit(None)}
    return e.select(*[have[f.name].cast(f.dataType).alias(f.name) for f in EVENT])


@register("avro_round_trip", with_views("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, event_timestamp, created_ts, playback_position_seconds, midpoint FROM stream_events", "stream_events"))
def avro_round_trip(spark, d):
    spark.dataSource.register(avro_ocf.AvroOcf)
    path = scratch(spark) + "/events"
    _events(spark, d).write.format("avro_ocf").mode("append").save(path)
    return avro_ocf.read_events(spark, path).select("event_id", "event_type", "event_timestamp", "created_ts", "playback_position_seconds", "midpoint")


@register("avro_hourly", with_views("SELECT strftime(make_timestamp(event_timestamp * 1000), '%Y%m%d%H') AS hour, CAST(event_id AS VARCHAR) AS event_id, event_type, created_ts FROM stream_events", "stream_events"))
def avro_hourly(spark, d):
    """Hour folders, written twice: the second run replaces the first's."""
    path = scratch(spark) + "/hours"
    events = _events(spark, d)
    avro_ocf.write_hourly(events, path)
    avro_ocf.write_hourly(events, path)
    got = avro_ocf.read_events(spark, path)
    return got.select(F.date_format(F.timestamp_millis("event_timestamp"), "yyyyMMddHH").alias("hour"), "event_id", "event_type", "created_ts")


_ROLLING = with_views(
    """SELECT user_id, window_end_ms, count(*) FILTER (event_type = 'playback_start' AND event_timestamp > window_end_ms - 1800000) AS f_stream_videos_started_30m,
  round(coalesce(avg(CAST(coalesce(midpoint, false) OR coalesce(third_quartile, false) AS INTEGER)) FILTER (event_type = 'ad_impression'), 0.0), 6) AS f_stream_ad_completion_ratio_60m,
  round(least(coalesce(count(*) FILTER (event_type = 'skip' AND coalesce(playback_position_seconds, 11) <= 10) / nullif(CAST(count(*) FILTER (event_type = 'playback_start') AS DOUBLE), 0), 0.0), 1.0), 6) AS f_stream_early_skip_rate_60m,
  CAST(count(*) >= 2 AS BIGINT) AS f_stream_burst_activity_flag
  FROM (SELECT *, CAST(900000 * (ceil(event_timestamp / 900000) + i) AS BIGINT) AS window_end_ms FROM stream_events, range(4) r(i)) GROUP BY user_id, window_end_ms""",
    "stream_events",
)


@register("rolling_features", _ROLLING)
def rolling_features(spark, d):
    return rounded(pipelines.rolling_features(domain.stream_events(spark, d), burst=2))


@register("stream_rolling_features", _ROLLING)
def stream_rolling_features(spark, d):
    """The same by Structured Streaming over files of events, one trigger; its complete output equals the batch query's."""
    path = scratch(spark)
    events = domain.stream_events(spark, d)
    events.write.parquet(f"{path}/in")
    live = pipelines.rolling_features(spark.readStream.schema(events.schema).parquet(f"{path}/in"), burst=2)
    return rounded(pipelines.run_once(live, f"{path}/out", f"{path}/checkpoint", "complete"))


@register("stream_dedup_events", with_views("SELECT event_id, event_type FROM stream_events", "stream_events"))
def stream_dedup_events(spark, d):
    path = scratch(spark)
    events = domain.stream_events(spark, d).select("event_id", "event_type", "event_timestamp")
    events.unionByName(events).write.parquet(f"{path}/in")
    live = pipelines.dedup_events(spark.readStream.schema(events.schema).parquet(f"{path}/in")).select("event_id", "event_type")
    return pipelines.run_once(live, f"{path}/out", f"{path}/checkpoint")


@register("stream_bronze", with_views("SELECT 'media_events:' || (event_id % 3) || ':' || (event_id // 3) AS source_offset, CASE event_id % 50 WHEN 7 THEN 'missing payload' WHEN 13 THEN 'payload is not JSON' WHEN 21 THEN 'payload is not a JSON object' END AS parse_error FROM stream_events", "stream_events"))
def stream_bronze(spark, d):
    path = scratch(spark)
    kafka_rows(spark, d).write.parquet(f"{path}/in")
    pipelines.bronze_sink(pipelines.file_records(spark, f"{path}/in"), f"{path}/raw", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/raw").select("source_offset", "parse_error")
