"""Silver and gold models. Their names and sources are given; which columns they have is this engine's own design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenflow.operators.checks import drop_duplicates_first
from lumenflow.schemas import EVENT

_META = ("ingest_ts", "source_file", "source_table", "batch_id", "source_row_number", "ingest_date", "batch")


def latest(raw: DataFrame, key: str) -> DataFrame:
    """The newest row per key by ingest_ts, batch and place; rows aggregate before the shuffle. Null keys are dropped."""
    data = [c for c in raw.columns if c not in _META and c != key]
    row = F.max_by(F.struct(*data), F.struct("ingest_ts", "batch_id", "source_row_number"))
    return raw.where(F.col(key).isNotNull()).groupBy(key).agg(row.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in data])


def stg_users(raw: DataFrame) -> DataFrame:
    return latest(raw, "user_id")


def stg_videos(raw: DataFrame) -> DataFrame:
    return latest(raw, "video_id")


def stg_playback_history(raw: DataFrame) -> DataFrame:
    return latest(raw, "history_id")


def stg_interactions(raw: DataFrame) -> DataFrame:
    return latest(raw, "interaction_id")


def stg_ad_impressions(raw: DataFrame) -> DataFrame:
    tracked = F.col("midpoint").isNotNull() | F.col("third_quartile").isNotNull()
    return latest(raw, "impression_id").withColumn("has_vast_tracking", tracked)


def stg_stream_events(raw: DataFrame) -> DataFrame:
    """Parsed events without errors, the earliest created of each event_id, with is_late and delay_ms."""
    parsed = raw.where("parse_error is null and event_id is not null").select(F.from_json("raw_payload", T.StructType(list(EVENT))).alias("p")).select("p.*")
    one = drop_duplicates_first(parsed, "event_id", ["created_ts"])
    delay = F.col("created_ts") - F.col("event_timestamp")
    return one.withColumn("is_late", delay > 0).withColumn("delay_ms", delay)


def dim_user(users: DataFrame) -> DataFrame:
    age = F.col("user_age")
    band = F.when(age < 18, "under 18").when(age < 25, "18-24").when(age < 35, "25-34").when(age < 50, "35-49").when(age.isNotNull(), "50+")
    return users.select("user_id", "user_age", band.alias("age_band"), "country", F.col("user_subscription").alias("tier"))


def dim_video(videos: DataFrame) -> DataFrame:
    d = F.col("video_duration")
    band = F.when(d < 600, "short").when(d < 1800, "medium").when(d.isNotNull(), "long")
    return videos.select("video_id", "video_title", "video_genre", "video_duration", band.alias("duration_band"))


def dim_advertiser(ads: DataFrame) -> DataFrame:
    return ads.where("advertiser_id is not null").groupBy("advertiser_id").agg(F.count(F.lit(1)).alias("impressions"), F.sum(F.coalesce("clicked", F.lit(False)).cast("long")).alias("clicks"), F.sum("cost_nanos").alias("cost_nanos"))


def dim_date(spark: SparkSession, first: str, last: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), (F.weekday("date") + 1).alias("iso_weekday"))


def fact_playback_watch(playback: DataFrame) -> DataFrame:
    return playback.select("history_id", "session_id", "user_id", "video_id", "playback_date", "watch_hours")


def fact_interaction(interactions: DataFrame) -> DataFrame:
    return interactions.select("interaction_id", "user_id", "video_id", "interaction_type", "likes")


def fact_ad_impression(ads: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("midpoint"), F.lit(False)) | F.coalesce(F.col("third_quartile"), F.lit(False))
    return ads.select("impression_id", "user_id", "video_id", "advertiser_id", "playback_date", "cost_nanos", done.alias("completed"), F.coalesce("clicked", F.lit(False)).alias("clicked"))


def fact_stream_event(events: DataFrame) -> DataFrame:
    return events.select("event_id", "event_type", "user_id", "session_id", "video_id", F.timestamp_millis("event_timestamp").alias("event_ts"), "is_late", "delay_ms")


def obt_user_media_activity_daily(playback: DataFrame, ads: DataFrame, users: DataFrame) -> DataFrame:
    """A row for each user and day with watching or impressions, and the user's attributes."""
    watch = playback.groupBy("user_id", F.col("playback_date").alias("date")).agg(F.count(F.lit(1)).alias("watches"), F.sum("watch_hours").alias("watch_hours"), F.countDistinct("video_id").alias("videos"))
    seen = ads.groupBy("user_id", F.col("playback_date").alias("date")).agg(F.count(F.lit(1)).alias("impressions"), F.sum(F.col("clicked").cast("long")).alias("clicks"))
    both = watch.join(seen, ["user_id", "date"], "full_outer").join(users.select("user_id", "country", "tier"), "user_id", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return both.select("user_id", "date", "country", "tier", zero("watches", "long"), zero("watch_hours", "double"), zero("videos", "long"), zero("impressions", "long"), zero("clicks", "long"))


def obt_video_performance_daily(playback: DataFrame, ads: DataFrame, videos: DataFrame) -> DataFrame:
    """A row for each video and day with watching or impressions. Interactions have no date and are left out."""
    watch = playback.groupBy("video_id", F.col("playback_date").alias("date")).agg(F.count(F.lit(1)).alias("watches"), F.sum("watch_hours").alias("watch_hours"), F.countDistinct("user_id").alias("viewers"))
    seen = ads.groupBy("video_id", F.col("playback_date").alias("date")).agg(F.count(F.lit(1)).alias("impressions"), F.sum("cost_nanos").alias("cost_nanos"))
    both = watch.join(seen, ["video_id", "date"], "full_outer").join(videos.select("video_id", "video_genre", "duration_band"), "video_id", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return both.select("video_id", "date", "video_genre", "duration_band", zero("watches", "long"), zero("watch_hours", "double"), zero("viewers", "long"), zero("impressions", "long"), zero("cost_nanos", "long"))
