"""User features: 90-day batch features, rolling stream features and their union.

One aggregate per fact table and one join per aggregate on user_id; single-key groupings keep partial aggregation and whole-stage
code generation, and all joins share one partitioning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFLINE = ("f_user_total_watch_hours_90d", "f_user_distinct_genres_90d", "f_user_historical_ad_ctr_90d", "f_user_subscription_churn_risk_90d")
STREAM = ("f_stream_videos_started_30m", "f_stream_ad_completion_ratio_60m", "f_stream_early_skip_rate_60m", "f_stream_burst_activity_flag")


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _as_date(day: dt.date | str | Column) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def in_window(date: str, as_of: dt.date | str | Column, days: int) -> Column:
    """The last days days up to as_of, both ends included."""
    end = _as_date(as_of)
    return F.to_date(date).between(F.date_sub(end, days - 1), end)


def watch_features(playback: DataFrame, as_of: dt.date | str | Column, days: int = 90) -> DataFrame:
    """user_id, total watch hours and churn risk in one pass over playback.

    Risk is half recency (days since the last watch by the window), three tenths sessions (distinct history ids by 20) and two
    tenths hours (by 20), each clipped to [0, 1]. It is worked out here, on active users only: clipping after the outer join would
    turn a missing user's null into 0.
    """
    rows = playback.where(in_window("playback_date", as_of, days) & F.col("user_id").isNotNull())
    got = rows.groupBy("user_id").agg(F.sum("watch_hours").alias("hours"), F.max(F.to_date("playback_date")).alias("last"), F.countDistinct("history_id").alias("sessions"))
    recency = _clip(F.datediff(_as_date(as_of), F.col("last")) / F.lit(float(days)))
    few = 1.0 - _clip(F.col("sessions") / F.lit(20.0))
    little = 1.0 - _clip(F.coalesce("hours", F.lit(0.0)) / F.lit(20.0))
    risk = _clip(0.5 * recency + 0.3 * few + 0.2 * little)
    return got.select("user_id", F.col("hours").cast("double").alias(OFFLINE[0]), risk.alias(OFFLINE[3]))


def genre_features(playback: DataFrame, videos: DataFrame, as_of: dt.date | str | Column, days: int = 90) -> DataFrame:
    """user_id and the number of distinct genres watched; Spark broadcasts videos only while its size allows."""
    rows = playback.where(in_window("playback_date", as_of, days) & F.col("user_id").isNotNull()).select("user_id", "video_id").distinct()
    genres = rows.join(videos.select("video_id", "video_genre").dropDuplicates(["video_id"]), "video_id", "left")
    return genres.groupBy("user_id").agg(F.countDistinct("video_genre").alias(OFFLINE[1]))


def ctr_features(ads: DataFrame, as_of: dt.date | str | Column, days: int = 90) -> DataFrame:
    """user_id and clicks by impressions. A null click is none; without a clicked column the rate is 0, without dates all rows count."""
    rows = ads.where(F.col("user_id").isNotNull())
    if "playback_date" in ads.columns:
        rows = rows.where(in_window("playback_date", as_of, days))
    clicked = F.coalesce(F.col("clicked"), F.lit(False)).cast("double") if "clicked" in ads.columns else F.lit(0.0)
    return rows.groupBy("user_id").agg(F.avg(clicked).alias(OFFLINE[2]))


def user_90d(tables: dict[str, DataFrame], as_of: dt.date | str | Column, days: int = 90) -> DataFrame:
    """The four batch features of every distinct user of users; an inactive one has zeros and risk 1."""
    if days <= 0:
        raise ValueError("days must be positive")
    spine = tables["users"].select("user_id").where(F.col("user_id").isNotNull()).distinct()
    parts = (watch_features(tables["playback_history"], as_of, days), genre_features(tables["playback_history"], tables["videos"], as_of, days), ctr_features(tables["ad_impressions"], as_of, days))
    for part in parts:
        spine = spine.join(part, "user_id", "left")
    return spine.select("user_id", F.coalesce(OFFLINE[0], F.lit(0.0)).alias(OFFLINE[0]), F.coalesce(OFFLINE[1], F.lit(0)).cast("long").alias(OFFLINE[1]), F.coalesce(OFFLINE[2], F.lit(0.0)).alias(OFFLINE[2]), F.coalesce(OFFLINE[3], F.lit(1.0)).alias(OFFLINE[3]))


def stream_aggregates(started_from: Column, burst: int, early_seconds: int) -> list[Column]:
    """The four stream features as conditional aggregates of the events of one user's long window."""
    kind = F.col("event_type")
    done = F.coalesce(F.col("midpoint"), F.lit(False)) | F.coalesce(F.col("third_quartile"), F.lit(False))
    starts = F.sum(F.when(kind == "playback_start", 1).otherwise(0))
    early = F.sum(F.when((kind == "skip") & (F.coalesce(F.col("playback_position_seconds"), F.lit(early_seconds + 1)) <= early_seconds), 1).otherwise(0))
    return [
        F.sum(F.when((kind == "playback_start") & started_from, 1).otherwise(0)).cast("long").alias(STREAM[0]),
        F.coalesce(F.avg(F.when(kind == "ad_impression", done.cast("double"))), F.lit(0.0)).alias(STREAM[1]),
        F.least(F.coalesce(F.try_divide(early.cast("double"), starts.cast("double")), F.lit(0.0)), F.lit(1.0)).alias(STREAM[2]),
        (F.count(F.lit(1)) >= burst).cast("long").alias(STREAM[3]),
    ]


def stream_60m(events: DataFrame, window_end_ms: int, burst: int = 100, early_seconds: int = 10, long_minutes: int = 60, short_minutes: int = 30) -> DataFrame:
    """Stream features of every user with an event in (end - long, end], by event time; starts are of (end - short, end].

    All four come from one scan and one shuffle. Nothing is deduplicated, as late and repeated events count.
    """
    if burst <= 0 or early_seconds < 0:
        raise ValueError("burst must be positive and early_seconds not negative")
    t = F.col("event_timestamp")
    rows = events.where((t > window_end_ms - long_minutes * 60_000) & (t <= window_end_ms) & F.col("user_id").isNotNull())
    return rows.groupBy("user_id").agg(*stream_aggregates(t > window_end_ms - short_minutes * 60_000, burst, early_seconds))


def feature_time(window_end_ms: int) -> Column:
    """The window's end, floored to a quarter of an hour."""
    return F.timestamp_seconds(F.lit(window_end_ms // 1000 // 900 * 900))


def unified(offline: DataFrame, stream: DataFrame, window_end_ms: int) -> DataFrame:
    """FULL OUTER union by user; users of one side have the other's defaults (risk 1, else 0), and feature_ts."""
    defaults = dict.fromkeys((*OFFLINE, *STREAM), 0.0) | {OFFLINE[3]: 1.0}
    both = offline.join(stream, "user_id", "full_outer")
    whole = {OFFLINE[1], STREAM[0], STREAM[3]}
    cols = [F.coalesce(F.col(c), F.lit(d)).cast("long" if c in whole else "double").alias(c) for c, d in defaults.items()]
    return both.select("user_id", *cols, feature_time(window_end_ms).alias("feature_ts"))


def latest_date(playback: DataFrame, *fallbacks: dt.date | str | None) -> dt.date | str:
    """The last playback date, else the first fallback that is set."""
    found = playback.agg(F.max(F.to_date("playback_date"))).first()[0] if "playback_date" in playback.columns else None
    for day in (found, *fallbacks):
        if day is not None:
            return day
    raise ValueError("no as-of date: playback is empty and no fallback is set")


def sliding(events: DataFrame, minutes: int, every: int = 15) -> DataFrame:
    """events with w, the windows (end - minutes, end] that hold them, ends every so many minutes; batch and streaming.

    F.window is closed on the left, so event time moves back by its unit, a millisecond.
    """
    t = F.timestamp_millis(F.col("event_timestamp") - 1)
    return events.withColumn("w", F.window(t, f"{minutes} minutes", f"{every} minutes"))


def ranked(df: DataFrame, by: str, *ties: str) -> DataFrame:
    """rank from 1 by falling value; df must be an aggregate, as all its rows meet in one task."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), *ties)))
