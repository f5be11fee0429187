"""Profiles of the media tables, the event stream and feature tables, as small DataFrames and as one report.

Counts and shares come from aggregates; windows run only over aggregated rows. Percentages round half to even, as the report
has them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.operators.checks import duplicate_stats


def metrics(df: DataFrame, **exprs: Column) -> DataFrame:
    """Aggregates in one scan, in long form: metric, value (double)."""
    wide = df.agg(*[e.cast("double").alias(n) for n, e in exprs.items()])
    return wide.unpivot([], list(exprs), "metric", "value")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, count and pct of the non-null values of a column."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") * 100.0 / F.col("total")).alias("pct"))


def top(df: DataFrame, column: str, n: int = 3, ascending: bool = False) -> DataFrame:
    """The n most frequent values (or least), ties by value; a top-n per task, then of these."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.asc("count") if ascending else F.desc("count"), F.desc("value") if ascending else F.asc("value")).limit(n)


def user_profile(users: DataFrame) -> DataFrame:
    return metrics(users, row_count=F.count(F.lit(1)), distinct_users=F.countDistinct("user_id"), age_min=F.min("user_age"), age_max=F.max("user_age"), age_mean=F.avg("user_age"), countries=F.countDistinct("country"), tiers=F.countDistinct("user_subscription"))


def video_profile(videos: DataFrame) -> DataFrame:
    return metrics(videos, row_count=F.count(F.lit(1)), distinct_videos=F.countDistinct("video_id"), genres=F.countDistinct("video_genre"), duration_min=F.min("video_duration"), duration_max=F.max("video_duration"), duration_mean=F.avg("video_duration"))


def genre_skew(videos: DataFrame) -> DataFrame:
    """top_genre, top_pct, bottom3_pct (0 with fewer than three genres)."""
    d = distribution(videos, "video_genre")
    up, down = Window.orderBy(F.desc("count"), "value"), Window.orderBy("count", F.desc("value"))
    d = d.withColumn("r", F.row_number().over(up)).withColumn("b", F.row_number().over(down))
    return d.agg(F.max(F.when(F.col("r") == 1, F.col("value"))).alias("top_genre"), F.max(F.when(F.col("r") == 1, F.bround("pct", 1))).alias("top_pct"), F.when(F.count(F.lit(1)) < 3, F.lit(0.0)).otherwise(F.sum(F.when(F.col("b") <= 3, F.bround("pct", 1)).otherwise(0.0))).alias("bottom3_pct"))


def playback_profile(playback: DataFrame) -> DataFrame:
    return metrics(playback, row_count=F.count(F.lit(1)), users=F.countDistinct("user_id"), videos=F.countDistinct("video_id"), watch_total=F.sum("watch_hours"), watch_mean=F.avg("watch_hours"), watch_median=F.median("watch_hours"))


def popularity(playback: DataFrame, share: float = 0.2) -> DataFrame:
    """How the most watched videos share the views.

    distinct_count_values is the number of different view counts, which some reports call the number of videos; distinct_videos is that.
    Ranks come from a histogram of counts, so no window meets more rows than there are different counts.
    """
    per_video = playback.where(F.col("video_id").isNotNull()).groupBy("video_id").agg(F.count(F.lit(1)).alias("views"))
    shape = per_video.groupBy("views").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("views")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = shape.agg(F.sum("n").alias("videos"), F.sum(F.col("n") * F.col("views")).alias("all_views"), F.count(F.lit(1)).alias("count_values"))
    rows = shape.withColumn("before", before).crossJoin(F.broadcast(total)).withColumn("head", F.floor(F.col("videos") * share))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("head") - F.col("before")))
    return rows.agg(F.max("videos").alias("distinct_videos"), F.max("count_values").alias("distinct_count_values"), F.coalesce(F.max("head"), F.lit(0)).cast("long").alias("top_videos"), F.coalesce(F.sum(taken * F.col("views")), F.lit(0)).cast("long").alias("top_views"), F.max("all_views").alias("all_views"), F.try_divide(F.sum(taken * F.col("views")) * 100.0, F.max("all_views")).alias("top_share_pct"))


def duplicate_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """row_count, duplicate_count, before_dedup_pct and after_dedup_pct (none are left once each key has one row)."""
    pct = F.coalesce(F.try_divide(F.col("duplicate_count") * 100.0, F.col("row_count")), F.lit(0.0))
    return duplicate_stats(df, keys).withColumn("before_dedup_pct", pct).withColumn("after_dedup_pct", F.lit(0.0))


def interaction_profile(interactions: DataFrame) -> DataFrame:
    return metrics(interactions, row_count=F.count(F.lit(1)), users=F.countDistinct("user_id"), types=F.countDistinct("interaction_type"), liked=F.count_if("likes"), disliked=F.count_if(~F.col("likes")), without_opinion=F.count_if(F.col("likes").isNull()))


def ad_profile(ads: DataFrame) -> DataFrame:
    clicked = F.coalesce(F.col("clicked"), F.lit(False)).cast("double")
    return metrics(ads, row_count=F.count(F.lit(1)), users=F.countDistinct("user_id"), videos=F.countDistinct("video_id"), advertisers=F.countDistinct("advertiser_id"), cost_min=F.min("cost_nanos"), cost_max=F.max("cost_nanos"), cost_mean=F.avg("cost_nanos"), cost_median=F.median("cost_nanos"), ctr_pct=F.avg(clicked) * 100)


def schema_evolution(ads: DataFrame, change_date: str) -> DataFrame:
    """period (legacy before the date, current from it), row_count, null rates of the tracking columns; no row unless there are legacy rows."""
    period = F.when(F.to_date("playback_date") < F.lit(change_date).cast("date"), "legacy").otherwise("current")
    rates = ads.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("row_count"), *[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"{c}_null_pct") for c in ("midpoint", "third_quartile")])
    legacy = rates.where("period = 'legacy'").select(F.lit(1).alias("one"))
    return rates.join(F.broadcast(legacy), F.lit(True), "left_semi")


def stream_profile(events: DataFrame) -> DataFrame:
    t = F.col("event_timestamp")
    pos = F.col("playback_position_seconds")
    return metrics(events, row_count=F.count(F.lit(1)), users=F.countDistinct("user_id"), videos=F.countDistinct("video_id"), sessions=F.countDistinct("session_id"), campaigns=F.countDistinct("ad_campaign_id"), first_ms=F.min(t), last_ms=F.max(t), span_hours=(F.max(t) - F.min(t)) / F.lit(3_600_000.0), position_min=F.min(pos), position_max=F.max(pos), position_mean=F.avg(pos))


def late_arrivals(events: DataFrame) -> DataFrame:
    """Events created after they happened: count, share and delay in hours. A repeated event that is a millisecond later counts."""
    late = F.col("created_ts") > F.col("event_timestamp")
    delay = F.when(late, (F.col("created_ts") - F.col("event_timestamp")) / F.lit(3_600_000.0))
    return events.agg(F.count_if(late).alias("late_count"), (F.avg(F.coalesce(late, F.lit(False)).cast("double")) * 100).alias("late_pct"), F.min(delay).alias("delay_min_h"), F.max(delay).alias("delay_max_h"), F.avg(delay).alias("delay_mean_h"))


def bursts(events: DataFrame) -> DataFrame:
    """Events a minute over minutes that have some: median (cut to an integer), peak and their ratio (1 if the median is 0)."""
    minutes = events.where(F.col("event_timestamp").isNotNull()).groupBy(F.floor(F.col("event_timestamp") / 60_000).alias("minute")).agg(F.count(F.lit(1)).alias("c"))
    out = minutes.agg(F.floor(F.median("c")).cast("long").alias("baseline"), F.max("c").alias("peak"))
    return out.withColumn("ratio", F.when(F.col("baseline") == 0, F.lit(1.0)).otherwise(F.col("peak") / F.col("baseline")))


def feature_profile(features: DataFrame) -> DataFrame:
    """feature, null_count, min, max, mean, nonzero_count of the numeric f_ columns. A null counts as not zero."""
    kinds = dict(features.dtypes)
    names = [c for c in features.columns if c.startswith("f_") and "feature_" not in c and kinds[c] in ("int", "bigint", "double", "float")]
    aggs = []
    for c in names:
        x = F.col(c).cast("double")
        stats = F.struct(F.lit(c).alias("feature"), F.count_if(x.isNull()).alias("null_count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.count_if(~x.eqNullSafe(F.lit(0.0))).alias("nonzero_count"))
        aggs.append(stats)
    return features.agg(F.array(*aggs).alias("stats")).select(F.inline("stats"))


def time_range(df: DataFrame, column: str) -> DataFrame:
    """first and last value of a time column."""
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))


PROFILES = {"users": user_profile, "videos": video_profile, "playback_history": playback_profile, "interactions": interaction_profile, "ad_impressions": ad_profile, "stream_events": stream_profile}


def report(profiles: dict[str, DataFrame]) -> str:
    """A text report of long-form profiles (metric, value), a section for each table; collects only metrics."""
    lines = ["DATA QUALITY REPORT", "=" * 19]
    for name, df in profiles.items():
        lines += ["", name.upper().replace("_", " ")]
        for row in df.collect():
            value = "-" if row["value"] is None else f"{row['value']:,.0f}" if float(row["value"]).is_integer() else f"{row['value']:,.2f}"
            lines.append(f"  {row['metric']:<20} {value}")
    return "\n".join(lines) + "\n"
