"""Synthetic media tables: distributions and invariants of the platform, made in Spark from row numbers and a seed."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.functions.sampling import bernoulli, categorical, choice, inject_duplicates, uniform, uniform_int, zipf_rank
from lumenflow.operators.bronze import row_ordinal
from lumenflow.schemas import TABLES

# The platform's domains and weights.
COUNTRIES = ("US", "GB", "CA", "AU", "DE", "FR", "IN", "JP", "BR", "VN")
TIERS = ("free", "basic", "premium", "family")
GENRES = ("Action", "Drama", "Comedy", "Documentary", "Thriller", "Romance", "Sci-Fi", "Animation", "Sports", "Kids")
INTERACTIONS = {"like": 0.62, "dislike": 0.08, "comment": 0.18, "share": 0.12}


@dataclass(frozen=True)
class Shape:
    """Sizes, pools, ranges and rates of a synthetic platform; sessions counts rows of playback_history before duplicates."""

    users: int = 2_500
    videos: int = 1_000
    sessions: int = 25_000
    interactions: int = 15_000
    impressions: int = 10_000
    genre_skew: float = 0.75
    popularity_skew: float = 0.8
    duplicate_rate: float = 0.02
    click_rate: float = 0.03
    legacy_share: float = 0.6
    advertisers: int = 50
    cost_nanos: tuple[int, int] = (500_000, 50_000_000)
    ages: tuple[int, int] = (13, 80)
    durations: tuple[int, int] = (300, 7_200)
    watches: tuple[int, int] = (1, 4)
    watch_hours: tuple[float, float] = (0.05, 4.0)
    countries: tuple[str, ...] = COUNTRIES
    tiers: tuple[str, ...] = TIERS
    genres: tuple[str, ...] = GENRES
    days: int = 120
    end: dt.date = dt.date(2026, 1, 31)
    change: dt.date = dt.date(2025, 12, 1)
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.users, self.videos, self.sessions, self.interactions, self.impressions) < 0 or self.days <= 0:
            raise ValueError("sizes must not be negative and days positive")
        if self.genre_skew < 0 or self.popularity_skew < 0:
            raise ValueError("skews must not be negative")
        for low, high in (self.ages, self.cost_nanos, self.watches, self.watch_hours, self.durations):
            if low > high:
                raise ValueError("ranges must be in order")
        if self.watches[0] <= 0 or self.watch_hours[0] <= 0 or self.advertisers <= 0:
            raise ValueError("watches, watch hours and advertisers must be positive")
        if not (self.countries and self.tiers and self.genres):
            raise ValueError("pools must not be empty")
        if not (0 <= self.duplicate_rate <= 1 and 0 <= self.click_rate <= 1 and 0 <= self.legacy_share <= 1):
            raise ValueError("rates must be in [0, 1]")


    def summary(self) -> dict[str, object]:
        return {"generator": "offline"} | {k: v.isoformat() if isinstance(v, dt.date) else v for k, v in asdict(self).items()}


def _day(end: dt.date, back: Column) -> Column:
    return F.date_sub(F.lit(end), back.cast("int"))


def _zipf_like(names: tuple[str, ...]) -> dict[str, float]:
    return {t: 1 / (k + 1) for k, t in enumerate(names)}


def users(spark: SparkSession, s: Shape) -> DataFrame:
    signup = F.date_sub(F.lit(s.end), uniform_int(s.seed + 5, 0, 1_460, "id").cast("int")).cast("timestamp_ntz")
    return spark.range(1, s.users + 1).select(F.format_string("user_%08d", "id").alias("user_id"), uniform_int(s.seed + 1, *s.ages, "id").cast("int").alias("user_age"), choice(uniform(s.seed + 2, "id"), s.countries).alias("country"), categorical(uniform(s.seed + 3, "id"), _zipf_like(s.tiers)).alias("user_subscription"), signup.alias("signup_ts"))


def videos(spark: SparkSession, s: Shape) -> DataFrame:
    genre = F.element_at(F.array(*[F.lit(g) for g in s.genres]), zipf_rank(uniform(s.seed + 11, "id"), len(s.genres), s.genre_skew).cast("int"))
    return spark.range(1, s.videos + 1).select(F.format_string("video_%08d", "id").alias("video_id"), F.format_string("Video %08d", "id").alias("video_title"), genre.alias("video_genre"), uniform_int(s.seed + 12, *s.durations, "id").cast("int").alias("video_duration"), _day(s.end, uniform_int(s.seed + 13, 0, 1_460, "id")).alias("upload_date"))


#: Rows of playback_history that are cut into sessions together; a session ends at their end.
RUN = 4_096


def playback_history(spark: SparkSession, s: Shape) -> DataFrame:
    """s.sessions rows in sessions of one to four watches that share a user and a day; popular videos have small numbers.

    round(rows * duplicate_rate) whole rows repeat. Sessions are cut from runs of RUN rows, each on its own.
    """
    n = s.sessions if s.users and s.videos else 0
    starts = spark.range(0, n, RUN).select(F.floor(F.col("id") / RUN).alias("run"), "id", F.explode(F.sequence(F.lit(0), F.lit(RUN - 1))).alias("k"))
    starts = starts.withColumn("length", uniform_int(s.seed + 23, *s.watches, "run", "k"))
    at = F.sum("length").over(Window.partitionBy("run").orderBy("k")) - F.col("length")  # at most RUN rows
    left = F.least(F.lit(RUN), F.lit(n) - F.col("id")) - F.col("at")
    cut = starts.withColumn("at", at).where(left > 0).withColumn("length", F.least("length", left))
    rows = cut.select((F.col("run") * RUN + F.col("k") + 1).alias("session"), (F.col("id") + F.col("at") + 1).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("step"))
    rows = rows.select("session", (F.col("first") + F.col("step")).alias("h"), uniform_int(s.seed + 21, 1, max(1, s.users), "session").alias("u"), _day(s.end, uniform_int(s.seed + 22, 0, s.days - 1, "session")).alias("playback_date"))
    video = zipf_rank(uniform(s.seed + 24, "h"), max(1, s.videos), s.popularity_skew)
    hours = F.lit(s.watch_hours[0]) + uniform(s.seed + 25, "h") * (s.watch_hours[1] - s.watch_hours[0])
    out = rows.select(F.format_string("session_%010d", "session").alias("session_id"), F.format_string("history_%010d", "h").alias("history_id"), F.format_string("user_%08d", "u").alias("user_id"), F.format_string("video_%08d", video).alias("video_id"), "playback_date", hours.alias("watch_hours"))
    return inject_duplicates(out, s.duplicate_rate, "history_id", s.seed + 26)


def drawn_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows of df with replacement, numbered id from 1: rows get dense numbers, draws join on these."""
    numbered = row_ordinal(df, [key])
    total = numbered.count()
    draws = df.sparkSession.range(1, (n if total else 0) + 1).withColumn("source_row_number", uniform_int(seed, 0, max(0, total - 1), "id"))
    return draws.join(numbered, "source_row_number").drop("source_row_number")


def interactions(playback: DataFrame, s: Shape) -> DataFrame:
    kind = categorical(uniform(s.seed + 31, "id"), INTERACTIONS)
    rows = drawn_rows(playback.select("history_id", "user_id", "video_id"), s.interactions, s.seed + 30, "history_id").withColumn("interaction_type", kind)
    likes = F.when(F.col("interaction_type") == "like", True).when(F.col("interaction_type") == "dislike", False)
    out = rows.select(F.format_string("interaction_%010d", "id").alias("interaction_id"), "user_id", "video_id", "interaction_type", likes.alias("likes"))
    return inject_duplicates(out, s.duplicate_rate, "interaction_id", s.seed + 32)


def ad_impressions(playback: DataFrame, s: Shape) -> DataFrame:
    """Impressions on watched (user, video, day)s: legacy_share of them before the change date, if both periods have rows; tracking columns only from it."""
    rows = playback.select("history_id", "user_id", "video_id", "playback_date")
    old, new = rows.where(F.col("playback_date") < F.lit(s.change)), rows.where(F.col("playback_date") >= F.lit(s.change))
    n_old = round(s.impressions * s.legacy_share)
    has_old, has_new = old.limit(1).count() > 0, new.limit(1).count() > 0
    n_old = n_old if has_old and has_new else s.impressions if has_old else 0
    some = drawn_rows(old, n_old, s.seed + 40, "history_id").unionByName(drawn_rows(new, s.impressions - n_old, s.seed + 41, "history_id").withColumn("id", F.col("id") + n_old))
    current = F.col("playback_date") >= F.lit(s.change)
    mid = bernoulli(s.seed + 42, 0.72, "id")
    return some.select(F.format_string("impression_%010d", "id").alias("impression_id"), "user_id", "video_id", F.format_string("advertiser_%05d", uniform_int(s.seed + 43, 1, s.advertisers, "id")).alias("advertiser_id"), uniform_int(s.seed + 44, *s.cost_nanos, "id").alias("cost_nanos"), F.when(current, mid).alias("midpoint"), F.when(current, mid & bernoulli(s.seed + 45, 0.68, "id")).alias("third_quartile"), bernoulli(s.seed + 46, s.click_rate, "id").alias("clicked"), "playback_date")


def generate(spark: SparkSession, s: Shape = Shape()) -> dict[str, DataFrame]:
    """All five tables, in the order that they depend on each other, with their declared columns."""
    playback = playback_history(spark, s)
    made = {"users": users(spark, s), "videos": videos(spark, s), "playback_history": playback, "interactions": interactions(playback, s), "ad_impressions": ad_impressions(playback, s)}
    return {name: df.select(*TABLES[name].names) for name, df in made.items()}
