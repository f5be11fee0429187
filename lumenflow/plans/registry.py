"""Registered queries of the media engine on the test tables, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.operators import bronze, checks, features, models, profiles
from lumenflow.schemas import DEDUP_KEYS
from lumenflow.sources import domain
from lumenflow.sources.domain import AS_OF, CHANGE_DATE, WINDOW_END_MS, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: the order of a sum isn't fixed in either engine."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- features -------------------------------------------------------------------------------------------------------------------------
_IN_WINDOW = f"playback_date BETWEEN DATE '{AS_OF}' - 89 AND DATE '{AS_OF}'"
_WATCH = f"SELECT user_id, sum(watch_hours) AS hours, max(playback_date) AS last, count(DISTINCT history_id) AS sessions FROM playback_history WHERE {_IN_WINDOW} GROUP BY user_id"
_RISK = f"least(greatest(0.5 * least(greatest((DATE '{AS_OF}' - last) / 90.0, 0), 1) + 0.3 * (1 - least(greatest(sessions / 20.0, 0), 1)) + 0.2 * (1 - least(greatest(hours / 20.0, 0), 1)), 0), 1)"
_GENRES = f"SELECT user_id, count(DISTINCT video_genre) AS genres FROM playback_history LEFT JOIN videos USING (video_id) WHERE {_IN_WINDOW} GROUP BY user_id"
_CTR = f"SELECT user_id, avg(CAST(coalesce(clicked, false) AS INTEGER)) AS ctr FROM ad_impressions WHERE {_IN_WINDOW} GROUP BY user_id"
_OFFLINE = f"""SELECT u.user_id, round(coalesce(hours, 0.0), 6) AS f_user_total_watch_hours_90d, coalesce(genres, 0) AS f_user_distinct_genres_90d,
  round(coalesce(ctr, 0.0), 6) AS f_user_historical_ad_ctr_90d, round(coalesce({_RISK.replace("last)", "w.last)")}, 1.0), 6) AS risk, w.user_id IS NULL AS idle
  FROM (SELECT DISTINCT user_id FROM users) u LEFT JOIN ({_WATCH}) w USING (user_id) LEFT JOIN ({_GENRES}) g USING (user_id) LEFT JOIN ({_CTR}) c USING (user_id)"""
_OFFLINE_SQL = f"SELECT user_id, f_user_total_watch_hours_90d, f_user_distinct_genres_90d, f_user_historical_ad_ctr_90d, CAST(CASE WHEN idle THEN 1.0 ELSE risk END AS DOUBLE) AS f_user_subscription_churn_risk_90d FROM ({_OFFLINE})"
_MEDIA = ("users", "videos", "playback_history", "ad_impressions")


@register("feat_user_90d", with_views(_OFFLINE_SQL, *_MEDIA))
def feat_user_90d(spark, d):
    return rounded(features.user_90d(domain.tables(spark, d), AS_OF))


@register("total_watch_hours_90d", with_views(f"SELECT user_id, round(hours, 6) AS f_user_total_watch_hours_90d FROM ({_WATCH})", "playback_history"))
def total_watch_hours(spark, d):
    return rounded(features.watch_features(domain.playback_history(spark, d), AS_OF).select("user_id", features.OFFLINE[0]))


@register("churn_risk_90d", with_views(f"SELECT user_id, round(CAST({_RISK} AS DOUBLE), 6) AS f_user_subscription_churn_risk_90d FROM ({_WATCH})", "playback_history"))
def churn_risk(spark, d):
    return rounded(features.watch_features(domain.playback_history(spark, d), AS_OF).select("user_id", features.OFFLINE[3]))


@register("distinct_genres_90d", with_views(f"SELECT user_id, genres AS f_user_distinct_genres_90d FROM ({_GENRES})", "playback_history", "videos"))
def distinct_genres(spark, d):
    return features.genre_features(domain.playback_history(spark, d), domain.videos(spark, d), AS_OF)


@register("ad_ctr_90d", with_views(f"SELECT user_id, round(ctr, 6) AS f_user_historical_ad_ctr_90d FROM ({_CTR})", "ad_impressions"))
def ad_ctr(spark, d):
    return rounded(features.ctr_features(domain.ad_impressions(spark, d), AS_OF))


def _stream_sql(end: int, burst: int, early: int, long: int, short: int) -> str:
    return f"""SELECT user_id, count(*) FILTER (event_type = 'playback_start' AND event_timestamp > {end - short * 60_000}) AS f_stream_videos_started_30m,
  round(coalesce(avg(CAST(coalesce(midpoint, false) OR coalesce(third_quartile, false) AS INTEGER)) FILTER (event_type = 'ad_impression'), 0.0), 6) AS f_stream_ad_completion_ratio_60m,
  round(least(coalesce(count(*) FILTER (event_type = 'skip' AND coalesce(playback_position_seconds, {early + 1}) <= {early}) / nullif(CAST(count(*) FILTER (event_type = 'playback_start') AS DOUBLE), 0), 0.0), 1.0), 6) AS f_stream_early_skip_rate_60m,
  CAST(count(*) >= {burst} AS BIGINT) AS f_stream_burst_activity_flag
  FROM stream_events WHERE event_timestamp > {end - long * 60_000} AND event_timestamp <= {end} AND user_id IS NOT NULL GROUP BY user_id"""


_DAY = (WINDOW_END_MS, 3, 10, 7 * 1440, 1440)


@register("feat_stream_60m", with_views(_stream_sql(WINDOW_END_MS, 2, 10, 60, 30), "stream_events"))
def feat_stream_60m(spark, d):
    return rounded(features.stream_60m(domain.stream_events(spark, d), WINDOW_END_MS, 2, 10))


@register("feat_stream_7d", with_views(_stream_sql(*_DAY), "stream_events"))
def feat_stream_7d(spark, d):
    """The stream features over windows that suit the sparse test events: 7 days and 1 day."""
    return rounded(features.stream_60m(domain.stream_events(spark, d), _DAY[0], _DAY[1], _DAY[2], _DAY[3], _DAY[4]))


for _k, _c in enumerate(features.STREAM):

    @register(("videos_started", "ad_completion_ratio", "early_skip_rate", "burst_flag")[_k], with_views(f"SELECT user_id, {_c} FROM ({_stream_sql(*_DAY)})", "stream_events"))
    def _one(spark, d, c=_c):
        return feat_stream_7d(spark, d).select("user_id", c)


@register(
    "feat_user_unified",
    with_views(
        f"""SELECT user_id, coalesce(f_user_total_watch_hours_90d, 0.0) AS f_user_total_watch_hours_90d, coalesce(f_user_distinct_genres_90d, 0) AS f_user_distinct_genres_90d,
  coalesce(f_user_historical_ad_ctr_90d, 0.0) AS f_user_historical_ad_ctr_90d, coalesce(f_user_subscription_churn_risk_90d, 1.0) AS f_user_subscription_churn_risk_90d,
  coalesce(f_stream_videos_started_30m, 0) AS f_stream_videos_started_30m, coalesce(f_stream_ad_completion_ratio_60m, 0.0) AS f_stream_ad_completion_ratio_60m,
  coalesce(f_stream_early_skip_rate_60m, 0.0) AS f_stream_early_skip_rate_60m, coalesce(f_stream_burst_activity_flag, 0) AS f_stream_burst_activity_flag, {WINDOW_END_MS // 1000 // 900 * 900} AS feature_epoch
  FROM ({_OFFLINE_SQL}) o FULL OUTER JOIN ({_stream_sql(*_DAY)}) s USING (user_id)""",
        *_MEDIA,
        "stream_events",
    ),
)
def feat_user_unified(spark, d):
    offline = features.user_90d(domain.tables(spark, d), AS_OF)
    both = features.unified(offline, features.stream_60m(domain.stream_events(spark, d), _DAY[0], _DAY[1], _DAY[2], _DAY[3], _DAY[4]), WINDOW_END_MS)
    return rounded(both.withColumn("feature_epoch", F.unix_seconds("feature_ts")).drop("feature_ts"))


for _name, _minutes in (("sliding_60m_counts", 60), ("sliding_30m_counts", 30)):

    @register(
        _name,
        with_views(
            f"""SELECT CAST(900000 * (ceil(event_timestamp / 900000) + i) AS BIGINT) AS window_end_ms, event_type, count(*) AS events, count(DISTINCT user_id) AS users
  FROM stream_events, range({_minutes // 15}) r(i) GROUP BY ALL""",
            "stream_events",
        ),
    )
    def _sliding(spark, d, minutes=_minutes):
        rows = features.sliding(domain.stream_events(spark, d), minutes)
        return rows.groupBy(F.unix_millis("w.end").alias("window_end_ms"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


# --- checks ---------------------------------------------------------------------------------------------------------------------------
@register("check_unique", with_views("SELECT 'unique' AS \"check\", 'history_id' AS columns, count(*) = count(DISTINCT history_id) AS passed, count(*) - count(DISTINCT history_id) AS duplicate_count FROM playback_history", "playback_history"))
def check_unique(spark, d):
    return checks.check_unique(domain.playback_history(spark, d), ["history_id"])


@register("check_unique_conversations", "SELECT 'unique' AS \"check\", 'conv_id,turn' AS columns, sum(c - 1) = 0 AS passed, CAST(sum(c - 1) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS c FROM conversations GROUP BY conv_id, turn)")
def check_unique_conversations(spark, d):
    return checks.check_unique(spark.read.parquet(f"{d}/conversations.parquet"), ["conv_id", "turn"])


@register("check_not_null", with_views("SELECT 'not_null' AS \"check\", c AS \"column\", n = 0 AS passed, CAST(n AS BIGINT) AS null_count FROM (SELECT 'midpoint' AS c, count(*) - count(midpoint) AS n FROM ad_impressions UNION ALL SELECT 'user_id', count(*) - count(user_id) FROM ad_impressions UNION ALL SELECT 'third_quartile', count(*) - count(third_quartile) FROM ad_impressions)", "ad_impressions"))
def check_not_null(spark, d):
    return checks.check_not_null(domain.ad_impressions(spark, d), ["midpoint", "user_id", "third_quartile"])


@register("check_referential_subset", with_views("SELECT 'referential_subset' AS \"check\", 'user_id->user_id' AS columns, count(*) = 0 AS passed, count(*) AS missing_count FROM (SELECT DISTINCT user_id FROM playback_history WHERE user_id IS NOT NULL EXCEPT SELECT user_id FROM users)", "playback_history", "users"))
def check_referential(spark, d):
    return checks.check_referential_subset(domain.playback_history(spark, d), domain.users(spark, d), "user_id", "user_id")


@register("check_referential_subset_failing", with_views("SELECT 'referential_subset' AS \"check\", 'video_id->video_id' AS columns, count(*) = 0 AS passed, count(*) AS missing_count FROM (SELECT DISTINCT video_id FROM playback_history WHERE video_id IS NOT NULL EXCEPT SELECT video_id FROM videos WHERE video_genre <> 'ECONOMY')", "playback_history", "videos"))
def check_referential_failing(spark, d):
    return checks.check_referential_subset(domain.playback_history(spark, d), domain.videos(spark, d).where("video_genre <> 'ECONOMY'"), "video_id", "video_id")


@register("missing_keys", with_views("SELECT DISTINCT user_id AS key FROM stream_events WHERE user_id NOT IN (SELECT user_id FROM users WHERE country <> 'NATION_3') AND user_id IS NOT NULL", "stream_events", "users"))
def missing_keys(spark, d):
    return checks.missing_keys(domain.stream_events(spark, d), domain.users(spark, d).where("country <> 'NATION_3'"), "user_id", "user_id")


for _t in ("playback_history", "interactions", "stream_events"):
    _key = DEDUP_KEYS[_t]

    @register(f"duplicate_rate_{_t}", with_views(f"SELECT count(*) AS row_count, count(*) - count(DISTINCT {_key}) AS duplicate_count, round((count(*) - count(DISTINCT {_key})) * 100.0 / count(*), 6) AS before_dedup_pct, 0.0 AS after_dedup_pct FROM {_t}", _t))
    def _duplicates(spark, d, t=_t, key=_key):
        return rounded(profiles.duplicate_rate(domain.VIEWS[t](spark, d), [key]))


@register("duplicate_rate_documents", "SELECT count(*) AS row_count, count(*) - count(DISTINCT text) AS duplicate_count, round((count(*) - count(DISTINCT text)) * 100.0 / count(*), 6) AS before_dedup_pct, 0.0 AS after_dedup_pct FROM documents")
def duplicate_documents(spark, d):
    return rounded(profiles.duplicate_rate(spark.read.parquet(f"{d}/documents.parquet").withColumn("text", F.sha2("text", 256)), ["text"]))


# --- profiles -------------------------------------------------------------------------------------------------------------------------
def _long(table: str, **exprs: str) -> str:
    """A long-form oracle: metric, value."""
    return with_views(" UNION ALL ".join(f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 4) AS value FROM {table}" for n, e in exprs.items()), table)


_PROFILE_SQL = {
    "users": dict(row_count="count(*)", distinct_users="count(DISTINCT user_id)", age_min="min(user_age)", age_max="max(user_age)", age_mean="avg(user_age)", countries="count(DISTINCT country)", tiers="count(DISTINCT user_subscription)"),
    "videos": dict(row_count="count(*)", distinct_videos="count(DISTINCT video_id)", genres="count(DISTINCT video_genre)", duration_min="min(video_duration)", duration_max="max(video_duration)", duration_mean="avg(video_duration)"),
    "playback_history": dict(row_count="count(*)", users="count(DISTINCT user_id)", videos="count(DISTINCT video_id)", watch_total="sum(watch_hours)", watch_mean="avg(watch_hours)", watch_median="median(watch_hours)"),
    "interactions": dict(row_count="count(*)", users="count(DISTINCT user_id)", types="count(DISTINCT interaction_type)", liked="count(*) FILTER (likes)", disliked="count(*) FILTER (NOT likes)", without_opinion="count(*) FILTER (likes IS NULL)"),
    "ad_impressions": dict(row_count="count(*)", users="count(DISTINCT user_id)", videos="count(DISTINCT video_id)", advertisers="count(DISTINCT advertiser_id)", cost_min="min(cost_nanos)", cost_max="max(cost_nanos)", cost_mean="avg(cost_nanos)", cost_median="median(cost_nanos)", ctr_pct="avg(CAST(clicked AS INTEGER)) * 100"),
    "stream_events": dict(row_count="count(*)", users="count(DISTINCT user_id)", videos="count(DISTINCT video_id)", sessions="count(DISTINCT session_id)", campaigns="count(DISTINCT ad_campaign_id)", first_ms="min(event_timestamp)", last_ms="max(event_timestamp)", span_hours="(max(event_timestamp) - min(event_timestamp)) / 3600000.0", position_min="min(playback_position_seconds)", position_max="max(playback_position_seconds)", position_mean="avg(playback_position_seconds)"),
}
for _t, _m in _PROFILE_SQL.items():
    _sql = _long(_t, **_m)
    if _t == "ad_impressions":  # sums of costs differ in the last places
        _sql = _sql.replace("round(CAST(avg(cost_nanos) AS DOUBLE), 4)", "round(CAST(avg(cost_nanos) AS DOUBLE) / 1e6)")

    @register(f"profile_{_t}", _sql)
    def _profile(spark, d, t=_t):
        out = profiles.PROFILES[t](domain.VIEWS[t](spark, d))
        value = F.when(F.col("metric") == "cost_mean", F.round(F.col("value") / 1e6)).otherwise(F.round("value", 4))
        return out.select("metric", value.alias("value"))


for _name, _t, _c in (("tier_distribution", "users", "user_subscription"), ("genre_distribution", "videos", "video_genre"), ("interaction_distribution", "interactions", "interaction_type"), ("event_type_distribution", "stream_events", "event_type")):

    @register(_name, with_views(f'SELECT {_c} AS "value", count(*) AS "count", round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM {_t} WHERE {_c} IS NOT NULL GROUP BY {_c}', _t))
    def _distribution(spark, d, t=_t, c=_c):
        return rounded(profiles.distribution(domain.VIEWS[t](spark, d), c))


@register("top_countries", with_views('SELECT country AS "value", count(*) AS "count" FROM users GROUP BY country ORDER BY 2 DESC, 1 LIMIT 3', "users"))
def top_countries(spark, d):
    return profiles.top(domain.users(spark, d), "country")


@register("bottom_genres", with_views('SELECT video_genre AS "value", count(*) AS "count" FROM videos GROUP BY video_genre ORDER BY 2, 1 DESC LIMIT 3', "videos"))
def bottom_genres(spark, d):
    return profiles.top(domain.videos(spark, d), "video_genre", ascending=True)


@register(
    "genre_skew",
    with_views("SELECT max(CASE WHEN r = 1 THEN g END) AS top_genre, round(max(CASE WHEN r = 1 THEN round_even(pct, 1) END), 1) AS top_pct, round(sum(CASE WHEN b <= 3 THEN round_even(pct, 1) ELSE 0 END), 1) AS bottom3_pct FROM (SELECT g, pct, row_number() OVER (ORDER BY c DESC, g) AS r, row_number() OVER (ORDER BY c, g DESC) AS b FROM (SELECT video_genre AS g, count(*) AS c, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM videos GROUP BY video_genre))", "videos"),
)
def genre_skew(spark, d):
    return rounded(profiles.genre_skew(domain.videos(spark, d)), 1)


@register(
    "popularity_top20",
    with_views(
        "SELECT CAST(count(*) AS BIGINT) AS distinct_videos, count(DISTINCT views) AS distinct_count_values, CAST(max(head) AS BIGINT) AS top_videos, CAST(sum(CASE WHEN r <= head THEN views ELSE 0 END) AS BIGINT) AS top_views, CAST(sum(views) AS BIGINT) AS all_views, round(sum(CASE WHEN r <= head THEN views ELSE 0 END) * 100.0 / sum(views), 6) AS top_share_pct FROM (SELECT views, row_number() OVER (ORDER BY views DESC, video_id) AS r, floor(count(*) OVER () * 0.2) AS head FROM (SELECT video_id, count(*) AS views FROM playback_history GROUP BY video_id))",
        "playback_history",
    ),
)
def popularity(spark, d):
    return rounded(profiles.popularity(domain.playback_history(spark, d)))


@register("schema_evolution_nulls", with_views(f"SELECT CASE WHEN playback_date < DATE '{CHANGE_DATE}' THEN 'legacy' ELSE 'current' END AS period, count(*) AS row_count, round(avg(CAST(midpoint IS NULL AS INTEGER)) * 100, 6) AS midpoint_null_pct, round(avg(CAST(third_quartile IS NULL AS INTEGER)) * 100, 6) AS third_quartile_null_pct FROM ad_impressions GROUP BY 1", "ad_impressions"))
def schema_evolution(spark, d):
    return rounded(profiles.schema_evolution(domain.ad_impressions(spark, d), CHANGE_DATE))


@register("late_arrivals", with_views("SELECT count(*) FILTER (l) AS late_count, round(avg(CAST(l AS INTEGER)) * 100, 6) AS late_pct, round(min(h) FILTER (l), 6) AS delay_min_h, round(max(h) FILTER (l), 6) AS delay_max_h, round(avg(h) FILTER (l), 6) AS delay_mean_h FROM (SELECT created_ts > event_timestamp AS l, (created_ts - event_timestamp) / 3600000.0 AS h FROM stream_events)", "stream_events"))
def late_arrivals(spark, d):
    return rounded(profiles.late_arrivals(domain.stream_events(spark, d)))


@register("burst_analysis", with_views("SELECT CAST(floor(median(c)) AS BIGINT) AS baseline, max(c) AS peak, round(CASE WHEN floor(median(c)) = 0 THEN 1.0 ELSE max(c) / floor(median(c)) END, 6) AS ratio FROM (SELECT event_timestamp // 60000 AS minute, count(*) AS c FROM stream_events GROUP BY 1)", "stream_events"))
def burst_analysis(spark, d):
    return rounded(profiles.bursts(domain.stream_events(spark, d)))


@register("profile_features", with_views(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS null_count, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg({c}), 4) AS mean, count(*) FILTER ({c} IS DISTINCT FROM 0) AS nonzero_count FROM f" for c in features.OFFLINE).join((f"SELECT * FROM (WITH f AS ({_OFFLINE_SQL}) ", ")")), *_MEDIA))
def profile_features(spark, d):
    return rounded(profiles.feature_profile(features.user_90d(domain.tables(spark, d), AS_OF)), 4)
