"""The media tables as views of the TPC-H-like test tables, in Spark and, for oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, CHANGE_DATE, WINDOW_END_MS = "2001-06-30", "1998-07-01", 1706659200000  # 2024-01-31 00:00 UTC


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    age = (13 + F.col("c_custkey") % 68).cast("int")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(F.col("c_custkey").alias("user_id"), age.alias("user_age"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("user_subscription"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("signup_date"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("video_title"), F.col("p_type").alias("video_genre"), (F.col("p_size") * 60).alias("video_duration"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")).alias("upload_date"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return _read(spark, sf_dir, "lineitem").join(o, "l_orderkey")


def playback_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("session_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("history_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("video_id"), F.to_date("l_shipdate").alias("playback_date"), (F.col("l_quantity") / 10).alias("watch_hours"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = F.when(p.isin("1-URGENT", "2-HIGH"), "like").when(p == "3-MEDIUM", "share").when(p == "4-NOT SPECIFIED", "comment").otherwise("dislike")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("interaction_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 200).alias("video_id"), kind.alias("interaction_type"))
    likes = F.when(F.col("interaction_type") == "like", True).when(F.col("interaction_type") == "dislike", False)
    return rows.withColumn("likes", likes)


def ad_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    current = day >= F.lit(CHANGE_DATE).cast("date")
    cost = F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000_000
    return _lines(spark, sf_dir).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("impression_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("video_id"), F.col("l_suppkey").alias("advertiser_id"), cost.alias("cost_nanos"), F.when(current, F.col("l_linestatus") == "F").alias("midpoint"), F.when(current, F.col("l_returnflag") == "A").alias("third_quartile"), (F.col("l_returnflag") == "R").alias("clicked"), day.alias("playback_date"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    name = F.when(kind == "view", "playback_start").when(kind == "error", "skip").when(kind == "purchase", "ad_impression").when(kind == "click", "ad_click").otherwise("pause")
    rows = e.select(F.col("event_id").alias("event_id"), name.alias("event_type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_timestamp"), F.col("user_id").alias("user_id"), (F.col("user_id") % 40).alias("session_id"), (F.col("event_id") % 200).alias("video_id"), k.alias("k"))
    late = F.when(F.col("k") >= 85, (1 + F.col("event_id") % 48) * 3_600_000).otherwise(0)
    ad = F.col("event_type") == "ad_impression"
    return rows.select("event_id", "event_type", "event_timestamp", (F.col("event_timestamp") + late).alias("created_ts"), "user_id", "session_id", "video_id", F.when(F.col("event_type").isin("skip", "pause", "playback_start"), F.col("k")).alias("playback_position_seconds"), F.when(ad, F.col("k") % 7).alias("ad_campaign_id"), F.when(ad, F.col("k") >= 50).alias("midpoint"), F.when(ad, F.col("k") >= 75).alias("third_quartile"))


VIEWS = {"users": users, "videos": videos, "playback_history": playback_history, "interactions": interactions, "ad_impressions": ad_impressions, "stream_events": stream_events}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: view(spark, sf_dir) for name, view in VIEWS.items()}


SQL = {
    "users": "SELECT c_custkey AS user_id, CAST(13 + c_custkey % 68 AS INTEGER) AS user_age, n_name AS country, c_mktsegment AS user_subscription, DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS signup_date FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "videos": "SELECT p_partkey AS video_id, p_name AS video_title, p_type AS video_genre, p_size * 60 AS video_duration, DATE '1995-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS upload_date FROM part",
    "playback_history": "SELECT l_orderkey AS session_id, l_orderkey * 10 + l_linenumber AS history_id, o_custkey AS user_id, l_partkey AS video_id, CAST(l_shipdate AS DATE) AS playback_date, l_quantity / 10 AS watch_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "interactions": "SELECT *, CASE interaction_type WHEN 'like' THEN true WHEN 'dislike' THEN false END AS likes FROM (SELECT o_orderkey AS interaction_id, o_custkey AS user_id, o_orderkey % 200 AS video_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'like' WHEN o_orderpriority = '3-MEDIUM' THEN 'share' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'comment' ELSE 'dislike' END AS interaction_type FROM orders)",
    "ad_impressions": f"SELECT l_orderkey * 10 + l_linenumber AS impression_id, o_custkey AS user_id, l_partkey AS video_id, l_suppkey AS advertiser_id, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000 AS cost_nanos, CASE WHEN CAST(l_shipdate AS DATE) >= DATE '{CHANGE_DATE}' THEN l_linestatus = 'F' END AS midpoint, CASE WHEN CAST(l_shipdate AS DATE) >= DATE '{CHANGE_DATE}' THEN l_returnflag = 'A' END AS third_quartile, l_returnflag = 'R' AS clicked, CAST(l_shipdate AS DATE) AS playback_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "stream_events": "SELECT event_id, event_type, event_timestamp, event_timestamp + CASE WHEN k >= 85 THEN (1 + event_id % 48) * 3600000 ELSE 0 END AS created_ts, user_id, user_id % 40 AS session_id, event_id % 200 AS video_id, CASE WHEN event_type IN ('skip', 'pause', 'playback_start') THEN k END AS playback_position_seconds, CASE WHEN event_type = 'ad_impression' THEN k % 7 END AS ad_campaign_id, CASE WHEN event_type = 'ad_impression' THEN k >= 50 END AS midpoint, CASE WHEN event_type = 'ad_impression' THEN k >= 75 END AS third_quartile FROM (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'playback_start' WHEN 'error' THEN 'skip' WHEN 'purchase' THEN 'ad_impression' WHEN 'click' THEN 'ad_click' ELSE 'pause' END AS event_type, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS event_timestamp, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
}


def with_views(sql: str, *names: str) -> str:
    """An oracle's SQL after the views that it names."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
