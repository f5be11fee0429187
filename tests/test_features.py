import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenflow.operators import features
from lumenflow.streaming import pipelines

D = dt.date
END = 1_769_947_200_000  # 2026-02-01 12:00 UTC
PLAYBACK = "history_id string, user_id string, video_id string, playback_date date, watch_hours double"


@pytest.fixture(scope="module")
def offline(spark):
    return {
        "users": spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u3",), (None,)], "user_id string"),
        "videos": spark.createDataFrame([("v1", "Action"), ("v2", "Drama"), ("v3", "Action")], "video_id string, video_genre string"),
        "playback_history": spark.createDataFrame([("h1", "u1", "v1", D(2026, 2, 1), 1.5), ("h2", "u1", "v2", D(2026, 1, 20), 2.0), ("h3", "u2", "v3", D(2026, 1, 15), 0.5), ("old", "u1", "v3", D(2025, 1, 1), 99.0), ("lost", "u9", "v1", D(2026, 1, 1), 1.0)], PLAYBACK),
        "ad_impressions": spark.createDataFrame([("u1", D(2026, 2, 1), True), ("u1", D(2026, 1, 20), False), ("u2", D(2026, 1, 15), None)], "user_id string, playback_date date, clicked boolean"),
    }


def test_user_90d_by_hand(offline):
    got = {r.user_id: tuple(r)[1:] for r in features.user_90d(offline, "2026-02-01").collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert got["u1"] == pytest.approx((3.5, 2, 0.5, 0.435))
    assert got["u2"] == pytest.approx((0.5, 1, 0.0, 0.5 * 17 / 90 + 0.3 * 0.95 + 0.2 * 0.975))
    assert got["u3"] == (0.0, 0, 0.0, 1.0)


def test_window_includes_both_ends(spark, offline):
    rows = [("a", "u1", "v1", D(2025, 11, 4), 1.0), ("b", "u1", "v1", D(2025, 11, 3), 10.0), ("c", "u1", "v1", D(2026, 2, 2), 100.0), ("a", "u1", "v1", D(2025, 11, 4), 1.0)]
    t = offline | {"playback_history": spark.createDataFrame(rows, PLAYBACK)}
    got = {r.user_id: r for r in features.user_90d(t, "2026-02-01").collect()}["u1"]
    assert got.f_user_total_watch_hours_90d == 2.0  # the repeated row counts
    assert got.f_user_subscription_churn_risk_90d == pytest.approx(0.5 * 89 / 90 + 0.3 * 0.95 + 0.2 * 0.9)


def test_missing_columns_of_ads(spark, offline):
    t = offline | {"ad_impressions": offline["ad_impressions"].drop("clicked", "playback_date")}
    assert {r.f_user_historical_ad_ctr_90d for r in features.user_90d(t, "2026-02-01").collect()} == {0.0}
    with pytest.raises(ValueError):
        features.user_90d(offline, "2026-02-01", 0)


EVENT = "user_id string, event_type string, event_timestamp long, playback_position_seconds int, midpoint boolean, third_quartile boolean"


def at(minutes, ms=0):
    return END - minutes * 60_000 + ms


ROWS = [
    ("u1", "playback_start", at(10), None, None, None), ("u1", "playback_start", at(20), None, None, None), ("u1", "ad_impression", at(40), None, True, None), ("u1", "ad_impression", at(50), None, False, None),
    ("u1", "skip", at(5), 5, None, None), ("u2", "playback_start", at(40), None, None, None), ("u2", "skip", at(10), 30, None, None), ("u1", "playback_start", at(70), None, None, None),
    ("u3", "pause", at(60), None, None, None), ("u4", "pause", at(0), None, None, None), ("u5", "pause", at(0, 1), None, None, None), ("u6", "skip", at(1), None, None, None),
    ("u7", "skip", at(1), 1, None, None), ("u7", "skip", at(2), 1, None, None), ("u7", "playback_start", at(3), 0, None, None), (None, "pause", at(1), None, None, None), ("u8", "playback_start", at(30), None, None, None),
]


def test_stream_features_by_hand(spark):
    got = {r.user_id: tuple(r)[1:] for r in features.stream_60m(spark.createDataFrame(ROWS, EVENT), END, 5, 10).collect()}
    assert got["u1"] == (2, 0.5, 0.5, 1) and got["u2"] == (0, 0.0, 0.0, 0)
    assert "u3" not in got and "u4" in got and "u5" not in got and None not in got
    assert got["u6"] == (0, 0.0, 0.0, 0) and got["u7"] == (1, 0.0, 1.0, 0) and got["u8"][0] == 0
    with pytest.raises(ValueError):
        features.stream_60m(spark.createDataFrame(ROWS, EVENT), END, 0)


def test_rolling_equals_single_windows(spark):
    events = spark.createDataFrame(ROWS, EVENT)
    rolling = pipelines.rolling_features(events, 5, 10)
    for end in (END, END - 900_000, END + 900_000):
        one = {tuple(r) for r in features.stream_60m(events, end, 5, 10).collect()}
        assert {tuple(r) for r in rolling.where(F.col("window_end_ms") == end).drop("window_end_ms").collect()} == one


def test_union_has_defaults_on_both_sides(spark, offline):
    stream = features.stream_60m(spark.createDataFrame([("u9", "playback_start", END - 1, None, None, None)], EVENT), END, 1)
    both = features.unified(features.user_90d(offline, "2026-02-01"), stream, END + 7 * 60_000)
    got = {r.user_id: r for r in both.collect()}
    assert set(got) == {"u1", "u2", "u3", "u9"}
    assert got["u9"].f_user_subscription_churn_risk_90d == 1.0 and got["u9"].f_stream_videos_started_30m == 1
    assert got["u1"].f_stream_burst_activity_flag == 0 and got["u1"].feature_ts == dt.datetime(2026, 2, 1, 12, 0)


def test_latest_date(spark, offline):
    assert features.latest_date(offline["playback_history"]) == D(2026, 2, 1)
    assert features.latest_date(offline["playback_history"].limit(0), None, "2025-05-05") == "2025-05-05"
    with pytest.raises(ValueError):
        features.latest_date(offline["playback_history"].limit(0))


def test_stream_window_plan_has_one_exchange(spark):
    plan = features.stream_60m(spark.createDataFrame(ROWS, EVENT), END, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
