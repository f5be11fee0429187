"""Synthetic stream events: chains of playback, advertisement, click, pause or skip and cancellation, a rate of them each minute."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.functions.sampling import bernoulli, choice, late_timestamp, uniform, uniform_int
from lumenflow.schemas import EVENT

# The stream's domains.
DEVICES = PLATFORMS = ("smart_tv", "web", "mobile_app")
POSITIONS = {"pause": (30, 3_600), "skip": (1, 30)}


@dataclass(frozen=True)
class StreamShape:
    start_ms: int
    minutes: int = 90
    chains_per_minute: int = 300
    bursts: tuple[str, ...] = ("20:00-22:00",)
    multiplier: int = 3
    click_rate: float = 0.03
    cancel_rate: float = 0.145
    pause_share: float = 0.65
    duplicate_rate: float = 0.02
    late_rate: float = 0.15
    late_hours: tuple[int, int] = (1, 48)
    change_ms: int = 0
    users: int = 2_500
    videos: int = 1_000
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.minutes, self.chains_per_minute, self.multiplier) < 0:
            raise ValueError("minutes, chains and the multiplier must not be negative")
        if not all(0 <= r <= 1 for r in (self.click_rate, self.cancel_rate, self.pause_share, self.duplicate_rate, self.late_rate)):
            raise ValueError("rates must be in [0, 1]")

    def summary(self) -> dict[str, object]:
        return {"generator": "stream"} | asdict(self)


def in_burst(ms: Column, bursts: tuple[str, ...]) -> Column:
    """Whether a time of day is in one of the HH:MM-HH:MM windows, start included, end not; none goes past midnight."""
    clock, out = F.date_format(F.timestamp_millis(ms), "HH:mm"), F.lit(False)
    for window in bursts:
        start, end = window.split("-")
        out = out | ((clock >= start) & (clock < end))
    return out


def chains(spark: SparkSession, s: StreamShape) -> DataFrame:
    """A row per chain: n (its number), t (its start) and the user, session and video that its events share: user i watches video i modulo the number of videos."""
    minutes = spark.range(s.minutes).select(F.col("id").alias("minute"), (F.lit(s.start_ms) + F.col("id") * 60_000).alias("t"))
    times = F.when(in_burst(F.col("t"), s.bursts), F.lit(s.chains_per_minute * s.multiplier)).otherwise(F.lit(s.chains_per_minute))
    rows = minutes.where(times > 0).select("minute", "t", F.explode(F.sequence(F.lit(1), times)).alias("k"))
    rows = rows.withColumn("n", F.col("minute") * (s.chains_per_minute * max(1, s.multiplier) + 1) + F.col("k"))
    user = uniform_int(s.seed + 1, 0, max(0, s.users - 1), "n")
    return rows.select("n", "t", F.format_string("user_%08d", user + 1).alias("user_id"), F.format_string("session_%010d", user + 1).alias("session_id"), F.format_string("video_%08d", user % max(1, s.videos) + 1).alias("video_id"), F.format_string("genre_%04d", user % 10 + 1).alias("genre_id"), choice(uniform(s.seed + 2, user), DEVICES).alias("device_type"), choice(uniform(s.seed + 3, user), PLATFORMS).alias("platform"), F.format_string("campaign_%06d", uniform_int(s.seed + 4, 1, 999, "n")).alias("campaign"))


def events(spark: SparkSession, s: StreamShape) -> DataFrame:
    """The events of all chains, with late creation times and repeated events (a millisecond later)."""
    n = F.col("n")
    ad_at = F.col("t") + uniform_int(s.seed + 10, 5, 90, n) * 1000
    click_at = ad_at + uniform_int(s.seed + 11, 1, 10, n) * 1000
    position = uniform_int(s.seed + 12, 10, 600, n)
    stop_at = F.col("t") + position * 1000
    paused = bernoulli(s.seed + 13, s.pause_share, n)

    def step(kind: Column | str, at: Column, on: Column, pos: Column | None = None, ad: bool = False, tracked: bool = False, bare: bool = False) -> Column:
        none = lambda kind: F.lit(None).cast(kind)
        current = tracked and (at >= s.change_ms)
        mid = bernoulli(s.seed + 20, 0.72, n)
        return F.when(on, F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), at.alias("event_timestamp"),
            (none("string") if bare else F.col("video_id")).alias("video_id"), (none("string") if bare else F.col("genre_id")).alias("genre_id"),
            (none("int") if pos is None else pos.cast("int")).alias("playback_position_seconds"), (F.col("campaign") if ad else none("string")).alias("ad_campaign_id"),
            (F.when(current, mid) if tracked else none("boolean")).alias("midpoint"), (F.when(current, mid & bernoulli(s.seed + 21, 0.68, n)) if tracked else none("boolean")).alias("third_quartile"),
        ))

    always = F.lit(True)
    steps = F.array(
        step("playback_start", F.col("t"), always, F.lit(0)),
        step("ad_impression", ad_at, always, None, ad=True, tracked=True),
        step("ad_click", click_at, bernoulli(s.seed + 14, s.click_rate, n), None, ad=True),
        step(F.when(paused, "pause").otherwise("skip"), stop_at, always, position),
        step("subscription_cancel", stop_at + 1000, bernoulli(s.seed + 15, s.cancel_rate, n), None, bare=True),
    )
    rows = chains(spark, s).select("n", "user_id", "session_id", "device_type", "platform", *[c for c in ("video_id", "genre_id", "campaign")], "t")
    made = rows.select("n", "user_id", "session_id", "device_type", "platform", F.posexplode(steps).alias("step", "e")).where("e is not null").select("n", "step", "user_id", "session_id", "device_type", "platform", "e.*")
    made = made.withColumn("event_id", F.concat(F.col("event_type"), F.lit("_"), F.lpad((n * 5 + F.col("step")).cast("string"), 12, "0")))
    made = made.withColumn("created_ts", late_timestamp(F.col("event_timestamp"), s.seed + 30, s.late_rate, *s.late_hours, "event_id")).select(*EVENT.names)
    again = made.where(uniform(s.seed + 40, "event_id") < s.duplicate_rate).withColumn("created_ts", F.col("created_ts") + 1)
    return made.unionByName(again)


def standalone(spark: SparkSession, s: StreamShape, kind: str, n: int) -> DataFrame:
    """n events of one kind outside of chains, at times over the minutes; a pause or skip has a position of its kind's default range."""
    if n < 0:
        raise ValueError("n must not be negative")
    at = F.lit(s.start_ms) + uniform_int(s.seed + 50, 0, max(0, s.minutes * 60_000 - 1), "id")
    user = uniform_int(s.seed + 51, 1, max(1, s.users), "id")
    video = uniform_int(s.seed + 52, 1, max(1, s.videos), "id")
    position = uniform_int(s.seed + 53, *POSITIONS[kind], "id") if kind in POSITIONS else F.lit(0) if kind == "playback_start" else F.lit(None)
    bare, ad = kind == "subscription_cancel", kind in ("ad_impression", "ad_click")
    none = F.lit(None).cast("string")
    cells = {
        "event_id": F.format_string(f"{kind}_%012d", F.col("id") + 1), "event_type": F.lit(kind), "event_timestamp": at, "user_id": F.format_string("user_%08d", user), "session_id": F.format_string("session_%010d", user),
        "device_type": choice(uniform(s.seed + 2, user), DEVICES), "platform": choice(uniform(s.seed + 3, user), PLATFORMS), "video_id": none if bare else F.format_string("video_%08d", video), "genre_id": none if bare else F.format_string("genre_%04d", video % 10 + 1),
        "playback_position_seconds": position, "ad_campaign_id": F.format_string("campaign_%06d", uniform_int(s.seed + 54, 1, 999, "id")) if ad else none,
    }
    tracked = (at >= s.change_ms) if kind == "ad_impression" else F.lit(False)
    mid = bernoulli(s.seed + 55, 0.72, "id")
    cells |= {"midpoint": F.when(tracked, mid), "third_quartile": F.when(tracked, mid & bernoulli(s.seed + 56, 0.68, "id")), "created_ts": late_timestamp(at, s.seed + 57, s.late_rate, *s.late_hours, "id")}
    return spark.range(n).select(*[cells[f.name].cast(f.dataType).alias(f.name) for f in EVENT])
