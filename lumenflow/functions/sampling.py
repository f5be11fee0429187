"""Seeded random columns: weights, categorical draws, duplicates and late times, as DataFrame expressions.

Draws hash a seed and the row's key rather than use rand(), so a retried task or another partitioning draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1), fixed by seed and keys."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def uniform_int(seed: int, low: int, high: int, *keys: Column | str) -> Column:
    """An integer from low to high, both included."""
    return (F.lit(low) + F.floor(uniform(seed, *keys) * (high - low + 1))).cast("long")


def bernoulli(seed: int, p: float, *keys: Column | str) -> Column:
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    return uniform(seed, *keys) < p


def zipf_weights(spark: SparkSession, n: int, skew: float) -> DataFrame:
    """rank 1..n with weight by rank ** -skew, normalised, and upto, the sum of weights before it."""
    if n <= 0 or skew < 0:
        raise ValueError("n must be positive and skew not negative")
    raw = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-float(skew))).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))
    rows = raw.crossJoin(F.broadcast(total)).select("rank", (F.col("raw") / F.col("total")).alias("weight"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("upto", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))


#: Ranks whose cumulated weights are listed one by one; beyond, their sum follows an asymptotic series to about 1e-12.
_LISTED = 32


def _harmonic(x: Column, skew: float, constant: float) -> Column:
    """The sum of k ** -skew for k up to x, x over _LISTED, by the Euler-Maclaurin series."""
    main = F.log(x) if abs(skew - 1) < 1e-9 else F.pow(x, F.lit(1 - skew)) / (1 - skew)
    return F.lit(constant) + main + F.pow(x, F.lit(-skew)) / 2 - F.pow(x, F.lit(-skew - 1)) * (skew / 12)


def zipf_rank(u: Column, n: int, skew: float) -> Column:
    """A rank from 1 to n for a uniform draw, by weight rank ** -skew: the first whose cumulated weight exceeds the draw. No table, no join."""
    if n <= 0 or skew < 0:
        raise ValueError("n must be positive and skew not negative")
    sums, listed = [], min(n, _LISTED)
    for k in range(1, listed + 1):
        sums.append((sums[-1] if sums else 0.0) + k**-skew)
    main = lambda x: math.log(x) if abs(skew - 1) < 1e-9 else x ** (1 - skew) / (1 - skew)
    series = lambda x: main(x) + x**-skew / 2 - x ** (-skew - 1) * (skew / 12)
    constant = sums[-1] - series(listed)
    total = sums[-1] if n == listed else constant + series(n)
    target = u * F.lit(total)
    small = F.size(F.filter(F.array(*[F.lit(x) for x in sums[:-1]]).cast("array<double>"), lambda x: x <= target)) + 1
    if n == listed:
        return small.cast("long")
    rest = target - F.lit(constant)
    near = F.floor(F.exp(rest) if abs(skew - 1) < 1e-9 else F.pow(rest * (1 - skew), F.lit(1 / (1 - skew)))).cast("double")
    large = near - 1
    for step in (-1.0, 0.0, 1.0):
        large = large + (_harmonic(near + step, skew, constant) <= target).cast("int")
    large = F.greatest(F.lit(listed + 1.0), F.least(large, F.lit(float(n))))
    return F.when(target < F.lit(sums[-1]), small.cast("long")).otherwise(large.cast("long"))


def categorical(u: Column, weights: Mapping[str, float]) -> Column:
    """A name by its weight; the last one takes what rounding leaves."""
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must be given, not negative and not all zero")
    total, at, out = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        at += weights[name] / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def choice(u: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.least(F.floor(u * len(names)) + 1, F.lit(len(names))).cast("int"))


def inject_duplicates(df: DataFrame, rate: float, key: str, seed: int) -> DataFrame:
    """df and a copy of round(rows * rate) of its rows, chosen by a hash of their key; rate is from 0 to 1."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must be in [0, 1]")
    if key not in df.columns:
        raise KeyError(key)
    return df.unionByName(sample_exact(df, round(df.count() * rate), seed, key))


def sample_exact(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement (all, if fewer), those of the smallest hashes of their keys.

    Counts of hash prefixes tell in which prefix the n-th row lies: rows below it are taken where they are, and only that one's
    (a 65,536th of all) are sorted.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return df.limit(0)
    h = F.xxhash64(F.lit(seed), *keys)
    prefix = F.shiftrightunsigned(h, 48)
    counts = df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.select("p", F.sum("c").over(Window.orderBy("p")).alias("upto"), "c")
    last = upto.where(F.col("upto") >= n).orderBy("p").limit(1).collect()
    if not last:
        return df
    sure = df.where(prefix < last[0].p)
    return sure.unionByName(df.where(prefix == last[0].p).orderBy(h, *keys).limit(n - (last[0].upto - last[0].c)))


def late_timestamp(event_ms: Column, seed: int, rate: float, low_hours: int, high_hours: int, *keys: Column | str) -> Column:
    """created_ts: with chance rate, low to high whole hours after the event, otherwise its own time."""
    if low_hours < 0 or low_hours > high_hours or not 0 <= rate <= 1:
        raise ValueError("delays must be in order and not negative, rate in [0, 1]")
    delay = uniform_int(seed + 1, low_hours, high_hours, *keys) * 3_600_000
    return F.when(uniform(seed, *keys) < rate, event_ms + delay).otherwise(event_ms)


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), *keys))
