"""Deterministic samples: one session a week, strided anchors, screened features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalar import iso_week_key, week_start


def _uniform_bytes(text: Column, n: Column) -> Column:
    """Unbiased index below n (n <= 256) from a SHA-256 byte stream: the first byte under the largest multiple of n."""
    hexes = F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit(":1")), 256))
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    limit = 256 - 256 % n
    return F.element_at(F.filter(bytes_, lambda b: b < limit), 1) % n


def _mod64(text: Column, n: Column) -> Column:
    """First 8 digest bytes, big-endian, modulo n."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def weekly_sample(sessions: DataFrame, seed: int, kind: str = "uniform", by: str = "symbol", t: str = "trade_date") -> DataFrame:
    """One reproducible real session per key and ISO week (a week has at most 7 sessions)."""
    weeks = sessions.groupBy(by, week_start(t).alias("week")).agg(F.array_sort(F.collect_set(t)).alias("_days"))
    text = F.concat(F.lit(f"{seed}:"), F.col(by), F.lit(":"), iso_week_key("week"))
    n = F.size("_days")
    index = _uniform_bytes(text, n) if kind == "uniform" else _mod64(text, n)
    return weeks.select(by, iso_week_key("week").alias("week_key"), F.element_at("_days", index + 1).alias(t), n.alias("candidates"))


def strided_sample(df: DataFrame, n: int, recent: int = 52, by: Sequence[str] = ("symbol",), t: str = "trade_date") -> DataFrame:
    """The ``recent`` newest anchors and evenly spaced older ones, n per key in all."""
    w = Window.partitionBy(*by)
    work = df.withColumn("_rn", F.row_number().over(w.orderBy(t)) - 1).withColumn("_n", F.count("*").over(w))
    older = F.col("_n") - recent
    room = n - recent
    step = F.greatest(F.lit(1.0), older / F.lit(float(max(room, 1))))
    slot = F.ceil(F.col("_rn") / step)
    hit = (F.floor(slot * step) == F.col("_rn")) & (slot < room)
    keep = (F.col("_n") <= n) | (F.col("_rn") >= older) | hit
    return work.where(keep).drop("_rn", "_n")


def top_features(long: DataFrame, k: int, by: Sequence[str], feature: str = "feature", x: str = "x", y: str = "y") -> DataFrame:
    """Features by |sum(x*y)|; one partial aggregate per (group, feature) before ranking."""
    score = long.groupBy(*by, feature).agg(F.abs(F.sum(F.col(x) * F.col(y))).alias("score"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), feature)
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
