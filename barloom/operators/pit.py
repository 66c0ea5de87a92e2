"""Point-in-time reads and alignment of series on two time axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalar import change, local_close_utc
from barloom.operators.panel import asof_join, before, ordered, running

ACCEPTED = ("accepted", "accepted_with_warnings")


def as_of_vintage(
    obs: DataFrame,
    cutoffs: Sequence[str],
    by: Sequence[str] = ("series", "effective_date"),
    tie: Sequence[str] = ("available_at", "vintage"),
    quality: str | None = "quality",
) -> DataFrame:
    """Last accepted revision of each (series, effective date) known at each cutoff.

    The cutoffs are a short list of literals; a revision is fanned out to the
    cutoffs it precedes and combined map-side at once, so nothing but the winning
    revision per (key, cutoff) is shuffled, however many revisions a key has.
    """
    rows = obs.where(F.col(quality).isin(*ACCEPTED)) if quality else obs
    marks = F.array(*[F.lit(c).cast("timestamp") for c in cutoffs])
    rows = rows.withColumn("cutoff", F.explode(F.filter(marks, lambda m: F.col("available_at") <= m)))
    rest = [c for c in obs.columns if c not in by]
    packed = rows.groupBy(*by, "cutoff").agg(F.max_by(F.struct(*rest), F.struct(*tie)).alias("_row"))
    return packed.select(*by, "cutoff", "_row.*")


def bars_as_of(revisions: DataFrame, cutoffs: Sequence[str], tie: Sequence[str], quality: str | None = None) -> DataFrame:
    return as_of_vintage(revisions, cutoffs, ("symbol", "trade_date"), tie, quality)


def align_benchmark(
    target: DataFrame, bench: DataFrame, cols: Sequence[str], close=("15:05", "Asia/Shanghai"), available=("16:05", "America/New_York")
) -> DataFrame:
    """For each target session the last benchmark bar already published at the target's close, in UTC."""
    left = target.withColumn("_at", local_close_utc("trade_date", *close)).withColumn("_one", F.lit(1))
    right = bench.select(
        F.lit(1).alias("_one"), local_close_utc("trade_date", *available).alias("_pub"), F.col("trade_date").alias("bench_date"), *cols
    )
    return asof_join(left, right, ["_one"], "_at", "_pub", ["bench_date", *cols]).drop("_one", "_at", "matched__pub")


def align_outer_ffill(a: DataFrame, b: DataFrame, by: Sequence[str], t: str, cols: Sequence[str]) -> DataFrame:
    """Both snapshot series on the union of their dates, carried forward, with differences.

    Inputs have one row per key and date, so a key's window is bounded by the calendar.
    """
    left = a.select(*by, t, *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(*by, t, *[F.col(c).alias(f"b_{c}") for c in cols])
    w = running(by, t)
    both = left.join(right, [*by, t], "full")
    both = both.withColumns({f"{s}_{c}": F.last(f"{s}_{c}", ignorenulls=True).over(w) for s in "ab" for c in cols})
    return both.withColumns({f"diff_{c}": F.col(f"a_{c}") - F.col(f"b_{c}") for c in cols})


def lead_join(df: DataFrame, c: str, ks: Sequence[int], by: Sequence[str], t: str) -> DataFrame:
    """Forward label: return to the row k steps ahead, without a self join."""
    w = ordered(by, t)
    return df.withColumns({f"{c}_fwd_{k}": change(F.lead(c, k).over(w), F.col(c)) for k in ks})


def overlap_weights(labels: DataFrame, by: Sequence[str], start: str = "anchor", end: str = "label_end") -> DataFrame:
    """1 / number of labels of the key whose open interval overlaps this one (itself included).

    Concurrent = starts before my end minus ends at or before my start. Starts and
    ends are counted per date first and accumulated over the dates of a key, so no
    pair of labels is ever formed.
    """
    marks = labels.select(*by, F.col(start).alias("_d"), F.lit(1).alias("_s"), F.lit(0).alias("_e")).unionByName(
        labels.select(*by, F.col(end).alias("_d"), F.lit(0).alias("_s"), F.lit(1).alias("_e"))
    )
    days = marks.groupBy(*by, "_d").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    w = Window.partitionBy(*by).orderBy("_d")
    cum = days.select(
        *by, "_d",
        F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_started_before"),
        F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_ended_by"),
    )
    out = labels.join(cum.select(*by, F.col("_d").alias(end), "_started_before"), [*by, end]).join(
        cum.select(*by, F.col("_d").alias(start), "_ended_by"), [*by, start]
    )
    return out.withColumn("concurrent", F.col("_started_before") - F.col("_ended_by")).withColumn(
        "weight", 1.0 / F.col("concurrent")
    ).drop("_started_before", "_ended_by")


def pair_models(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    left = a.select(*keys, *[F.col(c).alias(f"champion_{c}") for c in cols])
    return left.join(b.select(*keys, *[F.col(c).alias(f"candidate_{c}") for c in cols]), list(keys))


def session_ordinals(calendar: DataFrame, by: Sequence[str] = (), t: str = "session_date") -> DataFrame:
    """Number the sessions of each calendar (about 250 a year; a date dimension)."""
    keys = list(by) or ["_all"]
    src = calendar if by else calendar.withColumn("_all", F.lit(1))
    out = src.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(t)))
    return out if by else out.drop("_all")


def session_distance(df: DataFrame, calendar: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Sessions between two session dates; NULL when one is not a session."""
    o = session_ordinals(calendar, by)
    out = df.join(o.select(*by, F.col("session_date").alias(start), F.col("ordinal").alias("_o1")), [*by, start], "left")
    out = out.join(o.select(*by, F.col("session_date").alias(end), F.col("ordinal").alias("_o2")), [*by, end], "left")
    return out.withColumn("session_distance", F.col("_o2") - F.col("_o1")).drop("_o1", "_o2")


def only_missing(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def drop_stale(stored: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(current.select(*keys).distinct(), list(keys), "left_semi")


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    only_a = a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("only_first"))
    only_b = b.select(*keys).distinct().join(a.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("only_second"))
    return only_a.unionByName(only_b)


# ---- observation features -------------------------------------------------------

def obs_changes(obs: DataFrame, spans: Sequence[int], value: str = "value", by: Sequence[str] = ("series",), t: str = "effective_date") -> DataFrame:
    """Change over k weeks (last observation at least k weeks older) and acceleration.

    ``obs`` holds one vintage per (series, date); see :func:`as_of_vintage`.
    """
    days = F.date_diff(F.col(t), F.lit("1970-01-01").cast("date"))
    base = obs.withColumn("_day", days)
    w = Window.partitionBy(*by).orderBy("_day")
    for k in spans:
        old = F.last(value).over(w.rangeBetween(Window.unboundedPreceding, -7 * k))
        base = base.withColumn(f"change_{k}", change(F.col(value), old))
    o = ordered(by, t)
    base = base.withColumn("_c1", change(F.col(value), F.lag(value).over(o)))
    return base.withColumn("acceleration", F.col("_c1") - F.lag("_c1").over(o)).drop("_day", "_c1")


def earlier_counts(df: DataFrame, c: str, by: Sequence[str] = ("symbol",), t: str = "trade_date") -> DataFrame:
    """(by, t, seen, below, upto): rows up to each one, and how many of them are below it and not above it, itself included.

    Rows without a value are left out. The rows before number o are, for every bit that is set in o, the block of that
    size which ends where o's own block of that size begins; so each row asks one block a bit, all blocks of all sizes
    are counted by one ordered window each, and the counts are added. n log n rows, and no list of values anywhere.
    """
    keys = list(by)
    rows = df.select(*keys, t, F.col(c).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    rows = rows.withColumns({"_o": (F.row_number().over(ordered(keys, t)) - 1).cast("long"), "_n": F.count("*").over(Window.partitionBy(*keys))})
    levels = F.floor(F.log2(F.greatest(F.col("_n") - 1, F.lit(1)).cast("double"))).cast("int")
    each = rows.withColumn("_l", F.explode(F.sequence(F.lit(0), levels)))
    each = each.withColumns({"_asks": F.expr("shiftright(_o, _l) & 1 = 1"), "_block": F.expr("shiftright(_o, _l + 1)")})
    w = Window.partitionBy(*keys, "_l", "_block")
    told = (~F.col("_asks")).cast("long")
    each = each.withColumns({"_upto": F.sum(told).over(w.orderBy("_v", "_asks").rowsBetween(Window.unboundedPreceding, 0)), "_below": F.sum(told).over(w.orderBy("_v", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0))})
    asked = lambda x: F.sum(F.when(F.col("_asks"), F.col(x)).otherwise(0))
    return each.groupBy(*keys, t).agg((F.max("_o") + 1).alias("seen"), asked("_below").alias("below"), (asked("_upto") + 1).alias("upto"))


def expanding_percentile(df: DataFrame, c: str, kind: str = "le", by: Sequence[str] = ("symbol",), t: str = "trade_date", scale: float = 100.0, min_obs: int = 1) -> DataFrame:
    """Rank of each value among the values up to its date, without look-ahead.

    ``le``: share <= value. ``mid``: share below plus half of the equal ones. One row per key and date.
    """
    counts = earlier_counts(df, c, by, t)
    rank = F.col("upto") if kind == "le" else F.col("below") + 0.5 * (F.col("upto") - F.col("below"))
    ranked = counts.select(*by, t, F.when(F.col("seen") >= min_obs, scale * rank / F.col("seen")).alias(f"{c}_percentile"))
    return df.join(ranked, [*by, t], "left")


def percentile_full(df: DataFrame, c: str, by: Sequence[str] = ("symbol",), scale: float = 100.0) -> DataFrame:
    """Share of the whole history <= value. Looks ahead; kept for compatible output only."""
    return df.withColumn(f"{c}_percentile_full", scale * F.cume_dist().over(Window.partitionBy(*by).orderBy(c)))


def trailing_percentile(c: str, n: int, by: Sequence[str] = ("symbol",), t: str = "trade_date") -> Column:
    frame = F.collect_list(F.col(c)).over(ordered(by, t).rowsBetween(-(n - 1), 0))
    last = F.element_at(frame, -1)
    return F.size(F.filter(frame, lambda v: v <= last)) / F.size(frame)


def tracking_error(df: DataFrame, a: str, b: str, n: int, periods: int = 252, by: Sequence[str] = ("symbol",), t: str = "trade_date") -> DataFrame:
    """Annualised population deviation of the last n return differences of two aligned price columns."""
    import math

    w = ordered(by, t)
    gap = change(F.col(a), F.lag(a).over(w)) - change(F.col(b), F.lag(b).over(w))
    f = w.rowsBetween(-(n - 1), 0)
    out = df.withColumn("_gap", gap)
    return out.withColumn(f"tracking_error_{n}", F.when(F.count("_gap").over(f) == n, F.stddev_pop("_gap").over(f) * math.sqrt(periods))).drop("_gap")
