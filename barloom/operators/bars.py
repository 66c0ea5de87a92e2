"""Bars: ticks to sessions, sessions to weeks and months, calendar and quality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalar import period_start
from barloom.operators.panel import BY, ordered
from barloom.operators.prices import ohlc_valid

ISSUE_COLUMNS = ("symbol", "code", "severity", "start_date", "end_date", "n")


def ticks_to_bars(ticks: DataFrame, order: Sequence[str], by: Sequence[str] = BY, ts: str = "ts") -> DataFrame:
    """Session bars from trades. Partial aggregates only: a hot symbol is combined map-side."""
    key = F.struct(*order)
    return ticks.groupBy(*by, F.col(ts).cast("date").alias("trade_date")).agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("volume").alias("volume"),
    )


def _total(c: str, mode: str) -> Column:
    if mode == "present":
        return F.sum(c)
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def resample_bars(df: DataFrame, unit: str, volume: str = "strict", by: Sequence[str] = BY) -> DataFrame:
    """Week or month bars: first open, extreme high/low, last close, summed volume.

    ``volume="strict"`` makes a period sum NULL when one session lacks it,
    ``"present"`` adds what there is. Optional columns are carried when present.
    """
    optional = []
    if "adjusted_close" in df.columns:
        optional.append(F.max_by("adjusted_close", "trade_date").alias("adjusted_close"))
    if "turnover" in df.columns:
        optional.append(_total("turnover", volume).alias("turnover"))
    if "source" in df.columns:
        optional.append(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("price_source"))
    return df.groupBy(*by, period_start("trade_date", unit).alias("period")).agg(
        F.min("trade_date").alias("period_start"),
        F.max("trade_date").alias("trade_date"),
        F.min_by("open", "trade_date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"),
        _total("volume", volume).alias("volume"),
        F.count("*").alias("sessions"),
        *optional,
    )


def provisional_period(daily: DataFrame, completed: DataFrame, unit: str, by: Sequence[str] = BY) -> DataFrame:
    """Completed periods plus the newest open period built from the daily bars after them."""
    done = completed.groupBy(*by).agg(F.max("period").alias("_last"))
    fresh = (
        daily.join(done, list(by), "left")
        .where(F.col("_last").isNull() | (period_start("trade_date", unit) > F.col("_last")))
        .drop("_last")
    )
    overlay = resample_bars(fresh, unit, volume="present", by=by)
    newest = overlay.groupBy(*by).agg(F.max("period").alias("_newest"))
    overlay = overlay.join(newest, list(by)).where(F.col("period") == F.col("_newest")).drop("_newest")
    return completed.withColumn("is_complete", F.lit(True)).unionByName(
        overlay.withColumn("is_complete", F.lit(False)).select(*completed.columns, "is_complete")
    )


def calendar_by_key(bars: DataFrame, calendar: DataFrame, by: Sequence[str] = BY, unit: str | None = None) -> DataFrame:
    """Expected sessions of each key between its first and last bar, or its first and last whole period.

    The calendar is a date dimension (about 250 rows a year), the key spans are
    one row per key; the interval condition keeps the result to real sessions.
    """
    spans = bars.groupBy(*by).agg(F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"))
    if unit is not None:
        last = F.last_day("_hi") if unit == "month" else F.date_add(period_start("_hi", "week"), 6)
        spans = spans.select(*by, period_start("_lo", unit).alias("_lo"), last.alias("_hi"))
    if set(by) <= set(calendar.columns):
        return spans.join(calendar, list(by)).where(F.col("session_date").between(F.col("_lo"), F.col("_hi"))).select(*by, "session_date")
    # A calendar shared by all keys: an equi-join on the month, then the exact bounds.
    months = F.explode(F.sequence(F.trunc("_lo", "month"), F.trunc("_hi", "month"), F.expr("interval 1 month")))
    return (
        spans.withColumn("_month", months)
        .join(calendar.select("session_date", F.trunc("session_date", "month").alias("_month")), "_month")
        .where(F.col("session_date").between(F.col("_lo"), F.col("_hi")))
        .select(*by, "session_date")
    )


def calendar_gaps(bars: DataFrame, calendar: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Sessions without a bar (missing) and bars off the calendar (unexpected)."""
    expected = calendar_by_key(bars, calendar, by)
    actual = bars.select(*by, F.col("trade_date").alias("session_date"))
    missing = expected.join(actual, [*by, "session_date"], "left_anti").withColumn("gap", F.lit("missing"))
    extra = actual.join(expected, [*by, "session_date"], "left_anti").withColumn("gap", F.lit("unexpected"))
    return missing.unionByName(extra)


def period_status(bars: DataFrame, calendar: DataFrame, unit: str, as_of, by: Sequence[str] = BY) -> DataFrame:
    """complete / incomplete / deferred per period, from expected and actual sessions.

    A period is deferred when it contains ``as_of`` and only lacks sessions after it.
    """
    cutoff = F.lit(as_of).cast("date")
    expected = calendar_by_key(bars, calendar, by, unit).withColumn("_expected", F.lit(1))
    actual = bars.select(*by, F.col("trade_date").alias("session_date")).withColumn("_actual", F.lit(1))
    both = expected.join(actual, [*by, "session_date"], "full")
    missing = F.col("_actual").isNull()
    out = both.groupBy(*by, period_start("session_date", unit).alias("period")).agg(
        F.count("_expected").alias("expected"),
        F.count("_actual").alias("actual"),
        F.count_if(missing & (F.col("session_date") <= cutoff)).alias("missing_past"),
        F.count_if(missing & (F.col("session_date") > cutoff)).alias("missing_future"),
        F.count_if(F.col("_expected").isNull()).alias("unexpected"),
    )
    current = F.col("period") == period_start(cutoff, unit)
    return out.withColumn(
        "status",
        F.when((F.col("missing_past") > 0) | (F.col("unexpected") > 0), "incomplete")
        .when((F.col("missing_future") > 0) & current, "deferred")
        .when(F.col("missing_future") > 0, "incomplete")
        .otherwise("complete"),
    )


# ---- issues -----------------------------------------------------------------

def _issue(df: DataFrame, cond: Column, code: str, severity: str, start: str, end: str, by: Sequence[str]) -> DataFrame:
    return df.where(cond).groupBy(*by).agg(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        F.min(start).alias("start_date"),
        F.max(end).alias("end_date"),
        F.count("*").alias("n"),
    )


def _tag(rows: DataFrame, checks: Sequence[tuple[Column, str, str]], start: str, end: str, by: Sequence[str]) -> DataFrame:
    """All checks in one pass: explode the failed codes of a row, then count per (key, code)."""
    failed = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for cond, code, sev in checks]),
        lambda x: x.isNotNull(),
    )
    return (
        rows.select(*by, start, end, F.explode(failed).alias("_i")) if start != end
        else rows.select(*by, start, F.explode(failed).alias("_i"))
    ).groupBy(*by, F.col("_i.code").alias("code"), F.col("_i.severity").alias("severity")).agg(
        F.min(start).alias("start_date"), F.max(end).alias("end_date"), F.count("*").alias("n")
    )


def date_issues(bars: DataFrame, ingest_order: str | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Duplicate dates, and dates that do not increase in ingest order."""
    dup = bars.groupBy(*by, "trade_date").agg(F.count("*").alias("_c"))
    out = _issue(dup, F.col("_c") > 1, "DUPLICATE_DAILY_DATE", "blocking", "trade_date", "trade_date", by)
    if ingest_order is None:
        return out
    # The previous row in ingest order: bars of a key are one per session plus duplicates.
    w = Window.partitionBy(*by).orderBy(ingest_order)
    seq = bars.withColumn("_prev", F.lag("trade_date").over(w))
    return out.unionByName(
        _issue(seq, F.col("trade_date") <= F.col("_prev"), "NON_MONOTONIC_DAILY_DATE", "blocking", "trade_date", "trade_date", by)
    )


def daily_issues(bars: DataFrame, as_of=None, markers: Sequence[str] = (), by: Sequence[str] = BY) -> DataFrame:
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad_value = F.lit(False)
    for p in prices:
        bad_value = bad_value | F.coalesce(~(p > 0) | F.isnan(p) | (p == float("inf")), F.lit(True))
    checks = [
        (bad_value, "INVALID_DAILY_OHLC", "blocking"),
        (~bad_value & ~ohlc_valid(), "INVALID_DAILY_OHLC_RELATION", "blocking"),
        (F.col("volume").isNull() | (F.col("volume") < 0), "INCOMPLETE_DAILY_VOLUME", "blocking"),
        (F.col("volume") == 0, "ZERO_DAILY_VOLUME", "warning"),
    ]
    if as_of is not None:
        checks.append((F.col("trade_date") > F.lit(as_of).cast("date"), "DAILY_AFTER_AS_OF", "blocking"))
    if markers and "source" in bars.columns:
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.upper(F.coalesce("source", F.lit(""))).contains(m.upper())
        checks.append((hit, "PROHIBITED_SOURCE", "blocking"))
    return _tag(bars, checks, "trade_date", "trade_date", by)


def validate_periods(periods: DataFrame, unit: str, by: Sequence[str] = BY) -> DataFrame:
    """Issues of a period series: duplicates, boundaries, OHLC, provenance, volume gaps.

    A missing volume between two present ones is internal, else an edge gap.
    """
    w = Window.partitionBy(*by)
    pos = periods.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy("period_start", "trade_date")))
    pos = pos.withColumns(
        {
            "_first": F.min(F.when(F.col("volume").isNotNull(), F.col("_pos"))).over(w),
            "_last": F.max(F.when(F.col("volume").isNotNull(), F.col("_pos"))).over(w),
            "_same": F.count("*").over(Window.partitionBy(*by, period_start("trade_date", unit))),
        }
    )
    internal = F.coalesce((F.col("_first") < F.col("_pos")) & (F.col("_pos") < F.col("_last")), F.lit(False))
    no_volume = F.col("volume").isNull()
    boundary = (F.col("period_start") > F.col("trade_date")) | (
        period_start("period_start", unit) != period_start("trade_date", unit)
    )
    checks = [
        (F.col("_same") > 1, "DUPLICATE_PERIOD", "blocking"),
        (boundary, "INVALID_PERIOD_BOUNDARY", "blocking"),
        (~ohlc_valid(), "INVALID_PERIOD_OHLC", "blocking"),
        (F.col("volume") < 0, "INVALID_PERIOD_VOLUME", "blocking"),
        (no_volume & internal, "INTERNAL_PERIOD_VOLUME_GAP", "blocking"),
        (no_volume & ~internal, "MISSING_PERIOD_VOLUME", "blocking"),
    ]
    if "price_source" in periods.columns:
        checks.append((F.coalesce(F.col("price_source"), F.lit("")) == "", "MISSING_PERIOD_SOURCE", "blocking"))
    return _tag(pos, checks, "period_start", "trade_date", by)


def quality_report(keys: DataFrame, issues: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row per key: publishable unless a blocking issue exists."""
    agg = issues.dropDuplicates().groupBy(*by).agg(
        F.bool_and(F.col("severity") != "blocking").alias("publishable"),
        F.count("*").alias("issues"),
        F.count_if(F.col("severity") == "blocking").alias("blocking"),
    )
    return keys.select(*by).distinct().join(agg, list(by), "left").select(
        *by,
        F.coalesce("publishable", F.lit(True)).alias("publishable"),
        F.coalesce("issues", F.lit(0)).alias("issues"),
        F.coalesce("blocking", F.lit(0)).alias("blocking"),
    )


def publish_periods(daily: DataFrame, calendar: DataFrame, unit: str, as_of, by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Gate: period bars of publishable keys without deferred periods, and the report."""
    status = period_status(daily, calendar, unit, as_of, by)
    status_issues = status.where("status = 'incomplete'").groupBy(*by).agg(
        F.lit("MISSING_EXPECTED_TRADE_DATE").alias("code"),
        F.lit("blocking").alias("severity"),
        F.min("period").alias("start_date"),
        F.max("period").alias("end_date"),
        F.count("*").alias("n"),
    )
    issues = daily_issues(daily, as_of, by=by).unionByName(status_issues)
    report = quality_report(daily, issues, by)
    deferred = status.where("status = 'deferred'").select(*by, "period")
    bars = (
        resample_bars(daily, unit, by=by)
        .join(deferred, [*by, "period"], "left_anti")
        .join(report.where("publishable").select(*by), list(by), "left_semi")
    )
    return bars, report


def overlay_volume(base: DataFrame, upstream: DataFrame, low: float = 0.8, high: float = 1.2, by: Sequence[str] = BY) -> DataFrame:
    """Take upstream period volumes for a key only if all of them line up, else keep the own ones.

    All of: every period end covered exactly once, positive values, and a ratio
    to the own volume inside [low, high]. ``verdict`` names the first failed check.
    """
    up = upstream.groupBy(*by, "trade_date").agg(F.count("*").alias("_copies"), F.max("volume").alias("_up"))
    own = base.select(*by, "trade_date", F.col("volume").alias("_own"))
    both = own.join(up, [*by, "trade_date"], "full")
    ratio = F.when(F.col("_own") > 0, F.col("_up") / F.col("_own"))
    verdict = both.groupBy(*by).agg(
        F.count("_copies").alias("_n_up"),
        F.count_if(F.col("_up").isNull() | F.col("_own").isNull()).alias("_unpaired"),
        F.coalesce(F.max("_copies"), F.lit(0)).alias("_dups"),
        F.count_if(F.col("_up") <= 0).alias("_bad"),
        F.count_if(ratio.isNull()).alias("_no_scale"),
        F.count_if((ratio < low) | (ratio > high)).alias("_off"),
    ).select(
        *by,
        F.when(F.col("_n_up") == 0, "EMPTY")
        .when(F.col("_bad") > 0, "INVALID_VALUE")
        .when(F.col("_dups") > 1, "DUPLICATE_PERIOD")
        .when(F.col("_unpaired") > 0, "COVERAGE_MISMATCH")
        .when(F.col("_no_scale") > 0, "NO_SCALE_REFERENCE")
        .when(F.col("_off") > 0, "INCONSISTENT_SCALE")
        .otherwise("APPLIED")
        .alias("verdict"),
    )
    return (
        base.join(up.select(*by, "trade_date", "_up"), [*by, "trade_date"], "left")
        .join(verdict, list(by))
        .withColumn("volume", F.when(F.col("verdict") == "APPLIED", F.col("_up")).otherwise(F.col("volume")))
        .drop("_up")
    )


def weekly_gap_issues(weekly: DataFrame, calendar: DataFrame, short_sessions: int = 2, by: Sequence[str] = BY) -> DataFrame:
    """Weekly series against the calendar: missing weeks, short holiday weeks, endpoints, doubled weeks."""
    spans = weekly.groupBy(*by).agg(F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"))
    weeks = calendar.groupBy(period_start("session_date", "week").alias("period")).agg(
        F.count("*").alias("expected"), F.max("session_date").alias("last_session")
    )
    own_weeks = F.explode(F.sequence(period_start("_lo", "week"), period_start("_hi", "week"), F.expr("interval 7 days")))
    expected = spans.select(*by, own_weeks.alias("period")).join(weeks, "period")
    own = weekly.groupBy(*by, period_start("trade_date", "week").alias("period")).agg(
        F.count("*").alias("ends"), F.max("trade_date").alias("period_end")
    )
    issue = (
        F.when(F.col("ends") > 1, "MULTIPLE_ENDS")
        .when(F.col("ends").isNull() & (F.col("expected") <= short_sessions), "SHORT_HOLIDAY_WEEK")
        .when(F.col("ends").isNull(), "MISSING_WEEK")
        .when(F.col("period_end") != F.col("last_session"), "ENDPOINT_MISMATCH")
    )
    return expected.join(own, [*by, "period"], "left").withColumn("issue", issue).where(F.col("issue").isNotNull())


def rebuild_from(changed: Column) -> Column:
    """First day to rebuild after a change: month start of the day or of its ISO-week Monday, whichever is earlier."""
    return F.least(F.trunc(changed, "month"), F.trunc(F.date_trunc("week", changed), "month"))


def bar_context(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Number the bars of each key; the ordinal many label and window operators share."""
    return df.withColumn("ordinal", F.row_number().over(ordered(by)))
