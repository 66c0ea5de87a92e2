"""Summaries for people: cards, contexts, funnels, market reports, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalar import change
from barloom.operators.indicators import sma
from barloom.operators.panel import BY, last_n, ordered


def candidate_summary(df: DataFrame, by: str, reasons: str, identical: str) -> tuple[DataFrame, DataFrame]:
    """(counts per market with a total row, counts per rejection reason)."""
    totals = df.rollup(by).agg(F.count("*").alias("candidates"), F.count_if(F.col(identical)).alias("identical"), F.count_if(F.size(reasons) == 0).alias("accepted"))
    per_reason = df.select(by, F.explode(reasons).alias("reason")).groupBy(by, "reason").agg(F.count("*").alias("n"))
    return totals.withColumn(by, F.coalesce(by, F.lit("ALL"))), per_reason


def decision_funnel(df: DataFrame, by: Sequence[str], stages: dict[str, Column], order: str, recent: int = 52) -> DataFrame:
    """How many rows pass each stage, over all rows and over the latest ``recent`` ones."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    r = df.withColumn("_recent", F.row_number().over(w) <= recent)
    aggs = [F.count("*").alias("rows"), F.count_if("_recent").alias("recent_rows")]
    for name, cond in stages.items():
        aggs += [F.count_if(cond).alias(name), F.count_if(cond & F.col("_recent")).alias(f"recent_{name}")]
    out = r.groupBy(*by).agg(*aggs)
    return out.withColumns({f"recent_{n}_ratio": F.col(f"recent_{n}") / F.col("recent_rows") for n in stages})


def market_report(df: DataFrame, by: Sequence[str], value: str, t: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.count_if(F.col(value) > 0).alias("positive"), F.min(t).alias("first_date"), F.max(t).alias("last_date"),
    )


def latest_card(df: DataFrame, c: str = "close", by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Latest value, the one before it and the change; two rows per key are enough."""
    two = last_n(df.select(*by, t, c), 2, by, t)
    g = two.groupBy(*by).agg(F.max(t).alias(t), F.max_by(c, t).alias("latest"), F.min_by(c, t).alias("_first"), F.count("*").alias("_n"))
    prev = F.when(F.col("_n") == 2, F.col("_first"))
    return g.select(*by, t, "latest", prev.alias("previous"), (F.col("latest") - prev).alias("change"), change(F.col("latest"), prev).alias("change_ratio"))


def market_context(daily: DataFrame, weekly: DataFrame, by: Sequence[str] = BY, t: str = "trade_date", n: int = 10) -> DataFrame:
    """One row per key: last n closes, short returns on both timeframes, mean distances."""
    def side(df: DataFrame, spans: Sequence[int], means: Sequence[int], p: str) -> DataFrame:
        w = ordered(by, t)
        cols = {f"{p}_ret_{k}": change(F.col("close"), F.lag("close", k).over(w)) for k in spans}
        cols |= {f"{p}_ma{m}_distance": change(F.col("close"), sma("close", m, partial=False, by=by, t=t)) for m in means}
        cols[f"{p}_closes"] = F.collect_list("close").over(w.rowsBetween(-(n - 1), 0))
        return last_n(df.select(*by, t, "close").withColumns(cols), 1, by, t).drop("close", t)

    return side(daily, (1, 3, 5), (5, 20), "d").join(side(weekly, (1, 4, 8), (5, 20), "w"), list(by))


def indicator_staleness(bars: DataFrame, indicators: DataFrame, required: Sequence[str], by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Bars without an indicator row, indicator rows without a bar, and whether the latest row is complete."""
    a = bars.select(*by, t).withColumn("_bar", F.lit(1))
    i = indicators.select(*by, t, *required).withColumn("_ind", F.lit(1))
    both = a.join(i, [*by, t], "full")
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return both.groupBy(*by).agg(
        F.count_if(F.col("_ind").isNull()).alias("missing"), F.count_if(F.col("_bar").isNull()).alias("orphan"),
        F.max(F.when(F.col("_ind").isNotNull(), F.col(t))).alias("indicator_through"), F.max(F.when(F.col("_bar").isNotNull(), F.col(t))).alias("bars_through"),
        F.max_by(complete, t).alias("latest_complete"),
    ).withColumn("stale", (F.col("missing") > 0) | (F.col("orphan") > 0) | ~F.coalesce("latest_complete", F.lit(False)))


def binding_stats(df: DataFrame, by: Sequence[str], order: str, last: int = 12) -> DataFrame:
    """In the latest windows: how often the state cap bound, by confirmation, and how first batches were sized.

    df: by, order, confirmation, state_cap, base_target, final_target, batches (array).
    """
    recent = last_n(df, last, by, order)
    binds = (F.col("final_target") == F.col("state_cap")) & (F.col("state_cap") < F.col("base_target"))
    first = F.try_element_at("batches", F.lit(1))
    return recent.groupBy(*by, "confirmation").agg(
        F.count("*").alias("n"), F.count_if(binds).alias("cap_binds"), F.count_if(first.isin(5, 10, 15)).alias("probe_first"), F.count_if(F.exists("batches", lambda b: b >= 15)).alias("large_batches")
    )


def activity_health(evaluations: DataFrame, exposures: DataFrame, by: Sequence[str], as_of: str, threshold: float = 0.05, weeks: int = 26, minimum: int = 3, low: float = 10.0) -> DataFrame:
    """Exposure during strongly rising windows of the look-back; degraded when there were enough and it was low.

    evaluations: by, window_end, actual_return. exposures: by, window_end, average_position.
    """
    cut = F.lit(as_of).cast("date")
    strong = evaluations.where((F.col("window_end") <= cut) & (F.col("window_end") >= F.date_sub(cut, 7 * weeks)) & (F.col("actual_return") >= threshold))
    j = strong.join(exposures, [*by, "window_end"], "left")
    g = j.groupBy(*by).agg(F.count("*").alias("strong_windows"), F.coalesce(F.avg("average_position"), F.lit(0.0)).alias("exposure"))
    return g.withColumn("degraded", (F.col("strong_windows") >= minimum) & (F.col("exposure") < low))


def state_audit(df: DataFrame, by: Sequence[str], state: str, t: str) -> DataFrame:
    return df.groupBy(*by, state).agg(F.count("*").alias("rows"), F.min(t).alias("first_date"), F.max(t).alias("last_date"), F.countDistinct(t).alias("dates"))


def review_context(forecasts: DataFrame, funnel: DataFrame, cutoff: str, by: Sequence[str], t: str, n_forecasts: int = 16, n_funnel: int = 26) -> DataFrame:
    """Latest forecasts and decisions up to a cutoff as two ordered arrays per market."""
    def recent(df: DataFrame, n: int, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in by]
        rows = last_n(df.where(F.col(t) <= F.lit(cutoff).cast("date")), n, by, t)
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(t, *[c for c in rest if c != t]))).alias(name))

    return recent(forecasts, n_forecasts, "forecasts").join(recent(funnel, n_funnel, "decisions"), list(by), "full")
