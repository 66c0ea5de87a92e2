"""Forward labels, maturity, forecast evaluation and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import arrays as A
from barloom.functions.scalar import as_col, week_start
from barloom.operators.panel import BY, ordered


# ---- labels ---------------------------------------------------------------------

def label_path(df: DataFrame, horizon: int, c: str = "close", by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Array of the cumulative returns of the next ``horizon`` rows, NULL while it is not complete; label end date."""
    w = ordered(by, t)
    ahead = w.rowsBetween(1, horizon)
    values = F.collect_list(F.col(c)).over(ahead)
    path = F.when(F.count(c).over(ahead) == horizon, F.transform(values, lambda v: v / F.col(c) - 1))
    return df.withColumns({"_path": values, "label_end": F.lead(t, horizon).over(w)}).withColumn("path", path).drop("_path")


def explode_path(df: DataFrame, ids: Sequence[str], path: str = "path", step: str = "step", value: str = "ret") -> DataFrame:
    return df.select(*ids, F.posexplode(path).alias("_p", value)).withColumn(step, F.col("_p") + 1).drop("_p")


def maturity(realised: Column) -> Column:
    """Maturity by the number of realised weeks."""
    r = as_col(realised)
    return (
        F.when(r >= 13, "FULLY_MATURE_13W").when(r >= 8, "MATURE_8W").when(r >= 4, "MATURE_4W").when(r >= 1, "MATURE_1W").otherwise("IMMATURE")
    )


def realised_weeks(df: DataFrame, as_of: str, by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Weekly bars after each anchor that end by ``as_of``."""
    seen = df.where(F.col(t) <= F.lit(as_of).cast("date"))
    total = seen.groupBy(*by).agg(F.count("*").alias("_n"))
    out = seen.withColumn("_o", F.row_number().over(ordered(by, t))).join(total, list(by))
    return out.withColumn("realised", F.col("_n") - F.col("_o")).withColumn("maturity", maturity(F.col("realised"))).drop("_n", "_o")


def eligible_matured(labels: DataFrame, as_of: str, anchor: str = "trade_date") -> DataFrame:
    cutoff = F.lit(as_of).cast("date")
    return labels.where((F.col(anchor) < cutoff) & F.col("label_end").isNotNull() & (F.col("label_end") <= cutoff))


def week_coverage(bars: DataFrame, calendar: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per key and calendar week: is every session present. The calendar carries the key columns."""
    expected = calendar.select(*by, "session_date").distinct()
    have = bars.select(*by, F.col("trade_date").alias("session_date")).distinct().withColumn("_have", F.lit(1))
    both = expected.join(have, [*by, "session_date"], "left")
    return both.groupBy(*by, week_start("session_date").alias("week")).agg(
        (F.count("*") == F.count("_have")).alias("covered"), F.max("session_date").alias("last_session"), F.count("*").alias("sessions")
    )


def verified_weeks(anchors: DataFrame, coverage: DataFrame, as_of: str, by: Sequence[str] = BY, anchor: str = "trade_date") -> DataFrame:
    """Contiguous fully covered calendar weeks after each anchor's week, up to ``as_of``.

    Weeks are numbered per key and a week's distance to the next broken one is
    found by a window, so each anchor is answered by one equi-join on its week.
    """
    w = Window.partitionBy(*by).orderBy("week")
    good = F.col("covered") & (F.col("last_session") <= F.lit(as_of).cast("date"))
    c = coverage.withColumns({"_o": F.row_number().over(w), "_good": good})
    after = w.rowsBetween(1, Window.unboundedFollowing)
    c = c.withColumn("_bad", F.min(F.when(~F.col("_good"), F.col("_o"))).over(after)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    c = c.withColumn("verified", F.coalesce("_bad", F.col("_n") + 1) - F.col("_o") - 1)
    out = anchors.withColumn("week", week_start(anchor)).join(c.select(*by, "week", "verified"), [*by, "week"], "left")
    return out.withColumn("verified", F.coalesce("verified", F.lit(0))).drop("week")


def label_end(calendar: DataFrame, anchors: DataFrame, horizon: int, anchor: str = "trade_date") -> DataFrame:
    """Last session of the ``horizon``-th calendar week with sessions after the anchor's week; closed weeks are skipped."""
    weeks = calendar.groupBy(week_start("session_date").alias("week")).agg(F.max("session_date").alias("last_session"))
    o = weeks.withColumn("_one", F.lit(1)).withColumn("ordinal", F.row_number().over(Window.partitionBy("_one").orderBy("week"))).drop("_one")
    ends = o.select((F.col("ordinal") - horizon).alias("ordinal"), F.col("last_session").alias("label_end"))
    table = o.select("week", "ordinal").join(ends, "ordinal", "left").select("week", "label_end")
    return anchors.withColumn("week", week_start(anchor)).join(table, "week", "left").drop("week")


def label_turns(paths: DataFrame, by: Sequence[str], step: str = "step", value: str = "ret") -> DataFrame:
    """Realised high and low step, and the price turn the terminal direction makes relevant."""
    hi = F.min_by(step, F.struct(-F.col(value), F.col(step)))
    lo = F.min_by(step, F.struct(F.col(value), F.col(step)))
    g = paths.groupBy(*by).agg(hi.alias("high_step"), lo.alias("low_step"), F.max_by(value, step).alias("terminal"))
    up = F.col("terminal") >= 0
    return g.withColumns(
        {"price_turn_step": F.when(up, F.col("high_step")).otherwise(F.col("low_step")), "price_turn_kind": F.when(up, "top").otherwise("bottom")}
    )


def label_20d(df: DataFrame, by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """15th-day direction and the day of the best entry or exit inside the next 20 sessions."""
    w = ordered(by, t)
    ahead = w.rowsBetween(1, 20)
    values = F.collect_list("close").over(ahead)
    out = df.withColumns({"_v": values, "_n": F.count("close").over(ahead), "close_15": F.lead("close", 15).over(w)})
    first = lambda pick: F.array_position("_v", pick("_v"))
    ready = F.col("_n") == 20
    return out.withColumns(
        {
            "direction_15": F.when(ready, F.when(F.col("close_15") >= F.col("close"), 1).otherwise(-1)),
            "low_day": F.when(ready, first(F.array_min)),
            "high_day": F.when(ready, first(F.array_max)),
        }
    ).drop("_v", "_n", "close_15")


LABEL_WEIGHTS = {"turning_deviation": 0.45, "direction_calibration": 0.30, "adverse_excursion": 0.15, "overtrading": 0.10}


def label_losses(predictions: DataFrame, horizon: DataFrame, by: Sequence[str], max_trades: int = 10) -> DataFrame:
    """Loss components of weekly predictions against the daily closes of their horizon.

    predictions: by + baseline, predicted_direction (up/down/neutral), operation_side
    (buy/sell/hold), probability, predicted_step, trade_count, verified (weeks).
    horizon: by + step (1..n in sessions), week_no, close; only rows of the verified
    horizon (13, 4 or 1 weeks) count. Partial labels carry calibration only.
    """
    p = predictions.withColumns(
        {
            "status": F.when(F.col("verified") >= 13, "mature_13w").when(F.col("verified") >= 4, "mature_4w").when(F.col("verified") >= 1, "partial_1w").otherwise("pending"),
            "_weeks": F.when(F.col("verified") >= 13, 13).when(F.col("verified") >= 4, 4).when(F.col("verified") >= 1, 1).otherwise(0),
        }
    )
    rows = p.join(horizon, list(by)).where(F.col("week_no") <= F.col("_weeks"))
    g = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.max_by("close", "step").alias("_last"), F.min("close").alias("_lo"), F.max("close").alias("_hi"),
        F.min_by("step", F.struct("close", "step")).alias("_lo_step"), F.min_by("step", F.struct(-F.col("close"), F.col("step"))).alias("_hi_step"),
    )
    out = p.join(g, list(by), "left")
    base = F.col("baseline")
    actual = F.when(F.col("_last") > base, "up").when(F.col("_last") < base, "down").when(F.col("_last").isNotNull(), "neutral")
    hit = F.col("predicted_direction") == actual
    calibration = F.pow(F.col("probability") - hit.cast("double"), 2)
    turn = F.when(F.col("operation_side") == "sell", F.col("_hi_step")).when(F.col("operation_side") == "buy", F.col("_lo_step"))
    mature = F.col("status") == "mature_13w"
    deviation = F.when(mature, turn - F.col("predicted_step"))
    denom = F.greatest(F.col("_n") - 1, F.lit(1))
    turning = F.when(F.col("operation_side") == "hold", 0.0).otherwise(F.least(F.abs(deviation) / denom, F.lit(1.0)))
    fall, rise = (base - F.col("_lo")) / base, (F.col("_hi") - base) / base
    adverse = F.when(F.col("predicted_direction") == "up", fall).when(F.col("predicted_direction") == "down", rise).otherwise(F.greatest(fall, rise))
    adverse = F.least(F.greatest(adverse, F.lit(0.0)), F.lit(1.0))
    over = F.least(F.col("trade_count") / F.lit(float(max_trades)), F.lit(1.0))
    parts = {
        "turning_deviation": F.when(mature, turning),
        "direction_calibration": F.when(F.col("status") != "pending", calibration),
        "adverse_excursion": F.when(mature, adverse),
        "overtrading": F.when(mature, over),
    }
    out = out.withColumns({"actual_direction": actual, "direction_hit": hit, "deviation_sessions": deviation, **parts})
    total = sum((F.col(k) * v for k, v in LABEL_WEIGHTS.items()), F.lit(0.0))
    weight = F.when(mature, 1.0).when(F.col("status") == "mature_4w", 0.5).when(F.col("status") == "partial_1w", 0.25).otherwise(0.0)
    return out.withColumns({"total_loss": F.when(mature, total), "partial_weight": weight}).drop("_weeks", "_n", "_last", "_lo", "_hi", "_lo_step", "_hi_step")


def rolling_metrics(labels: DataFrame, cols: Sequence[str], order: str, by: Sequence[str] = BY) -> DataFrame:
    """Means over the latest mature labels: windows 20 and 52, or one expanding window below 20 labels."""
    w = Window.partitionBy(*by)
    r = labels.withColumns({"_rank": F.row_number().over(w.orderBy(F.col(order).desc())), "_n": F.count("*").over(w)})
    windows = F.filter(
        F.array(
            F.when(F.col("_n") < 20, "expanding"),
            F.when((F.col("_n") >= 20) & (F.col("_rank") <= 20), "20"),
            F.when((F.col("_n") >= 52) & (F.col("_rank") <= 52), "52"),
        ),
        lambda x: x.isNotNull(),
    )
    return r.withColumn("window", F.explode(windows)).groupBy(*by, "window").agg(
        F.count("*").alias("samples"), *[F.avg(F.col(c).cast("double")).alias(c) for c in cols]
    )


def deviation_curve(df: DataFrame, order: str, deviation: str = "deviation", by: Sequence[str] = BY) -> DataFrame:
    """Running mean of the last 20 and 52 known absolute deviations; rows without one repeat the last value."""
    known = df.where(F.col(deviation).isNotNull()).select(*by, order, F.abs(deviation).alias("_a"))
    w = Window.partitionBy(*by).orderBy(order)
    for n in (20, 52):
        f = w.rowsBetween(-(n - 1), 0)
        known = known.withColumn(f"rolling_{n}", F.when(F.count("_a").over(f) == n, F.avg("_a").over(f)))
    out = df.join(known.drop("_a"), [*by, order], "left")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({f"rolling_{n}": F.last(f"rolling_{n}", ignorenulls=True).over(upto) for n in (20, 52)})


def iteration_curve(df: DataFrame, order: str, loss: str, hit: str, by: Sequence[str] = BY, n: int = 20) -> DataFrame:
    """Rolling loss and accuracy by sequence, next to the best loss so far."""
    w = Window.partitionBy(*by).orderBy(order)
    f = w.rowsBetween(-(n - 1), 0)
    return df.withColumns(
        {
            "iteration": F.row_number().over(w),
            "rolling_loss": F.avg(loss).over(f),
            "rolling_accuracy": F.avg(F.col(hit).cast("double")).over(f),
            "best_loss": F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


# ---- scores (Column functions) ------------------------------------------------------

def direction_class(value, threshold) -> Column:
    v, t = as_col(value), threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(v > t, "UP").when(v < -t, "DOWN").when(v.isNotNull(), "SIDEWAYS")


def brier(p_up, p_side, p_down, actual, kind: str = "half") -> Column:
    """``half``: half the squared distance; ``third``: a third of it; ``binary``: up against the rest."""
    a = as_col(actual)
    hit = lambda name: F.when(a == name, 1.0).when(a.isNotNull(), 0.0)
    if kind == "binary":
        return F.pow(as_col(p_up) - hit("UP"), 2)
    total = F.pow(as_col(p_up) - hit("UP"), 2) + F.pow(as_col(p_side) - hit("SIDEWAYS"), 2) + F.pow(as_col(p_down) - hit("DOWN"), 2)
    return total * 0.5 if kind == "half" else total / 3.0


def weighted_interval(p10, p50, p90, actual) -> Column:
    """Weighted interval score with a tenfold miss penalty on the 80 % band."""
    lo, mid, hi, y = (as_col(x) for x in (p10, p50, p90, actual))
    miss = F.when(y < lo, lo - y).when(y > hi, y - hi).otherwise(0.0)
    return (0.5 * F.abs(y - mid) + 0.1 * (hi - lo + 10.0 * miss)) / 1.5


def pinball(actual, predicted, q: float) -> Column:
    e = as_col(actual) - as_col(predicted)
    return F.greatest(q * e, (q - 1.0) * e)


def outside_mass(p10, p90, actual) -> Column:
    lo, hi, y = as_col(p10), as_col(p90), as_col(actual)
    return F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0))


def path_errors(df: DataFrame, by: Sequence[str], predicted: str, actual: str, scale: Column | None = None) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n")]
    if scale is not None:
        aggs.append(F.avg(F.abs(e) / F.greatest(scale, F.lit(0.01))).alias("normalised_mae"))
    return df.groupBy(*by).agg(*aggs)


def interval_scores(df: DataFrame, by: Sequence[str], actual: str = "actual") -> DataFrame:
    inside = F.col(actual).between(F.col("p10"), F.col("p90")).cast("double")
    pin = (pinball(actual, "p10", 0.1) + pinball(actual, "p50", 0.5) + pinball(actual, "p90", 0.9)) / 3.0
    return df.groupBy(*by).agg(
        F.avg(weighted_interval("p10", "p50", "p90", actual)).alias("wis"),
        F.avg(pin).alias("pinball"),
        F.avg(inside).alias("coverage"),
        F.avg(outside_mass("p10", "p90", actual)).alias("outside"),
    ).withColumn("coverage_penalty", F.abs(F.col("coverage") - 0.80))


def risk_errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Drawdown and volatility gaps between a predicted and a realised cumulative path, scaled by 0.10 and 0.20."""
    dd = F.abs(A.path_max_drawdown(predicted) - A.path_max_drawdown(actual))
    vol = F.abs(A.path_volatility(predicted) - A.path_volatility(actual))
    return df.withColumns({"drawdown_error": dd, "volatility_error": vol, "risk_error": 0.5 * dd / 0.10 + 0.5 * vol / 0.20})


# Weights of the composite losses.
COMPOSITE_WEIGHTS = {"path_mae": 0.35, "terminal_mae": 0.15, "brier": 0.20, "wis": 0.15, "drawdown_volatility": 0.10, "recent_stability": 0.05}
LONG_PATH_WEIGHTS = {"wis": 0.30, "median_path": 0.105, "terminal": 0.045, "brier": 0.15, "turn": 0.20, "coverage": 0.10, "drawdown": 0.05, "turnover": 0.05}
ANALOGUE_WEIGHTS = {"path": 0.35, "quantile": 0.15, "terminal": 0.15, "direction": 0.15, "timing": 0.10, "position": 0.10}


def composite_loss(components: dict[str, Column], weights: dict[str, float]) -> Column:
    if set(components) != set(weights):
        raise ValueError(f"components {sorted(components)} do not match weights {sorted(weights)}")
    return sum((weights[k] * components[k] for k in weights), F.lit(0.0))


def residual_records(df: DataFrame, predicted: str, actual: str, sigma: str, floor: float = 0.005) -> DataFrame:
    """Log-gross residual path and its standardised form."""
    raw = F.zip_with(actual, predicted, lambda a, p: F.log1p(a) - F.log1p(p))
    s = F.greatest(F.col(sigma), F.lit(floor))
    out = df.withColumns({"residual": raw, "source_sigma": s})
    return out.withColumn("standardised", F.transform("residual", lambda x: x / F.col("source_sigma")))


def evaluate_external(df: DataFrame, strong_up: float = 0.05) -> DataFrame:
    """Hits and misses of external trend calls; the 4-week score uses the 4-week outcome."""
    bull, bear = F.col("trend").isin("BULLISH", "NEUTRAL_BULLISH"), F.col("trend").isin("BEARISH", "NEUTRAL_BEARISH")
    a8, a4 = F.col("actual_8"), F.col("actual_4")
    up = a8 >= strong_up
    return df.withColumns(
        {
            "direction_hit": F.when(bull, a8 > 0).when(bear, a8 < 0),
            "mae_4": F.abs(F.col("expected_4") - a4),
            "mae_8": F.abs(F.col("expected_8") - a8),
            "brier_4": F.pow(F.col("p_up_4") - (a4 > 0).cast("double"), 2),
            "brier_8": F.pow(F.col("p_up_8") - (a8 > 0).cast("double"), 2),
            "strong_up_recognised": up & bull,
            "strong_down_recognised": (a8 <= -0.08) & bear,
            "up_missed": up & ~bull,
            "down_false_alarm": (a8 >= -0.03) & bear,
        }
    )

