"""Comparing models and accounts: behaviour, promotion gates, health, reliability, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalar import as_col, clip
from barloom.operators.panel import ordered, run_length
from barloom.operators.rules import reasons


def behavior_diff(pairs: DataFrame, by: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """Divergence ratios of champion and candidate decisions, and whether they act the same.

    pairs: by + champion_/candidate_ columns path, score, base, target, signal, trades
    (array), equity (array).
    """
    left, right = lambda c: F.col(f"champion_{c}"), lambda c: F.col(f"candidate_{c}")
    count = lambda arr, cond: F.size(F.filter(arr, cond))
    both = lambda c: F.arrays_zip(left(c).alias("a"), right(c).alias("b"))
    longest = lambda c: F.greatest(F.size(left(c)), F.size(right(c)))
    shortest = lambda c: F.least(F.size(left(c)), F.size(right(c)))
    gap = lambda x: F.abs(x["a"] - x["b"])
    rel = lambda x: gap(x) / F.greatest(F.abs(x["a"]), F.abs(x["b"]), F.lit(1e-9))
    d = pairs.withColumns(
        {
            "_f": count(F.slice(both("path"), F.lit(1), shortest("path")), lambda x: gap(x) > tolerance), "_fn": longest("path"),
            "_t": count(both("trades"), lambda x: ~x["a"].eqNullSafe(x["b"])), "_tn": longest("trades"),
            "_e": count(F.slice(both("equity"), F.lit(1), shortest("equity")), lambda x: rel(x) > 1e-9), "_en": longest("equity"),
            "_end": F.abs(F.try_element_at(left("equity"), F.lit(-1)) - F.try_element_at(right("equity"), F.lit(-1))),
        }
    )
    share = lambda num, den: F.when(F.sum(den) > 0, F.sum(num) / F.sum(den)).otherwise(0.0)
    rate = lambda cond: F.avg(cond.cast("double"))
    g = d.groupBy(*by).agg(
        share("_f", "_fn").alias("forecast_ratio"), rate(F.abs(left("score") - right("score")) > tolerance).alias("score_ratio"), rate(left("base") != right("base")).alias("base_ratio"),
        rate(left("target") != right("target")).alias("target_ratio"), rate(~left("signal").eqNullSafe(right("signal"))).alias("signal_ratio"), share("_t", "_tn").alias("trade_ratio"),
        share("_e", "_en").alias("equity_ratio"), F.max("_end").alias("_worst_end"), F.count("*").alias("anchors"),
    )
    same = (F.col("target_ratio") == 0) & (F.col("signal_ratio") == 0) & (F.col("trade_ratio") == 0) & (F.col("equity_ratio") == 0) & (F.coalesce("_worst_end", F.lit(0.0)) < 0.01)
    passes = (F.col("forecast_ratio") >= 0.10) | (F.col("score_ratio") >= 0.10) | (F.col("base_ratio") >= 0.10) | (F.col("target_ratio") >= 0.05) | (F.col("trade_ratio") >= 0.03)
    return g.withColumns({"identical": same, "passes_prefilter": passes}).drop("_worst_end")


def compare_windows(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Champion against candidate over matched windows.

    windows: by + champion_/candidate_ return, profit, drawdown, position, no_action.
    """
    a, b = lambda c: F.col(f"champion_{c}"), lambda c: F.col(f"candidate_{c}")
    return windows.groupBy(*by).agg(
        F.count("*").alias("windows"), F.avg(b("return") - a("return")).alias("mean_excess"),
        (F.expr("percentile(candidate_profit, 0.5)") - F.expr("percentile(champion_profit, 0.5)")).alias("median_profit_excess"),
        F.avg((b("return") > a("return")).cast("double")).alias("win_rate"), F.max(b("drawdown") - a("drawdown")).alias("drawdown_degradation"),
        (F.avg(b("position")) / 100).alias("participation"), (F.avg(a("position")) / 100).alias("champion_participation"), F.avg(b("no_action").cast("double")).alias("no_action_ratio"),
    )


def promotion_channel(df: DataFrame) -> DataFrame:
    """Legal promotion channel with reason codes, from the columns of :func:`compare_windows`
    plus effective_windows, trade_ratio and quality_ok."""
    c = F.col
    strong = (
        c("quality_ok") & (c("windows") >= 8) & (c("mean_excess") >= 0.0030) & (c("median_profit_excess") > 0) & (c("win_rate") >= 0.55)
        & (c("drawdown_degradation") <= 0.02) & (c("participation") >= 0.10) & (c("no_action_ratio") <= 0.60)
    )
    small = (
        c("quality_ok") & (c("windows") >= 16) & (c("effective_windows") >= 8) & (c("mean_excess") >= 0.0015) & (c("mean_excess") < 0.0030) & (c("median_profit_excess") > 0)
        & (c("win_rate") >= 0.58) & (c("drawdown_degradation") <= 0.005) & (c("participation") >= c("champion_participation") - 0.05) & (c("no_action_ratio") <= 0.60) & (c("trade_ratio") >= 0.03)
    )
    channel = F.when(strong, "STRONG").when(small, "STABLE_SMALL_EDGE")
    codes = reasons(
        ("PREDICTION_QUALITY_GATE_FAILED", ~c("quality_ok")), ("INSUFFICIENT_EFFECTIVE_WINDOWS", c("windows") < 8), ("EXCESS_RETURN_BELOW_0_15", c("mean_excess") < 0.0015),
        ("EXCESS_RETURN_BELOW_0_30", (c("mean_excess") >= 0.0015) & (c("mean_excess") < 0.0030)), ("MEDIAN_PROFIT_GATE_FAILED", c("median_profit_excess") <= 0),
        ("WIN_RATE_BELOW_THRESHOLD", c("win_rate") < 0.55), ("DRAWDOWN_GATE_FAILED", c("drawdown_degradation") > 0.02),
        ("NO_ACTION_DEPENDENCY", (c("participation") < 0.10) | (c("no_action_ratio") > 0.60)), ("INSUFFICIENT_BEHAVIOR_DIVERGENCE", c("trade_ratio") < 0.03),
    )
    out = df.withColumn("channel", channel)
    none = F.array().cast("array<string>")
    fallback = F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("EXCESS_RETURN_BELOW_0_30")))
    gap = lambda cond, value: F.when(c("channel").isNull() & cond, value)
    return out.withColumns(
        {
            "reason_codes": F.when(c("channel").isNotNull(), none).otherwise(fallback),
            "excess_gap": gap(c("mean_excess") < 0.0030, F.when(c("mean_excess") < 0.0015, 0.0015 - c("mean_excess")).otherwise(0.0030 - c("mean_excess"))),
            "win_rate_gap": gap(c("win_rate") < 0.55, 0.55 - c("win_rate")), "drawdown_gap": gap(c("drawdown_degradation") > 0.02, c("drawdown_degradation") - 0.02),
        }
    )


def promotion_gate(pairs: DataFrame, interval: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sealed gate on paired losses.

    pairs: by, champion_loss, candidate_loss, champion_inside, candidate_inside,
    champion_shape_hit, candidate_shape_hit, norm_ratio. interval: by, high (bootstrap bound).
    """
    a, b = F.col("champion_loss"), F.col("candidate_loss")
    rate = lambda c: F.avg(F.col(c).cast("double"))
    g = pairs.groupBy(*by).agg(
        ((F.avg(a) - F.avg(b)) / F.greatest(F.avg(a), F.lit(1e-9))).alias("improvement"), F.max((b - a) / F.greatest(F.abs(a), F.lit(1e-9))).alias("worst_degradation"),
        F.avg((b < a).cast("double")).alias("improved_share"), rate("champion_inside").alias("champion_coverage"), rate("candidate_inside").alias("candidate_coverage"),
        rate("champion_shape_hit").alias("champion_shape"), rate("candidate_shape_hit").alias("candidate_shape"), F.max("norm_ratio").alias("norm_ratio"),
    ).join(interval.select(*by, F.col("high").alias("bootstrap_high")), list(by), "left")
    c = F.col
    gates = {
        "IMPROVEMENT": c("improvement") >= 0.01, "WORST_ANCHOR": c("worst_degradation") <= 0.005, "MAJORITY": c("improved_share") > 0.5,
        "BOOTSTRAP": F.coalesce(c("bootstrap_high") < 0, F.lit(False)), "COVERAGE": F.abs(c("candidate_coverage") - 0.8) <= F.abs(c("champion_coverage") - 0.8) + 0.03,
        "COVERAGE_RANGE": c("candidate_coverage").between(0.50, 0.98), "SHAPE": c("candidate_shape") + 0.05 >= c("champion_shape"), "NORM": c("norm_ratio") <= 1.25,
    }
    out = g.withColumn("failed", reasons(*[(k, ~v) for k, v in gates.items()]))
    return out.withColumn("promoted", F.size("failed") == 0)


# ---- health and reliability ---------------------------------------------------------------

def health_states(df: DataFrame, by: Sequence[str] = ("symbol",), t: str = "anchor") -> DataFrame:
    """Model health with hysteresis: two high scores enter, three low ones leave; degradation needs three of each.

    df: by, t, ood_score, degraded (boolean). Counters are run lengths; the sticky
    state is that of the last row which set it, so ordered windows suffice.
    """
    c = F.col
    level = F.when(c("ood_score") >= 0.50, "high").when(c("ood_score") <= 0.35, "low").otherwise("mid")
    d = df.withColumn("_lv", level)
    d = run_length(d, c("_lv"), "_lr", by, t)
    d = run_length(d, c("degraded"), "_dr", by, t)
    d = d.withColumns(
        {
            "ood_entry": F.when(c("_lv") == "high", c("_lr")).otherwise(0), "ood_exit": F.when(c("_lv") == "low", c("_lr")).otherwise(0),
            "degraded_entry": F.when(c("degraded"), c("_dr")).otherwise(0), "degraded_exit": F.when(~c("degraded"), c("_dr")).otherwise(0),
        }
    ).drop("_lv", "_lr", "_dr")
    # Whether a key is out of distribution depends on nothing but the last row that entered or left; given that, the same holds for degradation.
    upto = ordered(by, t).rowsBetween(Window.unboundedPreceding, 0)
    holds = lambda mark: F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(False))
    d = d.withColumn("_out", holds(F.when(c("ood_entry") >= 2, True).when(c("ood_exit") >= 3, False)))
    d = d.withColumn("_worse", holds(F.when(c("_out"), False).when(c("degraded_entry") >= 3, True).when(c("degraded_exit") >= 3, False)))
    return d.withColumn("health", F.when(c("_out"), "MODEL_OUT_OF_DISTRIBUTION").when(c("_worse"), "MODEL_DEGRADED").otherwise("MODEL_NORMAL")).drop("_out", "_worse")


def reliability(df: DataFrame) -> DataFrame:
    """Reliability score 0..100 with caps.

    df: effective_samples, calibration_status, brier, wis, coverage, recent_score,
    ood_score, consistent, health.
    """
    c = F.col
    part = lambda x: clip(x, 0.0, 1.0)
    interval = 0.5 * (1 - F.least(c("wis"), F.lit(2.0)) / 2) + 0.5 * (1 - F.abs(c("coverage") - 0.8) / 0.8)
    raw = 100 * (
        0.20 * part(c("effective_samples") / 50) + 0.20 * part(1 - c("brier") / (2 / 3)) + 0.20 * part(interval) + 0.15 * part(c("recent_score"))
        + 0.15 * part(1 - c("ood_score")) + 0.10 * F.when(c("consistent"), 1.0).otherwise(0.25)
    )
    cap = F.least(
        F.when(c("effective_samples") < 30, 40.0).otherwise(100.0), F.when(c("calibration_status") != "FORMALLY_CALIBRATED", 45.0).otherwise(100.0),
        F.when(c("ood_score") >= 0.5, 50.0).otherwise(100.0), F.when(c("health") != "MODEL_NORMAL", 50.0).otherwise(100.0),
    )
    score = F.least(raw, cap) - F.when(c("consistent"), 0.0).otherwise(15.0)
    return df.withColumn("reliability", F.round(clip(score, 0.0, 100.0), 1))


def vote_consistency(df: DataFrame, votes: Sequence[str], terminal: str) -> DataFrame:
    """Does the forecast direction agree with the signs of independent indicators."""
    signs = F.array(*[F.when(F.col(v).isNotNull() & ~F.isnan(F.col(v)), F.signum(v)) for v in votes])
    known = F.filter(signs, lambda s: s.isNotNull() & (s != 0))
    n = F.size(known)
    balance = F.when(n > 0, F.aggregate(known, F.lit(0.0), lambda a, s: a + s) / F.when(n > 0, n)).otherwise(0.0)
    direction = F.when(F.col(terminal) > 0.01, 1).when(F.col(terminal) < -0.01, -1).otherwise(0)
    return df.withColumns(
        {"vote_balance": balance, "vote_count": n, "forecast_direction": direction, "consistent": (direction == 0) | (n < 3) | (direction * balance >= -0.20)}
    )


# ---- weights of an external forecast ---------------------------------------------------------

# Matured windows -> largest weight in points.
WEIGHT_TIERS = ((100, 40), (50, 30), (30, 10))


def weight_cap(n) -> Column:
    v = as_col(n)
    out = F.lit(0)
    for threshold, weight in reversed(WEIGHT_TIERS):
        out = F.when(v >= threshold, weight).otherwise(out)
    return out


def weight_gate(windows: DataFrame, scores: DataFrame, by: Sequence[str], order: str = "window_end") -> DataFrame:
    """Weight cap of the external side from matched windows and forecast scores.

    windows: by, order + champion_/candidate_ return, drawdown, position, no_action (candidate
    is the external side). scores: by, external_brier, local_brier, external_mae,
    local_mae, matured.
    """
    a, b = lambda c: F.col(f"champion_{c}"), lambda c: F.col(f"candidate_{c}")
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    r = windows.withColumns({"_e": b("return") - a("return"), "_k": F.row_number().over(w)})
    g = r.groupBy(*by).agg(
        F.count("*").alias("matched"), F.avg("_e").alias("excess"), F.avg(b("drawdown") - a("drawdown")).alias("drawdown_diff"), F.avg(b("position") - a("position")).alias("participation_diff"),
        F.avg(b("no_action").cast("double")).alias("no_action_ratio"), F.count_if((F.col("_k") <= 4) & (F.col("_e") < 0)).alias("_neg"),
    )
    j = scores.join(g, list(by), "left")
    c = F.col
    degraded = F.coalesce((c("matched") > 0) & ((c("_neg") >= 4) | (c("participation_diff") <= -0.05)), F.lit(False))
    cap = weight_cap("matured")
    j = j.withColumns({"degraded": degraded, "weight_cap": F.when(degraded, F.least(cap, F.lit(10))).otherwise(cap)})
    failed = reasons(
        ("BRIER", c("external_brier") > c("local_brier") + 0.02), ("MAE", c("external_mae") > c("local_mae") * 1.15), ("RETURN", F.coalesce(c("excess"), F.lit(0.0)) < -0.0005),
        ("DRAWDOWN", F.coalesce(c("drawdown_diff"), F.lit(0.0)) > 0.02), ("PARTICIPATION", F.coalesce(c("participation_diff"), F.lit(0.0)) < -0.05), ("NO_ACTION", F.coalesce(c("no_action_ratio"), F.lit(1.0)) > 0.60),
    )
    return j.withColumn("failed_gates", failed).drop("_neg")


def turn_lag(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median of price-turn minus dif-turn steps where both turned the same way."""
    same = df.where(F.col("price_turn_kind") == F.col("dif_turn_kind"))
    return same.groupBy(*by, F.col("dif_turn_kind").alias("kind")).agg(F.expr("percentile(price_turn_step - dif_turn_step, 0.5)").alias("lag"), F.count("*").alias("n"))


def pool_stats(evaluations: DataFrame, n: int = 52, by: Sequence[str] = ("symbol",), t: str = "available") -> DataFrame:
    """Record count so far and means of the latest n evaluations as of each availability date."""
    w = Window.partitionBy(*by).orderBy(t)
    f = w.rowsBetween(-(n - 1), 0)
    avg = lambda c: F.avg(c).over(f)
    return evaluations.withColumns(
        {
            "raw_count": F.row_number().over(w), "recent_brier": avg("brier"), "recent_wis": avg("wis"), "recent_coverage": avg("inside"),
            "recent_score": clip(1 - avg("normalised_error"), 0.0, 1.0),
        }
    )


# ---- candidates ------------------------------------------------------------------------------

ALPHA_MULTIPLIERS = (0.50, 0.75, 1.00, 1.25, 1.50)


def alpha_candidates(models: DataFrame, by: Sequence[str], alpha: str = "alpha") -> DataFrame:
    """Bounded multiples of each champion's alpha, duplicates removed."""
    grid = F.array_distinct(F.array(*[F.round(clip(F.col(alpha) * m, 0.1, 100.0), 12) for m in ALPHA_MULTIPLIERS]))
    return models.select(*by, F.posexplode(grid).alias("candidate", "alpha"))


def weight_transfers(weights: DataFrame, rejected: DataFrame, by: Sequence[str], groups: Sequence[str], steps: Sequence[int] = (1, 2), low: float = 0.0) -> DataFrame:
    """Every move of 1 or 2 points from one weight group to another, without those already rejected.

    weights: by + one column per group (a handful of fixed names).
    """
    moves = F.array(*[
        F.struct(F.lit(d).alias("donor"), F.lit(r).alias("receiver"), F.lit(s).alias("points"), F.col(d).alias("_have")) for d in groups for r in groups if d != r for s in steps
    ])
    out = weights.select(*by, F.inline(moves)).where(F.col("_have") - F.col("points") >= low).drop("_have")
    return out.join(rejected, [*by, "donor", "receiver", "points"], "left_anti")
