"""Rule strategies on feature tables: scores, recommendations, targets, batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import arrays as A
from barloom.functions.scalar import as_col, clip, snap
from barloom.operators import indicators as I
from barloom.operators.panel import BY, ordered
from barloom.operators.pit import session_ordinals


def reasons(*pairs: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def ladder(value, steps: Sequence[tuple[float, object]], otherwise, strict: bool = False) -> Column:
    """First entry whose threshold the value reaches, from the highest threshold down."""
    v = as_col(value)
    out = None
    for threshold, result in steps:
        cond = (v > threshold) if strict else (v >= threshold)
        out = F.when(cond, result) if out is None else out.when(cond, result)
    return out.otherwise(otherwise)


def step_map(value, steps: Sequence[tuple[float, int]], last: int) -> Column:
    """First entry whose upper bound the value does not exceed."""
    v = as_col(value)
    out = None
    for bound, result in steps:
        out = F.when(v <= bound, result) if out is None else out.when(v <= bound, result)
    return out.otherwise(last)


def side(value, magnitude: float) -> Column:
    """+-magnitude by sign, 0 for zero or NULL."""
    return F.coalesce(F.signum(as_col(value)), F.lit(0.0)) * magnitude


def versus(a, b, magnitude: float) -> Column:
    return side(as_col(a) - as_col(b), magnitude)


# ---- six-component score ------------------------------------------------------------

@dataclass(frozen=True)
class ScoreConfig:
    """Default thresholds, weights and multipliers of the rule score."""

    weights: dict = field(default_factory=lambda: {"valuation": 0.25, "trend": 0.25, "momentum": 0.15, "volume": 0.10, "volatility": 0.10, "risk": 0.15})
    valuation_low: float = 0.30
    valuation_high: float = 0.70
    rsi_low: float = 35.0
    rsi_high: float = 70.0
    volume_low: float = 0.80
    volume_high: float = 1.20
    volatility_high: float = 0.35
    drawdown_pause: float = -0.20
    increase: float = 0.35
    reduce: float = -0.20
    sell_partial: float = -0.45
    pause: float = -0.75
    minimum_confidence: float = 0.50
    multipliers: dict = field(default_factory=lambda: {"INCREASE": 1.30, "NORMAL": 1.0, "REDUCE": 0.75, "PAUSE": 0.50, "HOLD": 1.0, "SELL_PARTIAL": 0.70})
    maximum_sell_ratio: float = 0.30
    minimum_holding_ratio: float = 0.20


INPUTS = ("close", "volume", "valuation_percentile", "ma_20", "ma_60", "rsi_6", "hist", "volume_ma_20", "volatility_20", "current_drawdown")


def rule_score(df: DataFrame, cfg: ScoreConfig = ScoreConfig(), holding: str | None = None) -> DataFrame:
    """Score, confidence, recommendation and explanations of every row.

    Missing inputs drop their component; the weights of the others are renormalised.
    ``valuation_percentile`` is a share in [0, 1]. ``holding`` names the column with
    the current holding ratio, if any.
    """
    c = F.col
    known = lambda *cols: _all(*[c(x).isNotNull() & ~F.isnan(c(x).cast("double")) for x in cols])
    val, ratio = c("valuation_percentile"), c("volume") / F.when(c("volume_ma_20") > 0, c("volume_ma_20"))
    parts = {
        "valuation": F.when(known("valuation_percentile"), F.when(val <= cfg.valuation_low, 1.0).when(val >= cfg.valuation_high, -1.0).otherwise(0.0)),
        "trend": F.when(
            known("close", "ma_20", "ma_60"),
            (F.when(c("close") >= c("ma_20"), 1.0).otherwise(-1.0) + F.when(c("ma_20") >= c("ma_60"), 1.0).otherwise(-1.0)) / 2,
        ),
        "momentum": F.when(
            known("rsi_6", "hist"),
            (F.when(c("rsi_6") <= cfg.rsi_low, 1.0).when(c("rsi_6") >= cfg.rsi_high, -1.0).otherwise(0.0) + F.when(c("hist") >= 0, 1.0).otherwise(-1.0)) / 2,
        ),
        "volume": F.when(known("volume", "volume_ma_20") & (c("volume_ma_20") > 0), F.when(ratio >= cfg.volume_high, 1.0).when(ratio <= cfg.volume_low, -1.0).otherwise(0.0)),
        "volatility": F.when(known("volatility_20"), F.when(c("volatility_20") <= cfg.volatility_high, 1.0).otherwise(-1.0)),
        "risk": F.when(known("current_drawdown"), F.when(c("current_drawdown") <= cfg.drawdown_pause, -1.0).otherwise(1.0)),
    }
    out = df.withColumns({f"score_{k}": v for k, v in parts.items()})
    names = list(parts)
    have = lambda k: c(f"score_{k}").isNotNull()
    weight = _sum([F.when(have(k), F.lit(cfg.weights[k])).otherwise(0.0) for k in names])
    value = _sum([F.coalesce(c(f"score_{k}"), F.lit(0.0)) * cfg.weights[k] for k in names])
    count = _sum([have(k).cast("int") for k in names])
    positive = _sum([F.coalesce(c(f"score_{k}") > 0, F.lit(False)).cast("int") for k in names])
    negative = _sum([F.coalesce(c(f"score_{k}") < 0, F.lit(False)).cast("int") for k in names])
    complete = _sum([known(x).cast("int") for x in INPUTS]) / len(INPUTS)
    agreement = F.when(count > 0, F.greatest(positive, negative) / F.when(count > 0, count)).otherwise(0.0)
    out = out.withColumns(
        {
            "score": F.when(weight > 0, value / F.when(weight > 0, weight)).otherwise(0.0),
            "confidence": complete * 0.60 + agreement * 0.25 + count / 6.0 * 0.15,
        }
    )
    may_sell = F.lit(True) if holding is None else (c(holding).isNull() | (c(holding) > cfg.minimum_holding_ratio))
    s = c("score")
    rec = (
        F.when(c("confidence") < cfg.minimum_confidence, "HOLD")
        .when(s <= cfg.pause, "PAUSE")
        .when((s <= cfg.sell_partial) & may_sell, "SELL_PARTIAL")
        .when(s <= cfg.reduce, "REDUCE")
        .when(s < 0, "HOLD")
        .when(s < cfg.increase, "NORMAL")
        .otherwise("INCREASE")
    )
    out = out.withColumn("recommendation", rec)
    multiplier = F.create_map(*[F.lit(x) for kv in cfg.multipliers.items() for x in kv])[c("recommendation")]
    ceiling = F.lit(cfg.maximum_sell_ratio)
    if holding is not None:
        ceiling = F.when(c(holding).isNull(), ceiling).otherwise(F.least(ceiling, F.greatest(F.lit(0.0), c(holding) - cfg.minimum_holding_ratio)))
    t, m = (c("close"), c("ma_20")), (c("ma_20"), c("ma_60"))
    trend, momentum = have("trend"), have("momentum")
    return out.withColumns(
        {
            "multiplier": multiplier,
            "suggested_sell_ratio": F.when(c("recommendation") == "SELL_PARTIAL", ceiling).otherwise(0.0),
            "rules": reasons(
                ("valuation_low_percentile", c("score_valuation") > 0), ("valuation_high_percentile", c("score_valuation") < 0),
                ("trend_close_above_ma_20", trend & (t[0] >= t[1])), ("trend_ma_20_above_ma_60", trend & (m[0] >= m[1])),
                ("momentum_macd_nonnegative", momentum & (c("hist") >= 0)), ("volume_above_average", c("score_volume") > 0),
                ("volatility_within_limit", c("score_volatility") > 0), ("risk_drawdown_pause", c("score_risk") < 0),
                ("risk_drawdown_within_limit", c("score_risk") > 0), ("insufficient_data_hold", c("confidence") < cfg.minimum_confidence),
                ("sell_partial_safety_cap", c("recommendation") == "SELL_PARTIAL"),
            ),
            "risks": reasons(
                ("valuation_percentile_missing", ~have("valuation")), ("valuation_high_percentile", c("score_valuation") < 0),
                ("trend_data_missing", ~trend), ("trend_close_below_ma_20", trend & (t[0] < t[1])), ("trend_ma_20_below_ma_60", trend & (m[0] < m[1])),
                ("momentum_data_missing", ~momentum), ("momentum_macd_negative", momentum & (c("hist") < 0)), ("momentum_rsi_high", momentum & (c("rsi_6") >= cfg.rsi_high)),
                ("volume_data_missing", ~have("volume")), ("volume_below_average", c("score_volume") < 0), ("volatility_data_missing", ~have("volatility")),
                ("volatility_above_limit", c("score_volatility") < 0), ("drawdown_data_missing", ~have("risk")), ("drawdown_pause_threshold", c("score_risk") < 0),
            ),
        }
    )


def _all(*conds: Column) -> Column:
    out = conds[0]
    for x in conds[1:]:
        out = out & x
    return out


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for x in cols[1:]:
        out = out + x
    return out


def suggest_amounts(plan_amount, recommendation, multiplier, minimum: float | None = None, maximum: float | None = None) -> Column:
    """Buy amount of a plan under a recommendation: 0 unless it says to buy."""
    amount = as_col(plan_amount) * as_col(multiplier)
    if minimum is not None:
        amount = F.greatest(amount, F.lit(minimum))
    if maximum is not None:
        amount = F.least(amount, F.lit(maximum))
    return F.when(as_col(recommendation).isin("INCREASE", "NORMAL"), amount).otherwise(0.0)


# ---- weekly judgement -----------------------------------------------------------------

# Component weights in percent, and score -> target ladder.
JUDGEMENT_WEIGHTS = {"valuation": 30.0, "dea_trend": 20.0, "dif_trend": 20.0, "reversal": 15.0, "price_momentum": 5.0, "risk_regime": 10.0}
JUDGEMENT_TARGETS = ((65.0, 85), (40.0, 75), (20.0, 65), (8.0, 60), (-8.0, 50), (-20.0, 40), (-40.0, 30), (-65.0, 20))


def judgement_components(df: DataFrame) -> DataFrame:
    """Six component scores in [-100, 100]; a missing input contributes 0."""
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    dd, vol = c("current_drawdown"), c("volatility_20")
    risk = (
        zero(clip((c("rsi_6") - 50) * 2, -40.0, 40.0))
        + zero(clip((c("volume_ratio") - 1) * 30, -15.0, 15.0))
        - F.when(dd <= -0.20, 35.0).when(dd <= -0.10, 15.0).otherwise(0.0)
        - F.when(vol >= 0.10, 30.0).when(vol >= 0.06, 15.0).otherwise(0.0)
    )
    return df.withColumns(
        {
            "c_valuation": zero(clip((50 - c("valuation_percentile")) * 2, -100.0, 100.0)),
            "c_dea_trend": clip(side("dea", 50) + side("hist", 25) + versus("dif", "dea", 25), -100.0, 100.0),
            "c_dif_trend": clip(side("dif", 45) + versus("dif", "dea", 35) + side("hist", 20), -100.0, 100.0),
            "c_reversal": clip((zero(c("golden_strength").cast("double")) - zero(c("black_strength").cast("double"))) * 20, -100.0, 100.0),
            "c_price_momentum": clip(versus("ema_12", "ma_20", 50) + versus("ema_12", "ma_60", 50), -100.0, 100.0),
            "c_risk_regime": clip(risk, -100.0, 100.0),
        }
    )


def weekly_judgement(df: DataFrame, weights: dict[str, float] = JUDGEMENT_WEIGHTS) -> DataFrame:
    """Direction, probability, confidence and target of each weekly row.

    Four rules decide first (overvalued with a strong sell point, overvalued trend,
    undervalued with or without a strong buy point); else the weighted component score.
    """
    c = F.col
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    val = c("valuation_percentile")
    out = judgement_components(df)
    score = _sum([c(f"c_{k}") * (w / 100.0) for k, w in weights.items()])
    strong_black = yes(c("black_point") & (c("black_strength") >= 4))
    strong_gold = yes(c("golden_point") & (c("golden_strength") >= 4) & (c("dif") > c("dea")) & (c("hist") >= 0) & (c("ema_12") >= c("ma_20")))
    hot = yes((val >= 85) & ~F.coalesce(c("black_point"), F.lit(False)) & (c("dif") > 0) & (c("dea") > 0) & (c("ema_12") >= c("ma_20")) & (c("ema_12") >= c("ma_60")))
    out = out.withColumns({"score": score, "_sb": strong_black, "_sg": strong_gold, "_hot": hot})
    s = c("score")
    by_score = F.when(s >= 12, "up").when(s <= -12, "down").otherwise("neutral")
    rule = F.when(yes(val >= 85) & c("_sb"), "TOP").when(c("_hot"), "HOT").when(yes(val <= 30) & c("_sg"), "REVERSAL").when(yes(val <= 30), "CHEAP").otherwise("SCORE")
    out = out.withColumn("rule", rule)
    r = c("rule")
    pick = lambda top, hot_, rev, cheap, other: F.when(r == "TOP", top).when(r == "HOT", hot_).when(r == "REVERSAL", rev).when(r == "CHEAP", cheap).otherwise(other)
    neutral_p = F.round(clip(58 - F.abs(s) / 2, 52.0, 58.0))
    trend_p = F.round(clip(52 + F.abs(s) * 0.45, 55.0, 90.0))
    out = out.withColumn("direction", pick("down", "up", "up", "up", by_score))
    out = out.withColumns(
        {
            "probability": pick(81.0, 70.0, 78.0, 58.0, F.when(c("direction") == "neutral", neutral_p).otherwise(trend_p)),
            "confidence": pick(84.0, 70.0, 80.0, 61.0, F.round(clip(55 + F.abs(s) * 0.35, 55.0, 90.0))),
            "target_position": pick(15, 70, 80, 20, ladder("score", JUDGEMENT_TARGETS, 15)),
            "confirmed": pick(F.lit(True), F.lit(False), F.lit(True), F.lit(False), c("_sb") | c("_sg")),
        }
    )
    rest = (100 - c("probability")) / 2
    return out.withColumns({f"p_{d}": F.when(c("direction") == d, c("probability")).otherwise(rest) for d in ("up", "neutral", "down")}).drop("_sb", "_sg", "_hot")


# The earlier scorer's ladder.
LEGACY_TARGETS = ((75.0, 95), (55.0, 85), (35.0, 70), (15.0, 60), (-15.0, 50), (-35.0, 35), (-55.0, 25), (-75.0, 15))


def component_scores(df: DataFrame, weights: dict[str, float], by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Earlier weekly scorer: valuation, line positions with slopes, points, trend and regime."""
    w = ordered(by, t)
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = df.withColumns({"_ds": zero(c("dea") - F.lag("dea").over(w)), "_fs": zero(c("dif") - F.lag("dif").over(w))})
    step = lambda x: clip(x * 12, -45.0, 45.0)
    trend = F.when(c("ma_20").isNotNull(), F.when(c("close") >= c("ma_20"), 40.0).otherwise(-40.0)).otherwise(0.0) + F.when(
        c("ma_60").isNotNull(), F.when(c("close") >= c("ma_60"), 40.0).otherwise(-40.0)
    ).otherwise(0.0)
    regime = zero(clip((c("rsi_6") - 50) * 2, -35.0, 35.0)) + zero(clip((c("volume_ratio") - 1) * 50, -20.0, 20.0)) - F.when(c("current_drawdown") < -0.20, 25.0).otherwise(0.0)
    out = out.withColumns(
        {
            "s_valuation": zero(clip((50 - c("valuation_percentile")) * 2, -100.0, 100.0)),
            "s_eda": clip(side("dea", 35) + step(c("_ds")), -100.0, 100.0),
            "s_dip": clip(versus("dif", "dea", 35) + step(c("_fs")), -100.0, 100.0),
            "s_signal_point": clip((zero(c("golden_strength").cast("double")) - zero(c("black_strength").cast("double"))) * 25, -100.0, 100.0),
            "s_trend": clip(trend, -100.0, 100.0),
            "s_market_regime": clip(regime, -100.0, 100.0),
        }
    ).drop("_ds", "_fs")
    out = out.withColumn("legacy_score", _sum([c(f"s_{k}") * (v / 100.0) for k, v in weights.items()]))
    ratio = F.when(c("legacy_score") >= 35, "7:3").when(c("legacy_score") >= -15, "6:4").otherwise("5:5")
    return out.withColumns({"legacy_target": ladder("legacy_score", LEGACY_TARGETS, 10), "fund_etf_ratio": ratio})


# ---- weekly signal and daily correction ---------------------------------------------------

# State bands of the weekly composite, with the middle of their position range.
SIGNAL_BANDS = ((0.70, "VERY_STRONG_BULL", 95.0), (0.45, "STRONG_BULL", 82.5), (0.20, "BULL", 67.5), (0.05, "MILD_BULL", 57.5))


def weekly_signal(weekly: DataFrame, weights: dict[str, float], by: Sequence[str] = BY) -> DataFrame:
    """Composite of momentum, trend, MACD, valuation and risk, with state, market state and base target.

    weekly: close bars with ``valuation_percentile`` (0..100, may be NULL).
    """
    c = F.col
    out = I.macd(weekly, by=by)
    out = I.volatility(out, 13, 52, "pop", out="_vol13", by=by)
    w = ordered(by)
    chg = lambda n: c("close") / F.lag("close", n).over(w) - 1
    out = out.withColumns(
        {
            "_mom": 0.5 * chg(4) + 0.3 * chg(8) + 0.2 * chg(13),
            "_m20": I.sma("close", 20, partial=False, by=by), "_m60": I.sma("close", 60, partial=False, by=by),
            "_dd": I.max_drawdown("close", 60, by=by), "_ph": F.lag("hist").over(w),
            "_scale": F.greatest(c("_vol13") / 52.0**0.5, F.lit(0.01)),
        }
    )
    unit = lambda x: clip(x, -1.0, 1.0)
    parts = {
        "momentum": unit(c("_mom") / (c("_scale") * 3)),
        "trend": unit(((c("close") / c("_m20") - 1) * 0.65 + (c("close") / c("_m60") - 1) * 0.35) / F.greatest(c("_scale") * 2, F.lit(0.02))),
        "macd": unit((c("dif") - c("dea")) / c("close") / F.greatest(c("_scale") / 4, F.lit(0.002))),
        "valuation": F.coalesce(unit((50 - c("valuation_percentile")) / 50), F.lit(0.0)),
        "risk": unit(1 + c("_dd") / F.greatest(c("_vol13"), F.lit(0.08))),
    }
    out = out.withColumns({f"f_{k}": v for k, v in parts.items()})
    out = out.withColumn("signal_score", unit(_sum([c(f"f_{k}") * v for k, v in weights.items()])))
    s = c("signal_score")
    low = ((-0.05, "NEUTRAL", 47.5), (-0.20, "MILD_BEAR", 37.5), (-0.45, "BEAR", 27.5))
    state, target = None, None
    for bound, name, mid in SIGNAL_BANDS:
        state = F.when(s >= bound, name) if state is None else state.when(s >= bound, name)
        target = F.when(s >= bound, mid) if target is None else target.when(s >= bound, mid)
    for bound, name, mid in low:
        state, target = state.when(s > bound, name), target.when(s > bound, mid)
    state, target = state.when(s.isNotNull(), "STRONG_BEAR"), target.when(s.isNotNull(), 15.0)
    val = c("valuation_percentile")
    market = (
        F.when((val >= 90) & (s > 0.2), F.when(c("hist") >= c("_ph"), "EXPENSIVE_STRONG").otherwise("EXPENSIVE_FADING"))
        .when((val <= 15) & (s < -0.08), F.when(c("hist") > c("_ph"), "CHEAP_STABILISING").otherwise("CHEAP_WEAK"))
        .when(s < -0.45, "FALL_ACCELERATING").when(s > 0.2, "FAIR_RISING").when(s.isNotNull(), "FAIR_RANGING")
    )
    out = out.withColumns(
        {
            "signal_direction": F.when(s >= 0.08, "up").when(s <= -0.08, "down").when(s.isNotNull(), "sideways"),
            "signal_state": state, "signal_market_state": market, "base_target": snap(target, 5),
            "signal_confidence": clip(56 + F.abs(s) * 30, 35.0, 90.0),
        }
    )
    return out.drop("_vol13", "_mom", "_m20", "_m60", "_dd", "_ph", "_scale")


def daily_correction(df: DataFrame) -> DataFrame:
    """Position and confidence adjustments from the daily row next to the weekly direction.

    df: d_dif, d_dea, d_rsi, d_close, d_ma20, signal_direction.
    """
    c = F.col
    gap = c("d_close") / c("d_ma20") - 1
    hot, cold = (c("d_rsi") >= 70) | (gap >= 0.07), (c("d_rsi") <= 30) | (gap <= -0.07)
    daily = F.when((c("d_dif") > c("d_dea")) & (c("d_close") > c("d_ma20")), "up").when((c("d_dif") < c("d_dea")) & (c("d_close") < c("d_ma20")), "down").otherwise("sideways")
    out = df.withColumns({"daily_direction": daily, "overheat": hot, "oversold": cold & ~hot})
    d, wk = c("daily_direction"), c("signal_direction")
    consistent = (d == wk) | (d == "sideways")
    base = F.when(consistent & (d != "sideways"), 3).when(~consistent, -4).otherwise(0)
    conf = F.when(c("overheat"), F.least(base, F.lit(-3))).when(c("oversold"), F.when(wk == "down", F.least(base, F.lit(-2))).otherwise(F.greatest(base, F.lit(2)))).otherwise(base)
    pos = F.when(c("overheat"), -5).when(c("oversold"), 5).otherwise(0)
    pos = F.when((wk == "up") & (d == "down"), F.least(pos, F.lit(-5))).when((wk == "down") & (d == "up"), F.greatest(pos, F.lit(5))).otherwise(pos)
    state = (
        F.when((wk == "up") & (d == "down"), "WAIT_DAILY_CONFIRMATION").when((wk == "down") & (d == "up"), "OVERSOLD_BOUNCE")
        .when(c("overheat"), "OVERHEATED").when(c("oversold"), "OVERSOLD").otherwise("NEUTRAL_PACE")
    )
    return out.withColumns(
        {"consistent": consistent, "confidence_adjustment": conf, "position_adjustment": pos, "correction_state": state,
         "execution_speed": F.when(~consistent | c("overheat") | c("oversold"), "slow").otherwise("normal")}
    )


# ---- quadrant, confirmation, position target ------------------------------------------------

# Score -> base position (TOP_POSITION above the last bound), position caps by confirmation, weights of the target score.
SCORE_POSITIONS = ((-0.60, 0), (-0.35, 10), (-0.15, 20), (0.10, 30), (0.30, 45), (0.55, 60))
TOP_POSITION = 80
STATE_CAPS = {
    "BEARISH_CONFIRMED": 10, "TOP_CONFIRMED": 10, "SIGNAL_CONFLICT": 20, "UNCONFIRMED": 30, "NEGATIVE_DIF_RISING": 30, "PRICE_BOTTOM_CONFIRMED": 40,
    "DIF_BOTTOM_CONFIRMED": 40, "PARTIALLY_CONFIRMED_BOTTOM": 50, "TEMPORALLY_CONSISTENT_BOTTOM": 65, "POSITIVE_DIF_RISING": 60, "TREND_CONFIRMED": 80,
}
TARGET_WEIGHTS = {"predicted_return": 0.35, "probability_edge": 0.30, "trend_momentum": 0.20, "risk": 0.15, "valuation": 0.0}


def confirmation(df: DataFrame, trend_weeks: int = 2) -> DataFrame:
    """dif quadrant and confirmation status.

    df: dif_rel, dif_first_change, dif_second_change, ma20_distance, ma20_slope,
    ma60_distance, rebound, dif_regime_length, golden_cross_count, p_up_8, p_down_8.
    """
    c = F.col
    d, f, s2 = c("dif_rel"), c("dif_first_change"), c("dif_second_change")
    quadrant = (
        F.when(d.isNull() | f.isNull(), "UNCONFIRMED")
        .when((d < 0) & (f < 0), "NEGATIVE_DIF_FALLING").when((d < 0) & (f > 0), "NEGATIVE_DIF_RISING")
        .when((d > 0) & (f > 0), F.when(s2 < 0, "POSITIVE_DIF_RISING_DECELERATING").when(s2 >= 0, "POSITIVE_DIF_ACCELERATING").otherwise("POSITIVE_DIF_RISING"))
        .when((d > 0) & (f < 0), "POSITIVE_DIF_FALLING").otherwise("UNCONFIRMED")
    )
    out = df.withColumn("dif_quadrant", quadrant)
    q = c("dif_quadrant")
    below, above = F.coalesce(c("ma20_distance") < 0, F.lit(False)), F.coalesce(c("ma20_distance") > 0, F.lit(False))
    flat = F.coalesce(c("ma20_slope") <= 0, F.lit(True))
    down_edge = F.coalesce(c("p_down_8") - c("p_up_8"), F.lit(0.0))
    price_bottom = F.coalesce((c("rebound") > 0) & c("ma20_distance").isNotNull(), F.lit(False))
    dif_bottom = F.coalesce(c("dif_regime_length") >= 2, F.lit(False))
    trend = (
        above & F.coalesce(c("ma20_slope") > 0, F.lit(True)) & F.coalesce(c("ma60_distance") > -0.05, F.lit(True)) & (down_edge < 0)
        & (F.coalesce("golden_cross_count", F.lit(0)) >= max(1, trend_weeks))
    )
    status = (
        F.when(q == "NEGATIVE_DIF_FALLING", F.when(below & flat & (down_edge > 0.15), "BEARISH_CONFIRMED").otherwise("UNCONFIRMED"))
        .when(q == "POSITIVE_DIF_FALLING", F.when(below & flat, "TOP_CONFIRMED").when((down_edge > 0.25) & below, "SIGNAL_CONFLICT").otherwise("UNCONFIRMED"))
        .when(
            q == "NEGATIVE_DIF_RISING",
            F.when(price_bottom & dif_bottom, "PARTIALLY_CONFIRMED_BOTTOM").when(price_bottom, "PRICE_BOTTOM_CONFIRMED").when(dif_bottom, "DIF_BOTTOM_CONFIRMED").otherwise("NEGATIVE_DIF_RISING"),
        )
        .when(q.startswith("POSITIVE_DIF"), F.when(trend, "TREND_CONFIRMED").otherwise("POSITIVE_DIF_RISING"))
        .otherwise("UNCONFIRMED")
    )
    caps = F.create_map(*[F.lit(x) for kv in STATE_CAPS.items() for x in kv])
    out = out.withColumn("confirmation", status)
    cap = F.coalesce(caps[c("confirmation")], F.lit(STATE_CAPS["UNCONFIRMED"]))
    return out.withColumn("state_cap", F.when(q == "POSITIVE_DIF_RISING_DECELERATING", F.least(cap, F.lit(60))).otherwise(cap))


def position_target(df: DataFrame, weights: dict[str, float] = TARGET_WEIGHTS, target_vol: float | None = None, max_position: int = 80) -> DataFrame:
    """Five components -> score -> base position -> capped and volatility-targeted position.

    df: the columns of :func:`confirmation` plus expected_4, expected_8, p10_8,
    p_up_4, p_down_4, from_high, volatility_26 and valuation_percentile.
    """
    c = F.col
    zero = lambda x: F.coalesce(as_col(x), F.lit(0.0))
    unit = lambda x: clip(x, -1.0, 1.0)
    sign = lambda x: F.when(zero(x) > 0, 1.0).otherwise(-1.0)
    edge = lambda h: zero(c(f"p_up_{h}") - c(f"p_down_{h}"))
    parts = {
        "predicted_return": unit((zero("expected_4") + zero("expected_8")) / 2 / 0.08),
        "probability_edge": unit((edge(4) + edge(8)) / 2),
        "trend_momentum": unit(0.40 * sign("dif_rel") + 0.30 * sign("dif_first_change") + 0.30 * unit(zero("ma20_slope") / 0.01)),
        "risk": unit(-zero("p10_8") / 0.15 - F.greatest(-zero("from_high") / 0.25, F.lit(0.0)) * 0.5),
        "valuation": zero(unit((0.60 - c("valuation_percentile") / 100) / 0.50)),
    }
    out = confirmation(df).withColumns({f"t_{k}": v for k, v in parts.items()})
    out = out.withColumn("strategy_score", unit(_sum([c(f"t_{k}") * w for k, w in weights.items()])))
    out = out.withColumn("base_target", step_map("strategy_score", SCORE_POSITIONS, TOP_POSITION))
    target = F.least("base_target", "state_cap")
    if target_vol is not None:
        mult = clip(target_vol / F.greatest(F.coalesce("volatility_26", F.lit(0.20)), F.lit(1e-9)), 0.75, 1.25)
        target = F.least(F.lit(float(max_position)), snap(target * mult, 5))
    return out.withColumn("final_target", snap(target, 5).cast("int"))


# ---- policy target -----------------------------------------------------------------------

def policy_target(df: DataFrame) -> DataFrame:
    """Constrained target from a probability edge; the edge alone cannot raise exposure.

    df: current, p_up, p_side, p_down, reliability, health, consistency, action_kind
    (BOTTOM, TOP or NULL), valuation_percentile.
    """
    c = F.col
    cur, edge = c("current"), c("p_up") - c("p_down")
    uncertain = (F.abs(edge) < 0.10) | (c("p_side") >= F.greatest("p_up", "p_down")) | (c("reliability") < 40)
    raw = (
        F.when(uncertain, cur).when(edge >= 0.35, 80).when(edge >= 0.20, 70).when(edge >= 0.10, 60).when(edge <= -0.35, 20).when(edge <= -0.20, 30).otherwise(40)
    )
    kind = F.coalesce(c("action_kind"), F.lit("NONE"))
    val = c("valuation_percentile")
    out = df.withColumns({"edge": edge, "uncapped": clip(snap(raw, 5), 0, 100).cast("int")})
    t1 = (
        F.when(val >= 90, F.least(c("uncapped"), F.when(kind == "TOP", 30).otherwise(70)))
        .when((val <= 15) & (c("uncapped") > cur) & (kind != "BOTTOM"), F.least(c("uncapped"), cur + 10))
        .otherwise(c("uncapped"))
    )
    out = out.withColumn("_t1", t1)
    weak = c("health").isin("MODEL_DEGRADED", "MODEL_OUT_OF_DISTRIBUTION")
    t2 = (
        F.when(weak, F.least(cur, F.lit(30)))
        .when((c("_t1") > cur) & (kind != "BOTTOM"), cur)
        .when((c("_t1") < cur) & ~kind.isin("TOP", "NONE"), cur)
        .otherwise(c("_t1"))
    )
    conflict = c("consistency").isin("TYPE_CONFLICT", "TIME_CONFLICT", "AMBIGUOUS_TWO_SIDED")
    out = out.withColumn("_t2", t2).withColumn("_t3", clip(snap(F.when(conflict & (c("_t2") > cur), cur).otherwise(c("_t2")), 5), 0, 100).cast("int"))
    strong = (c("consistency") == "TEMPORALLY_CONSISTENT") & (c("reliability") >= 70) & (F.abs("edge") >= 0.35)
    first = F.when(strong, 20).otherwise(10)
    horizon = first + 60
    delta = c("_t3") - cur
    capped = F.when(F.abs(delta) > horizon, cur + F.signum(delta) * horizon).otherwise(c("_t3"))
    out = out.withColumns({"target": clip(snap(capped, 5), 0, 100).cast("int"), "first_limit": first})
    change = c("target") - cur
    return out.withColumns(
        {
            "action": F.when(change > 0, "BUY").when(change < 0, "SELL").otherwise("HOLD"),
            "batches": A.split_batches(F.abs(change), c("first_limit"), 20),
            "ratio": edge_ratio(c("edge")),
            "reasons": reasons(
                ("uncertain_hold", uncertain), ("high_valuation_cap", val >= 90), ("low_valuation_probe", (val <= 15) & (c("uncapped") > cur) & (kind != "BOTTOM")),
                ("weak_model_reduce_only", weak), ("increase_needs_bottom", ~weak & (c("_t1") > cur) & (kind != "BOTTOM")), ("turn_conflict", conflict & (c("_t2") > cur)),
                ("four_batch_horizon", F.abs(delta) > horizon),
            ),
        }
    ).drop("_t1", "_t2", "_t3")


def edge_ratio(edge) -> Column:
    e = as_col(edge)
    return F.when(e >= 0.30, "7:3").when(e >= 0.10, "6:4").when(e > -0.10, "5:5").when(e > -0.30, "4:6").otherwise("3:7")


def batch_dates(df: DataFrame, calendar: DataFrame, count: str, anchor: str = "trade_date", horizon_weeks: int = 13) -> DataFrame:
    """The next ``count`` sessions after each anchor, within the horizon, as one row per batch."""
    o = session_ordinals(calendar)
    a = df.join(o.select(F.col("session_date").alias(anchor), F.col("ordinal").alias("_o")), anchor)
    a = a.where(F.col(count) > 0).withColumn("batch", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
    nxt = o.select(F.col("ordinal").alias("_n"), F.col("session_date").alias("batch_date"))
    out = a.withColumn("_n", F.col("_o") + F.col("batch")).join(nxt, "_n", "left")
    return out.where(F.col("batch_date") <= F.date_add(anchor, 7 * horizon_weeks)).drop("_o", "_n")


def fusion_position(local_score, ai_up, local_position, conflict, local_weight: float = 0.8, ai_weight: float = 0.2, policy: str = "REDUCE_5PP", max_position: int = 80) -> Column:
    """Weighted blend of the local score (0..100) and an external up-probability, lowered on conflict."""
    up = as_col(ai_up)
    lw = F.when(up.isNull(), 1.0).otherwise(local_weight)
    aw = F.when(up.isNull(), 0.0).otherwise(ai_weight)
    fused = lw * clip(as_col(local_score) / 100, 0.0, 1.0) + aw * F.coalesce(clip(up, 0.0, 1.0), F.lit(0.0))
    pos = step_map(fused, SCORE_POSITIONS, TOP_POSITION).cast("double")
    hit = as_col(conflict) != "NONE"
    if policy == "WAIT_CONFIRMATION":
        pos = F.when(hit, as_col(local_position).cast("double")).otherwise(pos)
    else:
        pos = pos - F.when(hit, {"REDUCE_5PP": 5.0, "REDUCE_10PP": 10.0}.get(policy, 0.0)).otherwise(0.0)
    return snap(clip(pos, 0.0, float(max_position)), 5).cast("int")


def conflict_state(local_up, ai_up) -> dict[str, Column]:
    a, b = as_col(local_up), as_col(ai_up)
    la, lb = a >= 0.5, b >= 0.5
    consensus = (
        F.when(la & lb, F.when(F.least(a, b) >= 0.65, "CONSENSUS_STRONG_BULL").otherwise("CONSENSUS_BULL"))
        .when(~la & ~lb, F.when(F.greatest(a, b) <= 0.35, "CONSENSUS_STRONG_BEAR").otherwise("CONSENSUS_BEAR"))
        .otherwise("CONSENSUS_NEUTRAL")
    )
    conflict = F.when(la & ~lb, "LOCAL_BULL_EXTERNAL_BEAR").when(~la & lb, "LOCAL_BEAR_EXTERNAL_BULL").when(F.abs(a - b) >= 0.25, "HIGH_CONFLICT").otherwise("NONE")
    return {"consensus": consensus, "conflict": conflict, "conflict_score": F.abs(a - b)}


# States in which a batch is over.
TERMINAL = ("CANCELLED", "EXPIRED", "SUPERSEDED", "EXECUTED_OBSERVED")


def batch_state(df: DataFrame, cooldown: int = 5) -> DataFrame:
    """Next state of every open batch from its stored facts.

    df: state, previous_executed, cooldown_sessions, confirmation_met, invalidated,
    expired, execution_observed, not_started.
    """
    c = F.col
    nxt = (
        F.when(c("state").isin(*TERMINAL), c("state")).when(c("invalidated"), "CANCELLED").when(c("expired"), "EXPIRED").when(c("not_started"), "WAITING_CONFIRMATION")
        .when(c("execution_observed") & (c("state") == "ELIGIBLE"), "EXECUTED_OBSERVED")
        .when(~c("previous_executed") | (c("cooldown_sessions") < cooldown), "DEFERRED").when(c("confirmation_met"), "ELIGIBLE").otherwise("DEFERRED")
    )
    return df.withColumn("next_state", nxt)


def eligible_after(windows: DataFrame, proposals: DataFrame, by: Sequence[str], min_weeks: int = 8) -> DataFrame:
    """Windows that start after a proposal's anchor, at least ``min_weeks`` weekly ordinals old, and whether a review is due."""
    j = windows.join(proposals.select(*by, F.col("ordinal").alias("_p")), list(by)).withColumn("_age", F.col("ordinal") - F.col("_p"))
    return j.groupBy(*by).agg(
        F.count_if(F.col("_age") > 0).alias("after"), F.count_if(F.col("_age") >= min_weeks).alias("eligible")
    ).withColumn("review_due", F.col("eligible") >= min_weeks)


# ---- targets from a forecast path -----------------------------------------------------------

def path_target(df: DataFrame, path: str = "path") -> DataFrame:
    """Target from a 20-step path: terminal over threshold, drawdown penalty, valuation caps and probes.

    df: path, threshold, current, direction, top_confirmed, bottom_confirmed, valuation_percentile.
    """
    c = F.col
    wealth = F.transform(path, lambda r: 1.0 + r)
    drawdown = I.fold_drawdown(wealth) * 100
    raw = 50 + F.element_at(path, -1) / F.greatest("threshold", F.lit(0.01)) * 25 + F.greatest(F.lit(-15.0), F.least(F.lit(0.0), drawdown + 5))
    val = c("valuation_percentile")
    out = df.withColumn("_raw", raw)
    adj = (
        F.when(val >= 90, F.when(c("top_confirmed") & (c("direction") == "down"), F.least(c("_raw"), F.lit(15.0))).otherwise(F.least(c("_raw"), F.lit(70.0))))
        .when(val <= 15, F.when(c("bottom_confirmed") & (c("direction") == "up"), F.greatest(c("_raw"), F.lit(80.0))).otherwise(F.least(c("_raw"), c("current") + 10.0)))
        .otherwise(c("_raw"))
    )
    terminal = F.element_at(path, -1)
    ratio = F.when(terminal >= 0.10, "7:3").when(terminal >= 0.03, "6:4").when(terminal > -0.03, "5:5").when(terminal > -0.10, "4:6").otherwise("3:7")
    return out.withColumns({"target": clip(snap(adj, 5), 0, 100).cast("int"), "ratio": ratio}).drop("_raw")


# Weekly fade of the daily correction.
CORRECTION_DECAY = (1.0, 0.75, 0.5, 0.25)
CORRECTION_CAP = 0.03


def daily_adjustments(correction, limit: float = 10.0) -> dict[str, Column]:
    """Bounded position and confidence adjustments from the first four daily corrections."""
    head = F.slice(as_col(correction), 1, len(CORRECTION_DECAY))
    norm = clip(A.total(head) / (CORRECTION_CAP * sum(CORRECTION_DECAY)), -1.0, 1.0)
    return {
        "position_adjustment": clip(snap(norm * limit, 5), -limit, limit).cast("int"), "confidence_adjustment": norm * limit,
        "correction_state": F.when(norm > 0.15, "bullish").when(norm < -0.15, "bearish").otherwise("neutral"),
    }


def external_target(df: DataFrame) -> DataFrame:
    """Position from an external forecast: bearish trends veto, then a probability ladder, halved for high risk; at most four batches.

    df: trend, probability (NULL = no forecast), risk_level.
    """
    c = F.col
    p = clip("probability", 0.0, 1.0)
    base = F.when(c("trend").isin("BEARISH", "NEUTRAL_BEARISH"), 0.0).otherwise(ladder(p, ((0.60, 40.0), (0.50, 20.0), (0.40, 10.0)), 0.0))
    mult = F.when(c("risk_level").isin("LOW", "MEDIUM"), 1.0).otherwise(0.5)
    target = F.coalesce(clip(snap(base * mult, 5), 0.0, 80.0), F.lit(0.0)).cast("int")
    out = df.withColumn("target", F.when(c("probability").isNull(), 0).otherwise(target))
    # batches of at most 10 points while something remains
    steps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.greatest(F.lit(0), F.least(F.lit(10), c("target") - 10 * i)))
    return out.withColumn("batches", F.filter(steps, lambda x: x > 0))
