"""Feature rows: daily, weekly, state and multi-timeframe sets, signals, snapshots.

Each set is a chain of bar windows over one partitioning, so a whole feature
table costs a single exchange on the series key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.scalar import change, safe_div
from barloom.operators import indicators as I, pit
from barloom.operators.panel import BY, asof_join, ordered, run_length, running, trailing
from barloom.operators.prices import candle, ret, sign_agree

WARMUP_WEEKS = 60
MACD_STABLE_ROWS = 35
MIN_VALUATIONS = 20
LOW_VALUATION, HIGH_VALUATION = 30.0, 70.0
CONFIRMATIONS = 5


# ---- cross signal ---------------------------------------------------------------

def golden_black(df: DataFrame, percentile: str = "valuation_percentile") -> DataFrame:
    """Buy and sell points: five confirmations that only count on a cross of dif over dea."""
    w = ordered()
    up = (F.lag("dif").over(w) <= F.lag("dea").over(w)) & (F.col("dif") > F.col("dea"))
    down = (F.lag("dif").over(w) >= F.lag("dea").over(w)) & (F.col("dif") < F.col("dea"))
    rising = F.col("hist") > F.lag("hist").over(w)
    falling = F.col("hist") < F.lag("hist").over(w)
    out = df.withColumns({"_up": up, "_down": down, "_rise": rising, "_fall": falling})
    pct = F.col(percentile)
    ready = pct.isNotNull() & F.col("_up").isNotNull()

    def reasons(cross: str, checks: Sequence[tuple[str, Column]]) -> Column:
        found = F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in checks]))
        return F.when(ready, F.when(F.col(cross), found).otherwise(F.array().cast("array<string>")))

    gold = reasons(
        "_up",
        [
            ("dif_crossed_above_dea", F.col("_up")),
            ("dif_at_or_below_zero", F.col("dif") <= 0),
            ("macd_histogram_rising", F.col("_rise")),
            ("valuation_percentile_low", pct <= LOW_VALUATION),
            ("price_at_or_above_ma20", F.col("close") >= F.col("ma_20")),
        ],
    )
    black = reasons(
        "_down",
        [
            ("dif_crossed_below_dea", F.col("_down")),
            ("dif_at_or_above_zero", F.col("dif") >= 0),
            ("macd_histogram_falling", F.col("_fall")),
            ("valuation_percentile_high", pct >= HIGH_VALUATION),
            ("price_below_ma20", F.col("close") < F.col("ma_20")),
        ],
    )
    out = out.withColumns({"golden_reasons": gold, "black_reasons": black}).drop("_up", "_down", "_rise", "_fall")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return out.withColumns(
        {
            "golden_strength": size("golden_reasons"),
            "black_strength": size("black_reasons"),
            "golden_point": size("golden_reasons") >= CONFIRMATIONS,
            "black_point": size("black_reasons") >= CONFIRMATIONS,
        }
    )


# ---- market state -----------------------------------------------------------------

# Numeric code of each market state.
STATE_CODES = {
    "UPTREND": 1.0,
    "DOWNTREND": -1.0,
    "SIDEWAYS": 0.0,
    "HIGH_VOLATILITY": 2.0,
    "LOW_VOLATILITY": -2.0,
    "DRAWDOWN": -3.0,
    "RECOVERY": 3.0,
}


def market_state(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Seven-state label of a weekly series and how long it has held.

    The duration starts counting at the 20th row, when the mean is complete.
    """
    out = I.volatility(df, 13, 52, "pop", out="volatility_13", by=by)
    out = I.range_stats(out, by=by)
    out = out.withColumns(
        {"_ma20": I.sma("close", 20, by=by), "_ms_rn": F.row_number().over(ordered(by))}
    )
    out = out.withColumn("ma20_slope", I.slope("close", 20, "close", by, row="_ms_rn"))
    dd, rb, vol, sl = F.col("from_high"), F.col("rebound"), F.col("volatility_13"), F.col("ma20_slope")
    label = (
        F.when(dd <= -0.15, "DRAWDOWN")
        .when((rb >= 0.10) & (dd > -0.10), "RECOVERY")
        .when(vol >= 0.30, "HIGH_VOLATILITY")
        .when(vol <= 0.15, "LOW_VOLATILITY")
        .when((F.col("close") > F.col("_ma20")) & (sl.isNull() | (sl > 0)), "UPTREND")
        .when((F.col("close") < F.col("_ma20")) & (sl.isNull() | (sl < 0)), "DOWNTREND")
        .otherwise("SIDEWAYS")
    )
    out = out.withColumn("market_state", label)
    out = run_length(out, F.concat((F.col("_ms_rn") >= 20).cast("string"), F.col("market_state")), "_run", by)
    codes = F.create_map(*[F.lit(x) for kv in STATE_CODES.items() for x in kv])
    return out.withColumns(
        {"market_state_duration": F.when(F.col("_ms_rn") < 20, 1).otherwise(F.col("_run")), "market_state_code": codes[F.col("market_state")]}
    ).drop("_ma20", "_ms_rn", "_run")


# ---- shared feature groups ----------------------------------------------------------

def _base(df: DataFrame, by: Sequence[str]) -> DataFrame:
    out = I.macd(df, by=by)
    out = I.cross_state(out, by=by)
    out = I.obv(I.with_true_range(candle(out, by=by), by=by), by=by)
    return out.withColumns({"_spread": F.col("dif") - F.col("dea"), "_ret": ret("close", 1, by), "_vchg": ret("volume", 1, by), "_rn": F.row_number().over(ordered(by))})


def _with_slopes(df: DataFrame, spans: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Relative slopes the divergences share, computed once per column and span."""
    return df.withColumns({f"_s_{c}_{n}": I.slope(c, n, "close", by, row="_rn") for c in ("close", "dif", "hist") for n in spans})


def _strict_change(n: int, by: Sequence[str]) -> Column:
    """Volume change over n rows when none of them is missing."""
    f = trailing(n + 1, by)
    return F.when(F.count("volume").over(f) == n + 1, ret("volume", n, by))


def _oscillator_features(p: str, stable: Column | None, slopes: Sequence[int], curves: Sequence[int], spans: Sequence[int], by) -> dict[str, Column]:
    scale = F.col("close")
    cols = {
        f"{p}_dif": F.col("dif") / scale,
        f"{p}_dea": F.col("dea") / scale,
        f"{p}_macd_histogram": F.col("hist") / scale,
        f"{p}_dif_dea_relative_gap": (F.col("dif") - F.col("dea")) / (F.abs("dif") + F.abs("dea") + 1e-12),
        f"{p}_cross_state": F.col("cross_state").cast("double"),
        f"{p}_cross_duration": F.col("cross_duration").cast("double"),
        f"{p}_zero_axis_state": F.when(F.col("dif") >= 0, 1.0).otherwise(-1.0),
        f"{p}_spread_speed_1": I.slope("_spread", 2, "close", by),
        f"{p}_spread_speed_3": I.slope("_spread", 3, "close", by),
        f"{p}_spread_speed_5": I.slope("_spread", 5, "close", by),
        f"{p}_histogram_speed_3": I.slope("hist", 3, "close", by),
        f"{p}_histogram_acceleration_5": I.curvature("hist", 5, "close", by),
    }
    for n in slopes:
        cols[f"{p}_dif_slope_{n}"] = I.slope("dif", max(2, n), "close", by, row="_rn")
        cols[f"{p}_dea_slope_{n}"] = I.slope("dea", max(2, n), "close", by, row="_rn")
    for n in curves:
        cols[f"{p}_dif_curvature_{n}"] = I.curvature("dif", n, "close", by)
        cols[f"{p}_dea_curvature_{n}"] = I.curvature("dea", n, "close", by)
    for n in spans:
        for name, osc in (("dif", "dif"), ("macd", "hist")):
            cols[f"{p}_price_{name}_divergence_{n}"] = I.slope_gap(F.col(f"_s_close_{n}"), F.col(f"_s_{osc}_{n}"))
    return cols if stable is None else {k: F.when(stable, v) for k, v in cols.items()}


def _candle_features(p: str) -> dict[str, Column]:
    return {f"{p}_{c}": F.col(c) for c in ("body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "close_location", "gap")}


def features_daily(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Daily feature row of every session: trend, momentum, candle, volume and divergence groups."""
    out = _base(df, by)
    for n in (20, 60):
        out = I.volatility(out, n, 252, "pop", out=f"daily_volatility_{n}", by=by)
    out = I.rsi(out, 14, "simple", out="daily_rsi14", by=by)
    out = _with_slopes(out, (20, 40, 60), by)
    cols = _oscillator_features("daily", None, (3, 5, 10), (3, 5, 10), (20, 40, 60), by)
    cols |= _candle_features("daily")
    cols |= {f"daily_return_{n}": ret("close", n, by) for n in (1, 5, 20, 60)}
    cols |= {f"daily_ma{n}_distance": change(F.col("close"), I.sma("close", n, by=by)) for n in (5, 10, 20, 60)}
    cols |= {f"daily_volume_change_{n}": _strict_change(n, by) for n in (1, 5, 20)}
    cols |= {
        "daily_atr14_ratio": I.atr(14, by) / F.col("close"),
        "daily_volume_zscore_20": I.zscore("volume", 20, by),
        "daily_obv_slope_20": I.slope("obv", 20, F.greatest(F.abs("obv"), F.lit(1.0)), by, row="_rn"),
        "daily_price_volume_correlation_20": I.rolling_corr("_ret", "_vchg", 20, by),
    }
    keep = [*by, "trade_date", "close", "daily_volatility_20", "daily_volatility_60", "daily_rsi14"]
    return out.select(*keep, *[v.alias(k) for k, v in cols.items()])


def features_weekly(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Weekly feature row; MACD-based columns stay NULL before 35 bars."""
    out = _base(df, by)
    for n in (4, 13, 20):
        out = I.volatility(out, n, 52, "pop", out=f"weekly_volatility_{n}", by=by)
    out = _with_slopes(out, (4, 8, 13, 20), by)
    stable = F.col("_rn") >= MACD_STABLE_ROWS
    cols = _oscillator_features("weekly", stable, (1, 3, 5, 8), (3, 5, 8), (4, 8, 13, 20), by)
    cols |= _candle_features("weekly")
    cols |= {f"weekly_return_{n}": ret("close", n, by) for n in (1, 2, 4, 8, 13, 20)}
    cols |= {f"weekly_ma{n}_distance": change(F.col("close"), I.sma("close", n, partial=False, by=by)) for n in (5, 10, 20, 40)}
    cols |= {f"weekly_volume_change_{n}": _strict_change(n, by) for n in (1, 4, 13)}
    cols |= {f"weekly_volume_zscore_{n}": I.zscore("volume", n, by) for n in (20, 52)}
    cols |= {
        "weekly_atr14_ratio": I.atr(14, by) / F.col("close"),
        "weekly_drawdown_60": I.max_drawdown("close", 60, by=by),
        "weekly_obv_slope_13": I.slope("obv", 13, F.greatest(F.abs("obv"), F.lit(1.0)), by, row="_rn"),
        "weekly_price_volume_correlation_13": I.rolling_corr("_ret", "_vchg", 13, by),
    }
    keep = [*by, "trade_date", "close", *[f"weekly_volatility_{n}" for n in (4, 13, 20)]]
    return out.select(*keep, *[v.alias(k) for k, v in cols.items()])


def features_state(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Weekly state set: returns, mean distances and slopes, stack order, MACD changes, risk, volume, state."""
    out = _base(df, by)
    out = I.dif_regime(out, by)
    out = I.ma_stack(out, by=by)
    for n in (4, 8, 26):
        out = I.volatility(out, n, 52, "pop", out=f"volatility_{n}", by=by)
    out = I.volatility(out, 13, 52, "downside", out="downside_volatility_13", by=by)
    out = market_state(out, by)
    out = I.drawdown_duration(out, by=by)
    out = I.volume_regime(out, by=by)
    stable = F.col("_rn") >= MACD_STABLE_ROWS
    scale = F.col("close")
    w = ordered(by)
    first = lambda c: F.col(c) - F.lag(c).over(w)
    macd_cols = {
        "dif_rel": F.col("dif") / scale,
        "dea_rel": F.col("dea") / scale,
        "hist_rel": F.col("hist") / scale,
        "dif_first_change": first("dif") / scale,
        "dif_second_change": (first("dif") - (F.lag("dif").over(w) - F.lag("dif", 2).over(w))) / scale,
        "dea_first_change": first("dea") / scale,
        "hist_first_change": first("hist") / scale,
        "dif_dea_distance": (F.col("dif") - F.col("dea")) / (F.abs("dif") + F.abs("dea") + 1e-12),
    }
    cols = {f"ret_{n}": ret("close", n, by) for n in (1, 2, 4, 8, 13, 26)}
    cols |= {f"ma{n}_slope": I.slope("close", n, "close", by, row="_rn") for n in (5, 10, 60)}
    cols |= {k: F.when(stable, v) for k, v in macd_cols.items()}
    cols |= {
        "atr_pct": I.atr(14, by) / scale,
        "max_drawdown_60": I.max_drawdown("close", 60, by=by),
        "volume_zscore_20": I.zscore("volume", 20, by),
        "volume_zscore_52": I.zscore("volume", 52, by),
        "volume_change_4": ret("volume", 4, by),
        "volume_change_8": ret("volume", 8, by),
        "obv_slope_13": I.slope("obv", 13, F.greatest(F.abs("obv"), F.lit(1.0)), by, row="_rn"),
        "price_volume_correlation_13": I.rolling_corr("_ret", "_vchg", 13, by),
    }
    keep = [
        *by, "trade_date", "close", "ma5_distance", "ma10_distance", "ma20_distance", "ma60_distance", "ma20_slope", "ma_order", "ma_order_duration",
        "volatility_4", "volatility_8", "volatility_13", "volatility_26", "downside_volatility_13", "from_high", "rebound", "percentile_52",
        "drawdown_duration", "up_down_volume", "breakout_up", "breakout_down", "shrink_rebound", "shrink_pullback",
        "market_state", "market_state_code", "market_state_duration", "dif_regime_length", "golden_cross_count", "death_cross_count",
    ]
    return out.select(*keep, *[v.alias(k) for k, v in cols.items()])


# ---- multi-timeframe ------------------------------------------------------------------

def daily_branch(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    out = I.macd(df, by=by)
    out = I.up_down_runs(out, by=by)
    for n in (5, 10):
        out = I.trend_strength(out, n, by=by, out=f"d_trend_strength_{n}")
    for n in (20, 60):
        out = I.volatility(out, n, 252, "pop", out=f"d_volatility_{n}", by=by)
    stable = F.row_number().over(ordered(by)) >= MACD_STABLE_ROWS
    cols = {f"d_ret_{n}": ret("close", n, by) for n in (1, 3, 5, 10, 20, 60)}
    cols |= {f"d_ma{n}_distance": change(F.col("close"), I.sma("close", n, partial=False, by=by)) for n in (5, 10, 20, 60)}
    cols |= {f"d_ma{n}_slope": I.slope("close", n, "close", by) for n in (5, 10, 20, 60)}
    cols |= {"d_dif": F.when(stable, F.col("dif") / F.col("close")), "d_hist": F.when(stable, F.col("hist") / F.col("close"))}
    cols |= {f"d_{k}": v for k, v in I.range_position(20, by=by).items()}
    keep = [*by, "trade_date", "d_trend_strength_5", "d_trend_strength_10", "d_volatility_20", "d_volatility_60", F.col("up_run").alias("d_up_run"), F.col("down_run").alias("d_down_run")]
    return out.select(*keep, *[v.alias(k) for k, v in cols.items()])


def multi_timeframe(weekly: DataFrame, daily: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Weekly state features with the daily branch known at the week's last session: label and interactions.

    Two labels that no input can reach are left out: they repeat the condition of
    an earlier one.
    """
    join = asof_join(weekly, daily.withColumnRenamed("trade_date", "daily_date"), by, "trade_date", "daily_date", [c for c in daily.columns if c not in (*by, "trade_date")])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    w_bull, w_bear = (z("ma20_distance") > 0) & (z("ma20_slope") > 0), (z("ma20_distance") < 0) & (z("ma20_slope") < 0)
    d_bull, d_bear = (z("d_ma20_distance") > 0) & (z("d_ma20_slope") > 0), (z("d_ma20_distance") < 0) & (z("d_ma20_slope") < 0)
    recovery = (z("d_ret_5") > 0) & (z("d_ma5_distance") > 0)
    state = (
        F.when(d_bull & w_bull, "BOTH_BULLISH")
        .when(d_bear & w_bear, "BOTH_BEARISH")
        .when(d_bull & w_bear, "DAILY_BULLISH_WEEKLY_BEARISH")
        .when(d_bear & w_bull, "WEEKLY_UPTREND_DAILY_PULLBACK")
        .when(recovery & ~w_bull, "DAILY_RECOVERY_WEEKLY_UNCONFIRMED")
        .otherwise("NEUTRAL_MIXED")
    )
    out = join.withColumn("mtf_state", state)
    bull_order = F.when(F.col("ma_order") == 1, 1.0).otherwise(0.0)
    flag = lambda c: c.cast("double")
    return out.withColumns(
        {
            "x_direction_agreement": flag(sign_agree("ret_4", "d_ret_20")),
            "x_macd_agreement": flag(sign_agree("hist_rel", "d_hist")),
            "x_dif_agreement": flag(sign_agree("dif_rel", "d_dif")),
            "x_momentum_gap": z("d_ret_20") - z("ret_4"),
            "x_volatility_ratio": F.coalesce(safe_div(z("d_volatility_20"), F.when(z("volatility_13") > 0, z("volatility_13"))), F.lit(0.0)),
            "x_trend_strength_gap": z("d_trend_strength_10") - bull_order,
            "x_daily_reversal_weekly_weak": flag(F.col("mtf_state") == "DAILY_RECOVERY_WEEKLY_UNCONFIRMED"),
            "x_weekly_bullish_daily_pullback": flag(F.col("mtf_state") == "WEEKLY_UPTREND_DAILY_PULLBACK"),
            "x_weekly_bearish_daily_recovery": flag(w_bear & recovery),
            "x_double_bullish": flag(F.col("mtf_state") == "BOTH_BULLISH"),
            "x_double_bearish": flag(F.col("mtf_state") == "BOTH_BEARISH"),
        }
    )


# ---- snapshot with availability ---------------------------------------------------------

def valuation_at(bars: DataFrame, valuations: DataFrame, by: Sequence[str] = BY, value: str = "pe") -> DataFrame:
    """Latest visible valuation of each bar, its mid-rank percentile (20 observations at least) and their number."""
    ranked = pit.expanding_percentile(valuations, value, "mid", by, min_obs=MIN_VALUATIONS)
    ranked = ranked.withColumn("valuation_count", F.count(value).over(running(by)))
    right = ranked.select(*by, F.col("trade_date").alias("valuation_date"), F.col(value).alias("valuation_value"), F.col(f"{value}_percentile").alias("valuation_percentile"), "valuation_count")
    return asof_join(bars, right, by, "trade_date", "valuation_date", ["valuation_value", "valuation_percentile", "valuation_count"])


def feature_snapshot(weekly: DataFrame, valuations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Weekly indicator record, valuation, volume ratio and cross signal, each with a status."""
    out = I.indicator_set(weekly, "weekly", by=by)
    out = valuation_at(out, valuations, by)
    f = trailing(20, by)
    out = out.withColumns({"_n": F.row_number().over(ordered(by)), "_vn": F.count("volume").over(f), "_vavg": F.avg("volume").over(f)})
    technical = F.when(F.col("_n") >= WARMUP_WEEKS, "available").otherwise("insufficient_warmup")
    valuation = (
        F.when(F.col("valuation_value").isNull(), "missing")
        .when(F.col("valuation_percentile").isNull(), "insufficient_history")
        .otherwise("available")
    )
    volume = F.when(F.col("_vn") < 20, "missing_required_volume").when(F.col("_vavg") == 0, "zero_average").otherwise("available")
    out = out.withColumns({"technical_status": technical, "valuation_status": valuation, "volume_status": volume})
    signal = (
        F.when(F.col("technical_status") != "available", F.col("technical_status"))
        .when(F.col("valuation_status") == "missing", "missing_valuation")
        .when(F.col("valuation_status") != "available", "insufficient_valuation_history")
        .otherwise("available")
    )
    out = out.withColumns({"signal_status": signal, "volume_ratio": F.when(F.col("volume_status") == "available", F.col("volume") / F.col("_vavg"))})
    out = golden_black(out.withColumn("_gate", F.when(F.col("signal_status") == "available", F.col("valuation_percentile"))), "_gate")
    return out.drop("_n", "_vn", "_vavg", "_gate")


def feature_manifest(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Names of a feature table by group (the prefix up to the first underscore), their number, non-null counts and name hash."""
    names = sorted(c for c in df.columns if c not in ids)
    long = df.select(*[F.count(c).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in names]))
    long = long.select(pairs.alias("_p")).select("_p.*").withColumn("grp", F.split_part("name", F.lit("_"), F.lit(1)))
    return long.groupBy("grp").agg(
        F.count("*").alias("features"), F.sum("filled").alias("filled"), F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ","), 256).alias("names_hash")
    )




def missing_columns(df: DataFrame, ids: Sequence[str] = ("symbol", "trade_date", "close")) -> DataFrame:
    """A mask per feature: 1 where it is NULL; NULL itself is never filled in."""
    names = [c for c in df.columns if c not in ids]
    return df.withColumns({f"missing_{c}": F.col(c).isNull().cast("int") for c in names})
