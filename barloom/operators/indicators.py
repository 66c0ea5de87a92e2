"""Technical indicators over bar series.

Every operator adds columns to a bar DataFrame with windows partitioned by the
series key and ordered by date, so a chain of them costs one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalar import as_col, change, safe_div
from barloom.operators.panel import BY, T, before, ordered, run_length, running, trailing
from barloom.operators.prices import ret

# Annual periods per timeframe.
PERIODS = {"daily": 252, "weekly": 52, "monthly": 12}


# ---- recursive filters ------------------------------------------------------

def _block_rows(decay: float) -> int:
    """Block length with decay**length near 1e-60: no overflow inside a block and
    nothing representable left of the block before the previous one."""
    return max(2, int(138.0 / -math.log(decay)))


def ema(
    df: DataFrame,
    c: str,
    n: int,
    out: str,
    seed: str = "first",
    alpha: float | None = None,
    nullable: bool = False,
    by: Sequence[str] = BY,
    t: str = T,
) -> DataFrame:
    """Exponential moving average as window sums.

    With d = 1 - alpha the recursion unrolls to d^k * sum(alpha * x_i * d^-i).
    The sum runs inside blocks of rows so that d^-i stays finite; what the
    previous block carries over is its last value times d^(position + 1).

    seed: ``first`` starts at the first value, ``mean`` averages the first n rows
    and starts from their mean, ``zero`` starts from a state of 0.
    nullable: a NULL ends the series; the next value starts a new one.
    """
    a = 2.0 / (n + 1.0) if alpha is None else alpha
    d = 1.0 - a
    size = _block_rows(d)
    x = F.col(c).cast("double")
    keys = list(by)
    work = df
    if nullable:
        work = work.withColumn("_isl", F.count_if(x.isNull()).over(running(by, t)))
        keys = [*by, "_isl"]
        work = work.withColumn("_k", F.count(x).over(running(keys, t)) - 1)
    else:
        work = work.withColumn("_k", F.row_number().over(ordered(keys, t)) - 1)
    start = n - 1 if seed == "mean" else 0
    if seed == "mean":
        work = work.withColumn("_avg", F.avg(x).over(trailing(n, keys, t)))
        term = F.when(F.col("_k") == start, F.col("_avg")).when(F.col("_k") > start, a * x)
    elif seed == "first":
        term = F.when(F.col("_k") == 0, x).otherwise(a * x)
    elif seed == "zero":
        term = a * x
    else:
        raise ValueError(f"unknown seed {seed!r}")
    offset = F.col("_k") - start
    work = work.withColumns({"_term": term, "_blk": F.floor(offset / size), "_pos": F.pmod(offset, F.lit(size))})
    inside = running([*keys, "_blk"], t)
    decay_pos = F.pow(F.lit(d), F.col("_pos"))
    work = work.withColumn("_loc", decay_pos * F.sum(F.col("_term") / decay_pos).over(inside))
    ends = F.last(F.when(F.col("_pos") == size - 1, F.col("_loc")), ignorenulls=True).over(before(keys, t))
    work = work.withColumn("_carry", F.when(F.col("_blk") > 0, F.coalesce(ends, F.lit(0.0))).otherwise(0.0))
    value = F.col("_loc") + decay_pos * d * F.col("_carry")
    if seed == "mean":
        value = F.when(F.col("_k") < start, F.col("_avg")).otherwise(value)
    if nullable:
        value = F.when(x.isNotNull(), value)
    return work.withColumn(out, value).drop("_isl", "_k", "_avg", "_term", "_blk", "_pos", "_loc", "_carry")


def macd(
    df: DataFrame,
    c: str = "close",
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    multiplier: float = 2.0,
    seed: str = "first",
    signal_seed: str | None = None,
    prefix: str = "",
    by: Sequence[str] = BY,
    t: str = T,
) -> DataFrame:
    """dif, dea and histogram = multiplier * (dif - dea)."""
    dif, dea = f"{prefix}dif", f"{prefix}dea"
    out = ema(df, c, fast, "_fast", seed, by=by, t=t)
    out = ema(out, c, slow, "_slow", seed, by=by, t=t)
    out = out.withColumn(dif, F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = ema(out, dif, signal, dea, signal_seed or seed, by=by, t=t)
    return out.withColumn(f"{prefix}hist", multiplier * (F.col(dif) - F.col(dea)))


def _rsi_value(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100.0 - 100.0 / (1.0 + gain / loss))


def rsi(df: DataFrame, n: int = 14, kind: str = "wilder", c: str = "close", out: str = "rsi", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """``wilder``: running mean of the first n moves, then smoothing by 1/n; 50 on the first row.
    ``simple``: plain mean of the last n moves; NULL before n of them exist."""
    w = ordered(by, t)
    move = F.col(c) - F.lag(c).over(w)
    if kind == "simple":
        work = df.withColumn("_m", move)
        f = trailing(n, by, t)
        gain, loss = F.avg(F.greatest("_m", F.lit(0.0))).over(f), F.avg(F.greatest(-F.col("_m"), F.lit(0.0))).over(f)
        # greatest() skips NULL, so the first row needs the explicit count guard.
        return work.withColumn(out, F.when(F.count("_m").over(f) == n, _rsi_value(gain, loss))).drop("_m")
    work = df.withColumn("_m", move).withColumns(
        {
            "_g": F.when(F.col("_m").isNotNull(), F.greatest("_m", F.lit(0.0))),
            "_l": F.when(F.col("_m").isNotNull(), F.greatest(-F.col("_m"), F.lit(0.0))),
        }
    )
    work = ema(work, "_g", n, "_ag", "mean", alpha=1.0 / n, nullable=True, by=by, t=t)
    work = ema(work, "_l", n, "_al", "mean", alpha=1.0 / n, nullable=True, by=by, t=t)
    value = F.when(F.col("_m").isNull(), 50.0).otherwise(_rsi_value(F.col("_ag"), F.col("_al")))
    return work.withColumn(out, value).drop("_m", "_g", "_l", "_ag", "_al")


# ---- moving statistics ------------------------------------------------------

def sma(c, n: int, partial: bool = True, by: Sequence[str] = BY, t: str = T) -> Column:
    """Mean of the last n rows; NULLs are skipped. ``partial=False`` needs n values."""
    f = trailing(n, by, t)
    mean = F.avg(as_col(c)).over(f)
    return mean if partial else F.when(F.count(as_col(c)).over(f) == n, mean)


def diff(c, k: int = 1, by: Sequence[str] = BY, t: str = T) -> Column:
    return as_col(c) - F.lag(as_col(c), k).over(ordered(by, t))


def volatility(
    df: DataFrame, n: int, periods: int, kind: str = "pop", c: str = "close", out: str = "volatility",
    by: Sequence[str] = BY, t: str = T,
) -> DataFrame:
    """Annualised volatility of the last n returns.

    ``sample``: n-1 deviation of the returns inside the last n rows, 0 below two returns.
    ``pop``: population deviation, NULL before n returns. ``log``: the same on log returns.
    ``downside``: population deviation of the negative ones, 0 when there is none.
    """
    base = F.lag(c).over(ordered(by, t))
    r = safe_div(F.col(c), base)
    work = df.withColumn("_r", F.log(r) if kind == "log" else r - 1)
    scale = math.sqrt(periods)
    f = trailing(n, by, t)
    if kind == "sample":
        value = F.when(F.count("_r").over(f) < 2, 0.0).otherwise(F.stddev_samp("_r").over(f) * scale)
    else:
        picked = F.when(F.col("_r") < 0, F.col("_r")) if kind == "downside" else F.col("_r")
        dev = F.coalesce(F.stddev_pop(picked).over(f), F.lit(0.0)) if kind == "downside" else F.stddev_pop(picked).over(f)
        value = F.when(F.count("_r").over(f) == n, dev * scale)
    return work.withColumn(out, value).drop("_r")


def drawdown(df: DataFrame, c: str = "close", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Current drawdown from the running high and the worst one so far."""
    w = running(by, t)
    out = df.withColumn("current_drawdown", F.col(c) / F.max(c).over(w) - 1)
    return out.withColumn("running_drawdown", F.least(F.lit(0.0), F.min("current_drawdown").over(w)))


def fold_drawdown(values: Column) -> Column:
    """Worst drop from the running peak of an array, as a value <= 0."""
    state = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, v):
        peak = F.greatest(acc["peak"], v)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], F.when(peak != 0, v / peak - 1).otherwise(0.0)).alias("worst"))

    return F.aggregate(values, state, step, lambda acc: acc["worst"])


def max_drawdown(c: str, n: int, strict: bool = True, by: Sequence[str] = BY, t: str = T) -> Column:
    """Worst drawdown inside the last n rows; the frame array holds n values at most."""
    f = trailing(n, by, t)
    value = fold_drawdown(F.collect_list(F.col(c).cast("double")).over(f))
    return F.when(F.count(c).over(f) == n, value) if strict else value


def returns_since_start(df: DataFrame, periods: int, c: str = "close", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    w = running(by, t)
    out = df.withColumn("cumulative_return", F.col(c) / F.first(c).over(w) - 1).withColumn("_k", F.row_number().over(ordered(by, t)) - 1)
    annual = F.when(F.col("_k") == 0, 0.0).otherwise(F.exp(F.log1p("cumulative_return") * periods / F.col("_k")) - 1)
    return out.withColumn("annualized_return", annual).drop("_k")


def atr(n: int = 14, by: Sequence[str] = BY, t: str = T) -> Column:
    """Mean true range of the last n rows that have a previous close.

    A window over a window is not allowed in one expression, so add
    ``true_range`` first (see :func:`with_true_range`)."""
    f = trailing(n, by, t)
    return F.when(F.count("true_range").over(f) == n, F.avg("true_range").over(f))


def with_true_range(df: DataFrame, by: Sequence[str] = BY, t: str = T) -> DataFrame:
    prev = F.lag("close").over(ordered(by, t))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return df.withColumn("true_range", F.when(prev.isNotNull(), tr))


# ---- local fits -------------------------------------------------------------

def _over(by, t, n: int) -> str:
    keys = ", ".join(f"`{k}`" for k in by)
    order = ", ".join(f"`{k}`" for k in ([t] if isinstance(t, str) else t))
    return f"over (partition by {keys} order by {order} rows between {n - 1} preceding and current row)"


def _fixed_fit(c: str, weights: Sequence[float], by, t) -> Column:
    """Dot product of the last len(weights) values with constant weights, NULL while one is missing.

    Short fits are a handful of lags; long ones fold the frame array, which holds
    len(weights) values, so that the plan does not grow with the window. Written
    as one SQL expression: hundreds of such columns make up a feature row.
    """
    n = len(weights)
    frame = _over(by, t, n)
    if n > 8:
        grid = ", ".join(f"{w!r}D" for w in weights)
        dot = f"aggregate(zip_with(collect_list(`{c}`) {frame}, array({grid}), (x, w) -> x * w), 0D, (acc, x) -> acc + x)"
    else:
        order = frame[: frame.index(" rows")] + ")"
        dot = " + ".join(f"({w!r}D) * lag(`{c}`, {n - 1 - i}) {order}" for i, w in enumerate(weights))
    return F.expr(f"case when count(`{c}`) {frame} = {n} then {dot} end")


def _scaled(value: Column, scale) -> Column:
    return value if scale is None else value / F.greatest(F.abs(as_col(scale)), F.lit(1e-12))


def slope(c: str, n: int, scale=None, by: Sequence[str] = BY, t: str = T, row: str | None = None) -> Column:
    """Least-squares slope of the last n rows per step, over |scale|.

    The grid is fixed, so the slope is a constant-weight sum of the rows:
    weight_i = (i - mean) / sum((i - mean)^2). With ``row`` naming a row-number
    column, long windows use the built-in regression instead of an array fold.
    """
    if row is not None and n > 8:
        frame = _over(by, t, n)
        return _scaled(F.expr(f"case when count(`{c}`) {frame} = {n} then regr_slope(`{c}`, `{row}`) {frame} end"), scale)
    mean = (n - 1) / 2.0
    norm = sum((i - mean) ** 2 for i in range(n))
    return _scaled(_fixed_fit(c, [(i - mean) / norm for i in range(n)], by, t), scale)


def _quadratic_weights(n: int) -> tuple[list[float], list[float], list[float]]:
    """Rows of the least-squares pseudo-inverse for a*x^2 + b*x + c at x = -n+1 .. 0."""
    import numpy as np

    x = np.arange(-n + 1, 1, dtype=float)
    pinv = np.linalg.pinv(np.vander(x, 3))
    return tuple(list(map(float, row)) for row in pinv)


def curvature(c: str, n: int, scale=None, by: Sequence[str] = BY, t: str = T) -> Column:
    """Second derivative 2a of the quadratic fit to the last n rows, over |scale|."""
    a, _, _ = _quadratic_weights(n)
    return _scaled(_fixed_fit(c, [2.0 * w for w in a], by, t), scale)


def quad_turn(df: DataFrame, c: str, n: int, scale: str, prefix: str, by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Quadratic fit with x = 0 at the latest row: coefficients, vertex ahead, first axis crossing, kind.

    The vertex and the crossing are reported only inside [0, 100] steps ahead.
    """
    wa, wb, wc = _quadratic_weights(n)
    unit = F.greatest(F.abs(F.col(scale)), F.lit(1e-12))
    out = df.withColumns(
        {f"{prefix}_{k}": _fixed_fit(c, wts, by, t) / unit for k, wts in zip("abc", (wa, wb, wc))}
    )
    a, b, cc = (F.col(f"{prefix}_{k}") for k in "abc")
    curved = F.abs(a) >= 1e-10
    vertex = F.when(curved, -b / F.when(curved, 2 * a))
    disc = b * b - 4 * a * cc
    root = F.sqrt(F.when(disc >= 0, disc))
    safe_a = F.when(curved, a)
    r1, r2 = (-b - root) / (2 * safe_a), (-b + root) / (2 * safe_a)
    linear = F.when(F.abs(b) >= 1e-10, -cc / F.when(F.abs(b) >= 1e-10, b))
    ahead = lambda r: F.when(r.between(0.0, 100.0), r)
    axis = F.when(curved, F.least(ahead(r1), ahead(r2))).otherwise(ahead(linear))
    return out.withColumns(
        {
            f"{prefix}_vertex": F.when(vertex.between(0.0, 100.0), vertex),
            f"{prefix}_axis": axis,
            f"{prefix}_kind": F.when(a.isNull(), None).when(~curved, "flat").when(a > 0, "bottom").otherwise("top"),
            f"{prefix}_second": 2 * a,
        }
    )


def turn_consensus(prefixes: Sequence[str], max_dispersion: float = 5.0) -> dict[str, Column]:
    """Agreement of several quadratic fits: same kind, vertex days within a population deviation."""
    fits = F.filter(
        F.array(*[F.struct(F.col(f"{p}_vertex").alias("d"), F.col(f"{p}_kind").alias("k")) for p in prefixes]),
        lambda f: f["d"].isNotNull() & (f["k"] != "flat"),
    )
    days = F.transform(fits, lambda f: f["d"])
    n = F.size(fits)
    mean = F.when(n > 0, F.aggregate(days, F.lit(0.0), lambda s, d: s + d) / F.when(n > 0, n))
    var = F.aggregate(days, F.lit(0.0), lambda s, d: s + (d - mean) * (d - mean))
    dispersion = F.when(n >= 2, F.sqrt(var / F.when(n >= 2, n)))
    one_kind = F.size(F.array_distinct(F.transform(fits, lambda f: f["k"]))) == 1
    stable = (n > 0) & one_kind & (dispersion.isNull() | (dispersion <= max_dispersion))
    return {
        "turn_stable": stable,
        "turn_kind": F.when(stable, F.try_element_at(fits, F.lit(1))["k"]).otherwise("unstable"),
        "turn_days_ahead": F.when(stable, mean),
        "turn_dispersion": dispersion,
    }


# ---- crosses, divergence, volume -------------------------------------------

def cross_state(df: DataFrame, a: str = "dif", b: str = "dea", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """+1 while a >= b, else -1, with the length of that state so far."""
    out = df.withColumn("cross_state", F.when(F.col(a) >= F.col(b), 1).otherwise(-1))
    return run_length(out, F.col("cross_state"), "cross_duration", by, t)


def dif_regime(df: DataFrame, by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Run of the same (sign of dif, rising or not), and crosses of dif over dea so far.

    The crosses are counts and are named as such.
    """
    w = ordered(by, t)
    rising = F.coalesce(F.col("dif") > F.lag("dif").over(w), F.lit(False))
    gap, prev_gap = F.col("dif") - F.col("dea"), F.lag(F.col("dif") - F.col("dea")).over(w)
    out = df.withColumns(
        {
            "_reg": F.concat((F.col("dif") >= 0).cast("string"), rising.cast("string")),
            "_gold": ((prev_gap <= 0) & (gap > 0)).cast("int"),
            "_death": ((prev_gap >= 0) & (gap < 0)).cast("int"),
        }
    )
    out = run_length(out, F.col("_reg"), "dif_regime_length", by, t)
    return out.withColumns(
        {
            "golden_cross_count": F.coalesce(F.sum("_gold").over(running(by, t)), F.lit(0)),
            "death_cross_count": F.coalesce(F.sum("_death").over(running(by, t)), F.lit(0)),
        }
    ).drop("_reg", "_gold", "_death")


def slope_gap(sp: Column, so: Column) -> Column:
    """Gap of two slopes, capped at 1 and negative when they point apart."""
    size = F.when(sp.isNotNull() & so.isNotNull(), F.least(F.abs(sp - so), F.lit(1.0)))
    return F.when(sp * so < 0, -size).otherwise(size)


def divergence(p: str, o: str, n: int, by: Sequence[str] = BY, t: str = T) -> Column:
    """Gap of price and oscillator slope over the last n rows, both relative to the price."""
    return slope_gap(slope(p, n, p, by, t), slope(o, n, p, by, t))


def obv(df: DataFrame, by: Sequence[str] = BY, t: str = T, out: str = "obv") -> DataFrame:
    step = F.signum(F.col("close") - F.lag("close").over(ordered(by, t))) * F.coalesce("volume", F.lit(0.0))
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("_step").over(running(by, t))).drop("_step")


def zscore(c: str, n: int, by: Sequence[str] = BY, t: str = T) -> Column:
    f = trailing(n, by, t)
    dev = F.stddev_pop(c).over(f)
    return F.when((F.count(c).over(f) == n) & (dev != 0), (F.col(c) - F.avg(c).over(f)) / F.when(dev != 0, dev))


def rolling_corr(a: str, b: str, n: int, by: Sequence[str] = BY, t: str = T) -> Column:
    """Pearson correlation over exactly n complete pairs, NULL for a constant side."""
    f = trailing(n, by, t)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    flat = (F.stddev_pop(a).over(f) == 0) | (F.stddev_pop(b).over(f) == 0)
    return F.when((F.count(F.when(both, 1)).over(f) == n) & ~flat, F.corr(a, b).over(f))


def volume_ratio(n: int, c: str = "volume", strict: bool = True, by: Sequence[str] = BY, t: str = T) -> Column:
    f = trailing(n, by, t)
    ratio = safe_div(F.col(c), F.avg(c).over(f))
    return F.when(F.count(c).over(f) == n, ratio) if strict else ratio


def volume_ratio_blocks(recent: int, total: int, c: str = "volume", by: Sequence[str] = BY, t: str = T) -> Column:
    """Mean of the last ``recent`` rows over the mean of the rows before them, up to ``total`` back."""
    near, far = trailing(recent, by, t), ordered(by, t).rowsBetween(-(total - 1), -recent)
    ready = F.count(c).over(trailing(total, by, t)) == total
    return F.when(ready, F.avg(c).over(near) / F.greatest(F.avg(c).over(far), F.lit(1e-12)))


def volume_regime(df: DataFrame, n: int = 13, by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Up/down volume gap over the median volume; breakout and shrink flags from the volume z-score."""
    f, fz = trailing(n + 1, by, t), trailing(n, by, t)
    work = df.withColumn("_vr", ret("close", 1, by, t))
    # The frame has n+1 rows, its first return lies before it: the rows 2..n+1 are the last n.
    ready = F.count("volume").over(f) == n + 1
    median = F.expr(
        f"percentile(volume, 0.5) over (partition by {', '.join(by)} order by {t} rows between {n} preceding and current row)"
    )
    up = F.avg(F.when(F.col("_vr") > 0, F.col("volume"))).over(fz)
    down = F.avg(F.when(F.col("_vr") < 0, F.col("volume"))).over(fz)
    work = work.withColumns({"_z": zscore("volume", n, by, t), "_med": median, "_ready": ready, "_gap": up - down})
    flag = lambda cond: F.when(F.col("_ready"), F.coalesce(cond, F.lit(False)).cast("int"))
    return work.withColumns(
        {
            "up_down_volume": F.when(F.col("_ready") & (F.col("_med") > 0), F.col("_gap") / F.when(F.col("_med") > 0, F.col("_med"))),
            "breakout_up": flag((F.col("_z") > 1.0) & (F.col("_vr") > 0)),
            "breakout_down": flag((F.col("_z") > 1.0) & (F.col("_vr") < 0)),
            "shrink_rebound": flag((F.col("_z") < -0.5) & (F.col("_vr") > 0)),
            "shrink_pullback": flag((F.col("_z") < -0.5) & (F.col("_vr") < 0)),
        }
    ).drop("_vr", "_z", "_med", "_ready", "_gap")


# ---- position of the price --------------------------------------------------

def ma_stack(df: DataFrame, spans: Sequence[int] = (5, 10, 20, 60), c: str = "close", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Distance to each full-window mean, bull/bear order of the means, and how long the order already held.

    The duration counts the rows before the current one with the same order.
    """
    work = df.withColumns({f"ma{n}": sma(c, n, partial=False, by=by, t=t) for n in spans})
    work = work.withColumns({f"ma{n}_distance": change(F.col(c), F.col(f"ma{n}")) for n in spans})
    bull, bear = F.lit(True), F.lit(True)
    for a, b in zip(spans, spans[1:]):
        bull, bear = bull & (F.col(f"ma{a}") > F.col(f"ma{b}")), bear & (F.col(f"ma{a}") < F.col(f"ma{b}"))
    work = work.withColumn("ma_order", F.when(bull, 1).when(bear, -1).otherwise(0))
    work = run_length(work, F.col("ma_order"), "_run", by, t)
    return work.withColumn("ma_order_duration", F.when(F.col("ma_order") != 0, F.col("_run") - 1).otherwise(0)).drop("_run")


def range_stats(df: DataFrame, c: str = "close", n: int = 52, by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Rebound from the lowest earlier value, distance from the running high, share of the last n rows <= now."""
    low = F.min(c).over(before(by, t))
    frame = F.collect_list(F.col(c)).over(trailing(n, by, t))
    share = F.size(F.filter("_frame", lambda v: v <= F.col(c))) / F.size("_frame")
    return (
        df.withColumns({"rebound": F.when(low > 0, F.col(c) / low - 1), "from_high": F.col(c) / F.max(c).over(running(by, t)) - 1, "_frame": frame})
        .withColumn(f"percentile_{n}", F.when(F.size("_frame") >= 2, share))
        .drop("_frame")
    )


def range_position(n: int, c: str = "close", by: Sequence[str] = BY, t: str = T) -> dict[str, Column]:
    f = trailing(n, by, t)
    hi, lo, ready = F.max(c).over(f), F.min(c).over(f), F.count(c).over(f) == n
    return {
        f"from_high_{n}": F.when(ready, F.col(c) / hi - 1),
        f"from_low_{n}": F.when(ready & (lo > 0), F.col(c) / lo - 1),
        f"position_{n}": F.when(ready, F.when(hi > lo, (F.col(c) - lo) / F.when(hi > lo, hi - lo)).otherwise(0.5)),
    }


def drawdown_duration(df: DataFrame, c: str = "close", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Longest stretch below the running high up to each row."""
    work = df.withColumn("_high", F.max(c).over(running(by, t)))
    work = run_length(work, F.col(c) >= F.col("_high"), "_run", by, t)
    below = F.when(F.col(c) < F.col("_high"), F.col("_run")).otherwise(0)
    return work.withColumn("_below", below).withColumn("drawdown_duration", F.max("_below").over(running(by, t))).drop("_high", "_run", "_below")


def up_down_runs(df: DataFrame, c: str = "close", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Consecutive rises and consecutive falls ending at the row."""
    move = F.signum(F.col(c) - F.lag(c).over(ordered(by, t)))
    work = run_length(df.withColumn("_s", move), F.col("_s"), "_run", by, t)
    return work.withColumns(
        {
            "up_run": F.when(F.col("_s") > 0, F.col("_run")).otherwise(0),
            "down_run": F.when(F.col("_s") < 0, F.col("_run")).otherwise(0),
        }
    ).drop("_s", "_run")


def trend_strength(df: DataFrame, n: int, c: str = "close", out: str | None = None, by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """(rises - falls) / n over the last n moves."""
    out = out or f"trend_strength_{n}"
    f = trailing(n, by, t)
    work = df.withColumn("_s", F.signum(F.col(c) - F.lag(c).over(ordered(by, t))))
    return work.withColumn(out, F.when(F.count("_s").over(f) == n, F.avg("_s").over(f))).drop("_s")


def indicator_set(df: DataFrame, timeframe: str, by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """The standard indicator record of a timeframe in one pass over the series."""
    periods = PERIODS[timeframe]
    out = macd(df, seed="mean", by=by, t=t)
    out = out.withColumn("dif_first_change", diff("dif", 1, by, t))
    out = rsi(out, 6, "wilder", out="rsi_6", by=by, t=t)
    out = rsi(out, 12, "wilder", out="rsi_12", by=by, t=t)
    out = rsi(out, 24, "wilder", out="rsi_24", by=by, t=t)
    out = volatility(out, 20, periods, "sample", out="volatility_20", by=by, t=t)
    out = drawdown(out, by=by, t=t)
    out = returns_since_start(out, periods, by=by, t=t)
    return out.withColumns({**{f"ma_{n}": sma("close", n, by=by, t=t) for n in (5, 10, 20, 60)}, "volume_ma_20": sma("volume", 20, by=by, t=t)})
