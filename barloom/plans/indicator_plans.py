"""Queries over indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scalar as S
from barloom.operators import indicators as I, panel as P, prices as X
from barloom.plans import views as V
from barloom.plans.registry import REG
from barloom.plans.sqlviews import day, r, with_views

KEY = f"symbol, {day('trade_date')} as trade_date"
O = "window o as (partition by symbol order by trade_date)"


def fr(n: int) -> str:
    return f"(partition by symbol order by trade_date rows between {n - 1} preceding and current row)"


SLOPE = lambda c, n: f"case when count({c}) over {fr(n)} = {n} then regr_slope({c}, rn) over {fr(n)} end"

# Mean-seeded EMA of 12 on weekly closes as a recursion: running mean for the first rows, then smoothing.
MEAN_SEED = """
  select symbol, trade_date, rn, close, close as s, close as e from wn where rn = 1
  union all
  select n.symbol, n.trade_date, n.rn, n.close, e.s + n.close,
    case when n.rn <= 12 then (e.s + n.close) / n.rn else e.e + (n.close - e.e) * 2.0::double / 13 end
  from mean_seed e join wn n on n.symbol = e.symbol and n.rn = e.rn + 1"""

RSI_WILDER = """
  select symbol, trade_date, rn, close, 0.0::double as g, 0.0::double as l from wn where rn = 1
  union all
  select n.symbol, n.trade_date, n.rn, n.close,
    case when n.rn - 1 <= 14 then (e.g * (n.rn - 2) + greatest(n.close - e.close, 0)) / (n.rn - 1) else (e.g * 13 + greatest(n.close - e.close, 0)) / 14 end,
    case when n.rn - 1 <= 14 then (e.l * (n.rn - 2) + greatest(e.close - n.close, 0)) / (n.rn - 1) else (e.l * 13 + greatest(e.close - n.close, 0)) / 14 end
  from rsi_w e join wn n on n.symbol = e.symbol and n.rn = e.rn + 1"""


@REG.add(
    "sma_partial_strict",
    "W-01 W-02",
    with_views(f"select {KEY}, {r(f'avg(close) over {fr(20)}')} as sma_20, {r(f'case when count(close) over {fr(20)} = 20 then avg(close) over {fr(20)} end')} as sma_20_strict, {r(f'avg(case when volume > 20 then volume end) over {fr(5)}')} as volume_ma_5 from d"),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf).withColumn("v", F.when(F.col("volume") > 20, F.col("volume")))
    return d.select("symbol", "trade_date", I.sma("close", 20).alias("sma_20"), I.sma("close", 20, partial=False).alias("sma_20_strict"), I.sma("v", 5).alias("volume_ma_5"))


@REG.add("ema_first_seed", "W-03", with_views(f"select {KEY}, {r('e12')} as ema_12, {r('e26')} as ema_26 from ema_w"))
def _(spark, sf):
    w = I.ema(V.bars_weekly(spark, sf), "close", 12, "ema_12")
    return I.ema(w, "close", 26, "ema_26").select("symbol", "trade_date", "ema_12", "ema_26")


@REG.add("ema_mean_seed", "W-03", with_views(f"select {KEY}, {r('e')} as ema_12 from mean_seed", mean_seed=MEAN_SEED))
def _(spark, sf):
    return I.ema(V.bars_weekly(spark, sf), "close", 12, "ema_12", seed="mean").select("symbol", "trade_date", "ema_12")


@REG.add(
    "ema_null_reset",
    "W-03",
    with_views(
        f"""select {KEY}, case when x is not null then {r('e')} end as ema_5 from nr""",
        xs="select symbol, trade_date, rn, case when day(trade_date) <= 2 then null else close end as x from wn",
        nr="""
  select symbol, trade_date, rn, x, x as e from xs where rn = 1
  union all
  select n.symbol, n.trade_date, n.rn, n.x, case when n.x is null then null when e.e is null then n.x else e.e + (n.x - e.e) / 3.0::double end
  from nr e join xs n on n.symbol = e.symbol and n.rn = e.rn + 1""",
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf).withColumn("x", F.when(F.dayofmonth("trade_date") > 2, F.col("close")))
    return I.ema(w, "x", 5, "ema_5", nullable=True).select("symbol", "trade_date", "ema_5")


@REG.add(
    "macd_weekly",
    "W-04 W-05",
    with_views(
        f"""select {KEY}, {r('dif')} as dif, {r('dea')} as dea, {r('hist')} as hist, {r('dif - lag(dif) over o')} as dif_first_change,
        {r('dif - 2 * lag(dif) over o + lag(dif, 2) over o')} as dif_second_change from macd_w {O}"""
    ),
)
def _(spark, sf):
    m = I.macd(V.bars_weekly(spark, sf))
    m = m.withColumn("dif_first_change", I.diff("dif"))
    return m.select("symbol", "trade_date", "dif", "dea", "hist", "dif_first_change", I.diff("dif_first_change").alias("dif_second_change"))


@REG.add(
    "macd_zero_signal_seed",
    "W-04",
    with_views(
        f"select {KEY}, {r('dif')} as dif, {r('dea0')} as dea from zero_dea",
        zero_dea="""
  select symbol, trade_date, rn, dif, dif * 0.2::double as dea0 from dif_w where rn = 1
  union all
  select n.symbol, n.trade_date, n.rn, n.dif, e.dea0 + (n.dif - e.dea0) * 0.2::double from zero_dea e join dif_w n on n.symbol = e.symbol and n.rn = e.rn + 1""",
    ),
)
def _(spark, sf):
    return I.macd(V.bars_weekly(spark, sf), signal_seed="zero").select("symbol", "trade_date", "dif", "dea")


@REG.add(
    "rsi_wilder",
    "W-06",
    with_views(
        f"""select {KEY}, {r('case when rn = 1 then 50 when l = 0 then case when g > 0 then 100 else 50 end else 100 - 100 / (1 + g / l) end')} as rsi_14 from rsi_w""",
        rsi_w=RSI_WILDER,
    ),
)
def _(spark, sf):
    return I.rsi(V.bars_weekly(spark, sf), 14, "wilder", out="rsi_14").select("symbol", "trade_date", "rsi_14")


@REG.add(
    "rsi_simple",
    "W-07",
    with_views(
        f"""select {KEY}, {r('case when n = 14 then case when l = 0 then case when g > 0 then 100 else 50 end else 100 - 100 / (1 + g / l) end end')} as rsi_14
        from (select symbol, trade_date, avg(greatest(m, 0)) over {fr(14)} as g, avg(greatest(-m, 0)) over {fr(14)} as l, count(m) over {fr(14)} as n
          from (select symbol, trade_date, close - lag(close) over o as m from d {O}))"""
    ),
)
def _(spark, sf):
    return I.rsi(V.bars_daily(spark, sf), 14, "simple", out="rsi_14").select("symbol", "trade_date", "rsi_14")


@REG.add(
    "volatility_kinds",
    "W-08",
    with_views(
        f"""select {KEY}, {r(f'case when count(x) over {fr(13)} < 2 then 0 else stddev_samp(x) over {fr(13)} * sqrt(52) end')} as vol_sample,
          {r(f'case when count(x) over {fr(13)} = 13 then stddev_pop(x) over {fr(13)} * sqrt(52) end')} as vol_pop,
          {r(f'case when count(x) over {fr(13)} = 13 then stddev_pop(ln(1 + x)) over {fr(13)} * sqrt(52) end')} as vol_log,
          {r(f'case when count(x) over {fr(13)} = 13 then coalesce(stddev_pop(case when x < 0 then x end) over {fr(13)}, 0) * sqrt(52) end')} as vol_downside
        from (select symbol, trade_date, close / lag(close) over o - 1 as x from w {O})"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf)
    for kind in ("sample", "pop", "log", "downside"):
        w = I.volatility(w, 13, 52, kind, out=f"vol_{kind}")
    return w.select("symbol", "trade_date", "vol_sample", "vol_pop", "vol_log", "vol_downside")


@REG.add(
    "drawdowns",
    "W-09 W-11",
    with_views(
        f"""select {KEY}, {r('dd')} as current_drawdown, {r('least(0, min(dd) over (partition by symbol order by trade_date))')} as running_drawdown,
          {r('cum')} as cumulative_return, {r('case when rn = 1 then 0 else least(exp(ln(1 + cum) * 52 / (rn - 1)) - 1, 1000) end')} as annualized_return
        from (select symbol, trade_date, rn, close / max(close) over o - 1 as dd, close / first_value(close) over o - 1 as cum from wn {O})"""
    ),
)
def _(spark, sf):
    w = I.returns_since_start(I.drawdown(V.bars_weekly(spark, sf)), 52)
    return w.select("symbol", "trade_date", "current_drawdown", "running_drawdown", "cumulative_return", F.least("annualized_return", F.lit(1000.0)).alias("annualized_return"))


@REG.add(
    "max_drawdown_window",
    "W-10",
    with_views(
        f"""select a.symbol, {day('a.trade_date')} as trade_date, {r('min(p.close / q.peak - 1)')} as max_drawdown_26 from wn a
        join wn p on p.symbol = a.symbol and p.rn between a.rn - 25 and a.rn
        join lateral (select max(z.close) as peak from wn z where z.symbol = a.symbol and z.rn between a.rn - 25 and p.rn) q on true
        where a.rn >= 26 group by a.symbol, a.trade_date"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf).select("symbol", "trade_date", I.max_drawdown("close", 26).alias("max_drawdown_26"))
    return w.where("max_drawdown_26 is not null")


@REG.add(
    "atr_14",
    "W-12",
    with_views(
        f"""select {KEY}, {r(f'case when count(tr) over {fr(14)} = 14 then avg(tr) over {fr(14)} end')} as atr_14
        from (select symbol, trade_date, case when lag(close) over o is not null then greatest(high - low, abs(high - lag(close) over o), abs(low - lag(close) over o)) end as tr from d {O})"""
    ),
)
def _(spark, sf):
    return I.with_true_range(V.bars_daily(spark, sf)).select("symbol", "trade_date", I.atr(14).alias("atr_14"))


@REG.add(
    "linear_slopes",
    "W-13",
    with_views(f"select {KEY}, {r(SLOPE('close', 5) + ' / close')} as slope_5, {r(SLOPE('close', 20) + ' / close')} as slope_20 from dn"),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf)
    return d.select("symbol", "trade_date", I.slope("close", 5, "close").alias("slope_5"), I.slope("close", 20, "close").alias("slope_20"))


# Quadratic fit through the normal equations of the symmetric grid x = -2..2.
_CURV5 = "(2 * lag(close, 4) over o - lag(close, 3) over o - 2 * lag(close, 2) over o - lag(close) over o + 2 * close) / 14"


@REG.add("quadratic_curvature", "W-14", with_views(f"select {KEY}, {r(f'2 * {_CURV5} / close')} as curvature_5 from d {O}"))
def _(spark, sf):
    return V.bars_daily(spark, sf).select("symbol", "trade_date", I.curvature("close", 5, "close").alias("curvature_5"))


_QUAD = f"""select symbol, trade_date, dif, close, {_CURV5.replace('close', 'dif')} as a0,
  (-2 * lag(dif, 4) over o - lag(dif, 3) over o + lag(dif) over o + 2 * dif) / 10 as b0,
  (lag(dif, 4) over o + lag(dif, 3) over o + lag(dif, 2) over o + lag(dif) over o + dif) / 5 as mean0 from macd_w {O}"""


@REG.add(
    "quadratic_turn",
    "W-15",
    with_views(
        f"""select {KEY}, {r('a')} as t5_a, {r('b')} as t5_b, {r('c')} as t5_c, case when a is null then null when abs(a) < 1e-10 then 'flat' when a > 0 then 'bottom' else 'top' end as t5_kind,
          {r('case when -b / (2 * a) between 0 and 100 then -b / (2 * a) end', 4)} as t5_vertex
        from (select symbol, trade_date, a0 / close as a, (b0 + 4 * a0) / close as b, (mean0 - 2 * a0 + 2 * b0 + 4 * a0) / close as c from quad)""",
        quad=_QUAD,
    ),
)
def _(spark, sf):
    q = I.quad_turn(I.macd(V.bars_weekly(spark, sf)), "dif", 5, "close", "t5")
    return q.select("symbol", "trade_date", "t5_a", "t5_b", "t5_c", "t5_kind", S.cut("t5_vertex", 4).alias("t5_vertex"))


@REG.add("turn_consensus", "W-16")
def _(spark, sf):
    m = I.macd(V.bars_weekly(spark, sf))
    for n in (5, 9, 13):
        m = I.quad_turn(m, "dif", n, "close", f"t{n}")
    return m.withColumns(I.turn_consensus(["t5", "t9", "t13"])).select(
        "symbol", "trade_date", "turn_stable", "turn_kind", S.cut("turn_days_ahead", 3).alias("turn_days_ahead"), S.cut("turn_dispersion", 3).alias("turn_dispersion")
    )


def _run(state: str, out: str, src: str) -> str:
    """Gaps and islands: rows since the last change of state."""
    return f"""select *, row_number() over (partition by symbol, isl order by trade_date) as {out} from (
      select *, sum(chg) over (partition by symbol order by trade_date) as isl from (
        select *, case when {state} is not distinct from lag({state}) over (partition by symbol order by trade_date) then 0 else 1 end as chg from ({src})))"""


@REG.add(
    "cross_state_runs",
    "W-17",
    with_views(f"select {KEY}, st::bigint as cross_state, dur as cross_duration from ({_run('st', 'dur', 'select *, case when dif >= dea then 1 else -1 end as st from macd_w')})"),
)
def _(spark, sf):
    return I.cross_state(I.macd(V.bars_weekly(spark, sf))).select("symbol", "trade_date", "cross_state", "cross_duration")


@REG.add(
    "dif_regime_runs",
    "W-18",
    with_views(
        f"""select {KEY}, dur as dif_regime_length, coalesce(sum((pg <= 0 and g > 0)::int) over (partition by symbol order by trade_date), 0)::bigint as golden_cross_count,
          coalesce(sum((pg >= 0 and g < 0)::int) over (partition by symbol order by trade_date), 0)::bigint as death_cross_count
        from ({_run('st', 'dur', "select *, dif - dea as g, lag(dif - dea) over (partition by symbol order by trade_date) as pg, (dif >= 0)::varchar || coalesce(dif > lag(dif) over (partition by symbol order by trade_date), false)::varchar as st from macd_w")})"""
    ),
)
def _(spark, sf):
    return I.dif_regime(I.macd(V.bars_weekly(spark, sf))).select("symbol", "trade_date", "dif_regime_length", "golden_cross_count", "death_cross_count")


@REG.add(
    "price_dif_divergence",
    "W-20",
    with_views(
        f"""select {KEY}, {r('case when sp * so < 0 then -least(abs(sp - so), 1) when sp is not null then least(abs(sp - so), 1) end')} as divergence_8
        from (select symbol, trade_date, {SLOPE('close', 8)} / close as sp, {SLOPE('dif', 8)} / close as so from macd_w)"""
    ),
)
def _(spark, sf):
    return I.macd(V.bars_weekly(spark, sf)).select("symbol", "trade_date", I.divergence("close", "dif", 8).alias("divergence_8"))


@REG.add(
    "on_balance_volume",
    "W-21",
    with_views(f"select {KEY}, {r('sum(s) over (partition by symbol order by trade_date)')} as obv from (select symbol, trade_date, coalesce(sign(close - lag(close) over o) * volume, 0) as s from d {O})"),
)
def _(spark, sf):
    return I.obv(V.bars_daily(spark, sf)).select("symbol", "trade_date", "obv")


@REG.add(
    "volume_zscore_ratio",
    "W-22 W-24",
    with_views(
        f"""select {KEY}, {r(f'case when count(volume) over {fr(20)} = 20 and stddev_pop(volume) over {fr(20)} <> 0 then (volume - avg(volume) over {fr(20)}) / stddev_pop(volume) over {fr(20)} end')} as zscore_20,
        {r(f'case when count(volume) over {fr(5)} = 5 then volume / avg(volume) over {fr(5)} end')} as ratio_5 from d"""
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf)
    return d.select("symbol", "trade_date", I.zscore("volume", 20).alias("zscore_20"), I.volume_ratio(5).alias("ratio_5"))


@REG.add(
    "price_volume_correlation",
    "W-23",
    with_views(
        f"""select {KEY}, {r(f'case when count(case when a is not null and b is not null then 1 end) over {fr(20)} = 20 then corr(a, b) over {fr(20)} end')} as corr_20
        from (select symbol, trade_date, close / lag(close) over o - 1 as a, volume / lag(volume) over o - 1 as b from d {O})"""
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf).withColumns({"a": X.ret("close"), "b": X.ret("volume")})
    return d.select("symbol", "trade_date", I.rolling_corr("a", "b", 20).alias("corr_20"))


@REG.add(
    "volume_block_ratio",
    "W-25",
    with_views(
        f"""select {KEY}, {r(f'case when rn >= 13 then avg(volume) over {fr(4)} / avg(volume) over (partition by symbol order by trade_date rows between 12 preceding and 4 preceding) end')} as ratio_4_13,
        {r('volume / lag(volume, 4) over (partition by symbol order by trade_date) - 1')} as change_4 from wn"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf)
    return w.select("symbol", "trade_date", I.volume_ratio_blocks(4, 13).alias("ratio_4_13"), X.ret("volume", 4).alias("change_4"))


@REG.add(
    "volume_regime",
    "W-26",
    with_views(
        f"""select {KEY}, case when rn >= 14 then {r('(up - down) / med')} end as up_down_volume,
          case when rn >= 14 then (z > 1 and x > 0)::bigint end as breakout_up, case when rn >= 14 then (z > 1 and x < 0)::bigint end as breakout_down,
          case when rn >= 14 then (z < -0.5 and x > 0)::bigint end as shrink_rebound, case when rn >= 14 then (z < -0.5 and x < 0)::bigint end as shrink_pullback
        from (select *, avg(case when x > 0 then volume end) over {fr(13)} as up, avg(case when x < 0 then volume end) over {fr(13)} as down,
            quantile_cont(volume, 0.5) over {fr(14)} as med, coalesce((volume - avg(volume) over {fr(13)}) / nullif(stddev_pop(volume) over {fr(13)}, 0), 0) as z
          from (select *, close / lag(close) over o - 1 as x from wn {O}))"""
    ),
)
def _(spark, sf):
    return I.volume_regime(V.bars_weekly(spark, sf)).select("symbol", "trade_date", "up_down_volume", "breakout_up", "breakout_down", "shrink_rebound", "shrink_pullback")


_STACK = "select *, " + ", ".join(f"case when rn >= {n} then avg(close) over {fr(n)} end as ma{n}" for n in (5, 10, 20, 60)) + " from wn"


@REG.add(
    "ma_stack",
    "W-27",
    with_views(
        f"""select {KEY}, {r('close / ma20 - 1')} as ma20_distance, {r('close / ma60 - 1')} as ma60_distance, st::bigint as ma_order, (case when st <> 0 then dur - 1 else 0 end)::bigint as ma_order_duration
        from ({_run('st', 'dur', f'select *, case when ma5 > ma10 and ma10 > ma20 and ma20 > ma60 then 1 when ma5 < ma10 and ma10 < ma20 and ma20 < ma60 then -1 else 0 end as st from ({_STACK})')})"""
    ),
)
def _(spark, sf):
    return I.ma_stack(V.bars_weekly(spark, sf)).select("symbol", "trade_date", "ma20_distance", "ma60_distance", "ma_order", "ma_order_duration")


@REG.add(
    "range_statistics",
    "W-28 W-29",
    with_views(
        f"""select {KEY}, {r('close / min(close) over (partition by symbol order by trade_date rows between unbounded preceding and 1 preceding) - 1')} as rebound,
          {r('close / max(close) over (partition by symbol order by trade_date) - 1')} as from_high,
          case when rn >= 2 then {r(f'(select count(*) from wn z where z.symbol = wn.symbol and z.rn between wn.rn - 51 and wn.rn and z.close <= wn.close) / least(rn, 52)')} end as percentile_52,
          case when rn >= 20 then {r(f'close / max(close) over {fr(20)} - 1')} end as from_high_20, case when rn >= 20 then {r(f'close / min(close) over {fr(20)} - 1')} end as from_low_20,
          case when rn >= 20 then {r(f'coalesce((close - min(close) over {fr(20)}) / nullif(max(close) over {fr(20)} - min(close) over {fr(20)}, 0), 0.5)')} end as position_20
        from wn"""
    ),
)
def _(spark, sf):
    w = I.range_stats(V.bars_weekly(spark, sf)).withColumns(I.range_position(20))
    return w.select("symbol", "trade_date", "rebound", "from_high", "percentile_52", "from_high_20", "from_low_20", "position_20")


@REG.add(
    "drawdown_durations",
    "W-30",
    with_views(
        f"""select {KEY}, max(case when close < hi then dur else 0 end) over (partition by symbol order by trade_date)::bigint as drawdown_duration
        from ({_run('st', 'dur', 'select *, close >= hi as st from (select *, max(close) over (partition by symbol order by trade_date) as hi from w)')})"""
    ),
)
def _(spark, sf):
    return I.drawdown_duration(V.bars_weekly(spark, sf)).select("symbol", "trade_date", "drawdown_duration")


@REG.add(
    "up_down_runs",
    "W-31 W-32",
    with_views(
        f"""select {KEY}, (case when st > 0 then dur else 0 end)::bigint as up_run, (case when st < 0 then dur else 0 end)::bigint as down_run,
          case when rn > 10 then {r(f'avg(st) over {fr(10)}')} end as trend_strength_10
        from ({_run('st', 'dur', 'select *, sign(close - lag(close) over (partition by symbol order by trade_date)) as st from dn')})"""
    ),
)
def _(spark, sf):
    d = I.trend_strength(I.up_down_runs(V.bars_daily(spark, sf)), 10)
    return d.select("symbol", "trade_date", "up_run", "down_run", "trend_strength_10")


@REG.add(
    "weekly_indicator_snapshot",
    "A-19 W-47 K-01",
    with_views(
        f"""select {KEY}, {r('close')} as close, {r('ma20')} as ma_20, {r('dif')} as dif, {r('dea')} as dea, {r('hist')} as hist, {r('dd')} as current_drawdown,
          case when dif > dea and close > ma20 then 'UP' when dif < dea and close < ma20 then 'DOWN' else 'MIXED' end as trend
        from (select *, avg(close) over {fr(20)} as ma20, close / max(close) over (partition by symbol order by trade_date) - 1 as dd from macd_w)
        qualify row_number() over (partition by symbol order by trade_date desc) = 1"""
    ),
)
def _(spark, sf):
    w = I.drawdown(I.macd(V.bars_weekly(spark, sf))).withColumn("ma_20", I.sma("close", 20))
    trend = F.when((F.col("dif") > F.col("dea")) & (F.col("close") > F.col("ma_20")), "UP").when(
        (F.col("dif") < F.col("dea")) & (F.col("close") < F.col("ma_20")), "DOWN"
    )
    w = P.last_n(w, 1)
    return w.select("symbol", "trade_date", "close", "ma_20", "dif", "dea", "hist", "current_drawdown", F.coalesce(trend, F.lit("MIXED")).alias("trend"))
