"""Queries over feature sets, signals and turning points."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import features as FE, indicators as I, panel as P, pit, turns as TU
from barloom.plans import views as V
from barloom.plans.indicator_plans import SLOPE, fr
from barloom.plans.registry import REG
from barloom.plans.sqlviews import day, r, with_views

KEY = f"symbol, {day('trade_date')} as trade_date"
OW = "(partition by symbol order by trade_date)"


# ---- SQL for the feature groups ---------------------------------------------------------

def _curv(c: str, n: int) -> str:
    """Second derivative of the quadratic fit by orthogonal polynomials on 0..n-1."""
    mid, shift = (n - 1) / 2, (n * n - 1) / 12
    wts = [(i - mid) ** 2 - shift for i in range(n)]
    norm = sum(w * w for w in wts)
    terms = " + ".join(f"({2 * w / norm!r}) * lag({c}, {n - 1 - i}) over {OW}" for i, w in enumerate(wts))
    return f"({terms})"


def _div(o: str, n: int) -> str:
    sp, so = f"({SLOPE('close', n)} / close)", f"({SLOPE(o, n)} / close)"
    return f"case when {sp} * {so} < 0 then -least(abs({sp} - {so}), 1) when {sp} is not null then least(abs({sp} - {so}), 1) end"


def _full(expr: str, c: str, n: int) -> str:
    return f"case when count({c}) over {fr(n)} = {n} then {expr} end"


def _base_sql(macd: str, src: str) -> str:
    return f"""select *, dif - dea as spread, close / lag(close) over {OW} - 1 as rt, volume / lag(volume) over {OW} - 1 as vc,
      sum(os) over {OW} as obv, rn - max(case when st is distinct from pst then rn end) over {OW} + 1 as cross_duration
    from (select m.symbol, m.trade_date, m.rn, m.close, m.dif, m.dea, m.hist, b.open, b.high, b.low, b.volume,
        case when dif >= dea then 1 else -1 end as st, case when lag(dif) over w0 >= lag(dea) over w0 then 1 when lag(dif) over w0 is not null then -1 end as pst,
        coalesce(sign(m.close - lag(m.close) over w0) * b.volume, 0) as os,
        case when m.rn > 1 then greatest(b.high - b.low, abs(b.high - lag(m.close) over w0), abs(b.low - lag(m.close) over w0)) end as tr
      from {macd} m join {src} b on b.symbol = m.symbol and b.trade_date = m.trade_date window w0 as (partition by m.symbol order by m.trade_date))"""


def _osc_sql(p: str, stable: str | None, slopes, curves, spans) -> dict[str, str]:
    c = {
        "dif": "dif / close", "dea": "dea / close", "macd_histogram": "hist / close",
        "dif_dea_relative_gap": "(dif - dea) / (abs(dif) + abs(dea) + 1e-12)", "cross_state": "st", "cross_duration": "cross_duration",
        "zero_axis_state": "case when dif >= 0 then 1 else -1 end",
        "spread_speed_1": f"{SLOPE('spread', 2)} / close", "spread_speed_3": f"{SLOPE('spread', 3)} / close", "spread_speed_5": f"{SLOPE('spread', 5)} / close",
        "histogram_speed_3": f"{SLOPE('hist', 3)} / close", "histogram_acceleration_5": f"{_curv('hist', 5)} / close",
    }
    for n in slopes:
        c[f"dif_slope_{n}"] = f"{SLOPE('dif', max(2, n))} / close"
        c[f"dea_slope_{n}"] = f"{SLOPE('dea', max(2, n))} / close"
    for n in curves:
        c[f"dif_curvature_{n}"] = f"{_curv('dif', n)} / close"
        c[f"dea_curvature_{n}"] = f"{_curv('dea', n)} / close"
    for n in spans:
        c[f"price_dif_divergence_{n}"] = _div("dif", n)
        c[f"price_macd_divergence_{n}"] = _div("hist", n)
    return {f"{p}_{k}": (f"case when {stable} then {v} end" if stable else v) for k, v in c.items()}


def _common_sql(p: str) -> dict[str, str]:
    s = "greatest(high - low, 1e-12)"
    return {
        f"{p}_body_ratio": f"(close - open) / {s}", f"{p}_upper_shadow_ratio": f"(high - greatest(open, close)) / {s}",
        f"{p}_lower_shadow_ratio": f"(least(open, close) - low) / {s}", f"{p}_close_location": f"(close - low) / {s}",
        f"{p}_gap": f"open / lag(close) over {OW} - 1", f"{p}_atr14_ratio": _full(f"avg(tr) over {fr(14)} / close", "tr", 14),
    }


def _pop(n: int, periods: int) -> str:
    return _full(f"stddev_pop(rt) over {fr(n)} * sqrt({periods})", "rt", n)


def _z(n: int) -> str:
    return _full(f"(volume - avg(volume) over {fr(n)}) / nullif(stddev_pop(volume) over {fr(n)}, 0)", "volume", n)


def _corr(n: int) -> str:
    return _full(f"corr(rt, vc) over {fr(n)}", "vc", n)


def _daily_sql() -> dict[str, str]:
    c = _osc_sql("daily", None, (3, 5, 10), (3, 5, 10), (20, 40, 60)) | _common_sql("daily")
    c |= {f"daily_return_{n}": f"close / lag(close, {n}) over {OW} - 1" for n in (1, 5, 20, 60)}
    c |= {f"daily_ma{n}_distance": f"close / avg(close) over {fr(n)} - 1" for n in (5, 10, 20, 60)}
    c |= {f"daily_volume_change_{n}": f"volume / lag(volume, {n}) over {OW} - 1" for n in (1, 5, 20)}
    c |= {f"daily_volatility_{n}": _pop(n, 252) for n in (20, 60)}
    g, l = f"avg(greatest(mv, 0)) over {fr(14)}", f"avg(greatest(-mv, 0)) over {fr(14)}"
    c |= {
        "daily_rsi14": _full(f"case when {l} = 0 then case when {g} > 0 then 100 else 50 end else 100 - 100 / (1 + {g} / nullif({l}, 0)) end", "mv", 14),
        "daily_volume_zscore_20": _z(20), "daily_price_volume_correlation_20": _corr(20),
        "daily_obv_slope_20": f"{SLOPE('obv', 20)} / greatest(abs(obv), 1.0)",
    }
    return c


def _weekly_sql() -> dict[str, str]:
    c = _osc_sql("weekly", "rn >= 35", (1, 3, 5, 8), (3, 5, 8), (4, 8, 13, 20)) | _common_sql("weekly")
    c |= {f"weekly_return_{n}": f"close / lag(close, {n}) over {OW} - 1" for n in (1, 2, 4, 8, 13, 20)}
    c |= {f"weekly_ma{n}_distance": _full(f"close / avg(close) over {fr(n)} - 1", "close", n) for n in (5, 10, 20, 40)}
    c |= {f"weekly_volume_change_{n}": f"volume / lag(volume, {n}) over {OW} - 1" for n in (1, 4, 13)}
    c |= {f"weekly_volatility_{n}": _pop(n, 52) for n in (4, 13, 20)}
    c |= {"weekly_volume_zscore_20": _z(20), "weekly_volume_zscore_52": _z(52), "weekly_price_volume_correlation_13": _corr(13)}
    c |= {"weekly_obv_slope_13": f"{SLOPE('obv', 13)} / greatest(abs(obv), 1.0)"}
    c |= {"weekly_drawdown_60": "case when len(l60) = 60 then list_min([l60[j] / list_max(l60[1:j]) - 1 for j in range(1, 61)]) end"}
    return c


def _select(cols: dict[str, str]) -> str:
    return f"select {KEY}, {r('close')} as close, " + ",\n".join(f"{r(v)} as {k}" for k, v in cols.items()) + " from fbase"


@REG.add(
    "daily_feature_rows",
    "W-38 W-13 W-14 W-20",
    with_views(_select(_daily_sql()), fbase=f"select *, close - lag(close) over {OW} as mv from ({_base_sql('macd_d', 'd')})"),
)
def _(spark, sf):
    return FE.features_daily(V.bars_daily(spark, sf))


@REG.add("weekly_feature_rows", "W-38", with_views(_select(_weekly_sql()), fbase=f"select *, list(close) over {fr(60)} as l60 from ({_base_sql('macd_w', 'w')})"))
def _(spark, sf):
    return FE.features_weekly(V.bars_weekly(spark, sf))


_STATE_SRC = f"""select *, case when dd <= -0.15 then 'DRAWDOWN' when rb >= 0.1 and dd > -0.1 then 'RECOVERY' when vol >= 0.3 then 'HIGH_VOLATILITY' when vol <= 0.15 then 'LOW_VOLATILITY'
    when close > ma and (sl is null or sl > 0) then 'UPTREND' when close < ma and (sl is null or sl < 0) then 'DOWNTREND' else 'SIDEWAYS' end as st
  from (select *, close / max(close) over {OW} - 1 as dd, close / min(close) over (partition by symbol order by trade_date rows between unbounded preceding and 1 preceding) - 1 as rb,
      {_full(f'stddev_pop(rt) over {fr(13)} * sqrt(52)', 'rt', 13)} as vol, avg(close) over {fr(20)} as ma, {SLOPE('close', 20)} / close as sl
    from (select *, close / lag(close) over {OW} - 1 as rt from wn))"""


@REG.add(
    "market_states",
    "W-33",
    with_views(
        f"""select {KEY}, st as market_state, case when rn < 20 then 1 else row_number() over (partition by symbol, rn >= 20, isl order by trade_date) end as market_state_duration
        from (select *, sum(chg) over {OW} as isl from (select *, case when st = lag(st) over {OW} then 0 else 1 end as chg from src))""",
        src=_STATE_SRC,
    ),
)
def _(spark, sf):
    # Damp the prices so that every state occurs.
    w = V.bars_weekly(spark, sf)
    return FE.market_state(w).select("symbol", "trade_date", "market_state", "market_state_duration")


@REG.add("state_feature_rows", "W-38 W-18 W-26 W-27 W-28 W-30 W-33 P-14")
def _(spark, sf):
    f = FE.features_state(V.bars_weekly(spark, sf))
    return FE.missing_columns(f)


_WB = f"{_full(f'close / avg(close) over {fr(20)} - 1', 'close', 20)}"
_MTF = f"""select w.symbol, w.trade_date, coalesce(w.md, 0) as wmd, coalesce(w.sl, 0) as wsl, coalesce(d.md, 0) as dmd, coalesce(d.sl, 0) as dsl, coalesce(d.r5, 0) as r5, coalesce(d.m5, 0) as m5,
    coalesce(w.r4, 0) as r4, coalesce(d.r20, 0) as r20
  from (select symbol, trade_date, {_WB} as md, {SLOPE('close', 20)} as sl, close / lag(close, 4) over {OW} - 1 as r4 from wn) w
  join (select symbol, trade_date, {_WB} as md, {SLOPE('close', 20)} as sl, close / lag(close, 5) over {OW} - 1 as r5, close / lag(close, 20) over {OW} - 1 as r20,
      {_full(f'close / avg(close) over {fr(5)} - 1', 'close', 5)} as m5 from dn) d on d.symbol = w.symbol and d.trade_date = w.trade_date"""


@REG.add(
    "multi_timeframe_states",
    "W-34 P-13",
    with_views(
        f"""select {KEY}, case when dmd > 0 and dsl > 0 and wmd > 0 and wsl > 0 then 'BOTH_BULLISH' when dmd < 0 and dsl < 0 and wmd < 0 and wsl < 0 then 'BOTH_BEARISH'
            when dmd > 0 and dsl > 0 and wmd < 0 and wsl < 0 then 'DAILY_BULLISH_WEEKLY_BEARISH' when dmd < 0 and dsl < 0 and wmd > 0 and wsl > 0 then 'WEEKLY_UPTREND_DAILY_PULLBACK'
            when r5 > 0 and m5 > 0 and not (wmd > 0 and wsl > 0) then 'DAILY_RECOVERY_WEEKLY_UNCONFIRMED' else 'NEUTRAL_MIXED' end as mtf_state,
          (sign(r4) = sign(r20) and sign(r20) <> 0)::int::double as x_direction_agreement, {r('r20 - r4')} as x_momentum_gap,
          (wmd < 0 and wsl < 0 and r5 > 0 and m5 > 0)::int::double as x_weekly_bearish_daily_recovery from mtf""",
        mtf=_MTF,
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf)
    out = FE.multi_timeframe(FE.features_state(V.bars_weekly(spark, sf)), FE.daily_branch(d))
    return out.select("symbol", "trade_date", "mtf_state", "x_direction_agreement", "x_momentum_gap", "x_weekly_bearish_daily_recovery")


@REG.add("multi_timeframe_features", "W-38 W-34")
def _(spark, sf):
    return FE.multi_timeframe(FE.features_state(V.bars_weekly(spark, sf)), FE.daily_branch(V.bars_daily(spark, sf)))


def _valued(spark, sf):
    """Weekly bars with a valuation of their own: the monthly-mean distance of the daily closes."""
    d = V.bars_daily(spark, sf)
    val = d.withColumn("pe", F.col("close") / 1000).select("symbol", "trade_date", "pe").where(F.dayofmonth("trade_date") <= 20)
    return V.bars_weekly(spark, sf), val


_VALUED = f"""
  select symbol, trade_date as vd, pe, case when n >= 20 then 100.0 * (below + 0.5 * same) / n end as pct, n from (
    select symbol, trade_date, pe, n,
      (select count(*) from vv z where z.symbol = v.symbol and z.trade_date <= v.trade_date and z.pe < v.pe) as below,
      (select count(*) from vv z where z.symbol = v.symbol and z.trade_date <= v.trade_date and z.pe = v.pe) as same
    from (select *, row_number() over {OW} as n from vv) v)"""


@REG.add(
    "golden_black_points",
    "W-19 W-35",
    with_views(
        f"""select {KEY}, case when pct is not null and pd is not null then (case when up then 1 + (dif <= 0)::int + (hist > ph)::int + (pct <= 30)::int + (close >= ma)::int else 0 end)::bigint end as golden_strength,
          case when pct is not null and pd is not null then (case when down then 1 + (dif >= 0)::int + (hist < ph)::int + (pct >= 70)::int + (close < ma)::int else 0 end)::bigint end as black_strength
        from (select m.symbol, m.trade_date, m.close, m.dif, m.hist, x.pct, lag(m.dif) over o as pd, lag(m.hist) over o as ph, lag(m.dif) over o <= lag(m.dea) over o and m.dif > m.dea as up,
            lag(m.dif) over o >= lag(m.dea) over o and m.dif < m.dea as down, avg(m.close) over (partition by m.symbol order by m.trade_date rows between 19 preceding and current row) as ma
          from macd_w m asof left join ranked x on x.symbol = m.symbol and m.trade_date >= x.vd window o as (partition by m.symbol order by m.trade_date))""",
        vv="select symbol, trade_date, close / 1000 as pe from d where day(trade_date) <= 20",
        ranked=_VALUED,
    ),
)
def _(spark, sf):
    w, val = _valued(spark, sf)
    m = I.macd(w).withColumn("ma_20", I.sma("close", 20))
    out = FE.golden_black(FE.valuation_at(m, val))
    return out.select("symbol", "trade_date", "golden_strength", "black_strength")


@REG.add("weekly_feature_snapshots", "W-39")
def _(spark, sf):
    w, val = _valued(spark, sf)
    s = FE.feature_snapshot(w, val)
    return s.select(
        "symbol", "trade_date", "dif", "dea", "hist", "rsi_6", "ma_20", "ma_60", "volume_ratio", "volatility_20", "current_drawdown", "valuation_value",
        "valuation_percentile", "technical_status", "valuation_status", "volume_status", "signal_status", "golden_strength", "black_strength",
    )


@REG.add(
    "snapshot_statuses",
    "W-39",
    with_views(
        f"""select symbol, case when rn >= 60 then 'available' else 'insufficient_warmup' end as technical_status,
          case when n is null then 'missing' when n < 20 then 'insufficient_history' else 'available' end as valuation_status,
          case when rn < 20 then 'missing_required_volume' else 'available' end as volume_status,
          case when rn < 60 then 'insufficient_warmup' when n is null then 'missing_valuation' when n < 20 then 'insufficient_valuation_history' else 'available' end as signal_status, count(*) as weeks
        from (select w.symbol, w.rn, x.n from wn w asof left join (select symbol, trade_date, row_number() over {OW} as n from vv) x on x.symbol = w.symbol and w.trade_date >= x.trade_date) group by all""",
        vv="select symbol, trade_date from d where day(trade_date) <= 20",
    ),
)
def _(spark, sf):
    w, val = _valued(spark, sf)
    s = FE.feature_snapshot(w, val)
    return s.groupBy("symbol", "technical_status", "valuation_status", "volume_status", "signal_status").agg(F.count("*").alias("weeks"))


@REG.add(
    "feature_manifest",
    "A-25",
)
def _(spark, sf):
    return FE.feature_manifest(FE.features_weekly(V.bars_weekly(spark, sf)).withColumnsRenamed({"close": "price_close"}), ["symbol", "trade_date"])


@REG.add(
    "indicator_record_long",
    "W-01 W-04 W-06 W-09 A-19",
    with_views(
        f"""select symbol, name, count(*) as n, count(v) as filled, {r('avg(v)', 4)} as mean_value from (
          select symbol, unnest(['dif', 'dea', 'ma_20', 'rsi_6']) as name, unnest([dif, dea, ma, case when rn = 1 then 50 when l = 0 then case when g > 0 then 100 else 50 end else 100 - 100 / (1 + g / l) end]) as v
          from (select x.symbol, x.rn, x.dif, y.e as dea, avg(x.close) over (partition by x.symbol order by x.rn rows between 19 preceding and current row) as ma, z.g, z.l
            from mdif x join mdea y on y.symbol = x.symbol and y.rn = x.rn join rsi6 z on z.symbol = x.symbol and z.rn = x.rn)) group by symbol, name""",
        ms12="""
  select symbol, trade_date, rn, close, close as s, close as e, close as f from wn where rn = 1
  union all
  select n.symbol, n.trade_date, n.rn, n.close, e.s + n.close, case when n.rn <= 12 then (e.s + n.close) / n.rn else e.e + (n.close - e.e) * 2.0::double / 13 end,
    case when n.rn <= 26 then (e.s + n.close) / n.rn else e.f + (n.close - e.f) * 2.0::double / 27 end
  from ms12 e join wn n on n.symbol = e.symbol and n.rn = e.rn + 1""",
        mdif="select symbol, rn, close, e - f as dif from ms12",
        mdea="""
  select symbol, rn, dif as s, dif as e from mdif where rn = 1
  union all
  select n.symbol, n.rn, e.s + n.dif, case when n.rn <= 9 then (e.s + n.dif) / n.rn else e.e + (n.dif - e.e) * 0.2::double end from mdea e join mdif n on n.symbol = e.symbol and n.rn = e.rn + 1""",
        rsi6="""
  select symbol, rn, close, 0.0::double as g, 0.0::double as l from wn where rn = 1
  union all
  select n.symbol, n.rn, n.close, case when n.rn - 1 <= 6 then (e.g * (n.rn - 2) + greatest(n.close - e.close, 0)) / (n.rn - 1) else (e.g * 5 + greatest(n.close - e.close, 0)) / 6 end,
    case when n.rn - 1 <= 6 then (e.l * (n.rn - 2) + greatest(e.close - n.close, 0)) / (n.rn - 1) else (e.l * 5 + greatest(e.close - n.close, 0)) / 6 end
  from rsi6 e join wn n on n.symbol = e.symbol and n.rn = e.rn + 1""",
    ),
)
def _(spark, sf):
    rec = I.indicator_set(V.bars_weekly(spark, sf), "weekly")
    long = P.unpivot(rec.select("symbol", "trade_date", "dif", "dea", "ma_20", "rsi_6"), ["symbol", "trade_date"], ["dif", "dea", "ma_20", "rsi_6"], "name", "v")
    from barloom.functions.scalar import cut

    return long.groupBy("symbol", "name").agg(F.count("*").alias("n"), F.count("v").alias("filled"), cut(F.avg("v"), 4).alias("mean_value"))


# ---- turning points ------------------------------------------------------------------------

EVERY, BACK, AHEAD = 1, 60, 13

_WIN = {
    "win": f"""select b.symbol, a.rn as anchor, b.rn - a.rn as step, b.trade_date, b.open, b.high, b.low, b.close from wn b
      join (select symbol, rn, max(rn) over (partition by symbol) as n from wn) a on a.symbol = b.symbol and b.rn between a.rn - {BACK - 1} and a.rn + {AHEAD}
      where a.rn % {EVERY} = 0 and a.rn >= {BACK} and a.rn + {AHEAD} <= a.n""",
    "we": f"""
  select symbol, anchor, step, close as f, close as s from win where step = {1 - BACK}
  union all
  select n.symbol, n.anchor, n.step, e.f + (n.close - e.f) * 2.0::double / 13, e.s + (n.close - e.s) * 2.0::double / 27
  from we e join win n on n.symbol = e.symbol and n.anchor = e.anchor and n.step = e.step + 1""",
    "wd": "select symbol, anchor, step, f - s as dif from we",
    "wa": f"""
  select symbol, anchor, step, dif, dif as dea, dif * 0.2::double as dea0 from wd where step = {1 - BACK}
  union all
  select n.symbol, n.anchor, n.step, n.dif, e.dea + (n.dif - e.dea) * 0.2::double, e.dea0 + (n.dif - e.dea0) * 0.2::double from wa e join wd n on n.symbol = e.symbol and n.anchor = e.anchor and n.step = e.step + 1""",
    "hx": """select w.*, a.dif, a.dea, a.dea0, a.dif - lag(a.dif) over o as d1, ln(w.close / lag(w.close) over o) as lr, lag(w.close) over o as pc
      from win w join wa a on a.symbol = w.symbol and a.anchor = w.anchor and a.step = w.step window o as (partition by w.symbol, w.anchor order by w.step)""",
    "th": """select symbol, anchor, ac, ds, 0.25 * ds as eps, rs, greatest(1.5 * rs, 0.5 * atr / ac) as prom from (
      select symbol, anchor, max(close) filter (step = 0) as ac, greatest(1.4826 * mad(d1) filter (step > -52), 1e-10 * max(close) filter (step = 0)) as ds, greatest(1.4826 * mad(lr) filter (step > -52), 0.003) as rs,
        avg(greatest(high - low, abs(high - case when step = -13 then close else pc end), abs(low - case when step = -13 then close else pc end))) filter (step >= -13) as atr
      from hx where step <= 0 group by symbol, anchor)""",
}


def _windows(spark, sf):
    w = TU.anchor_windows(V.bars_weekly(spark, sf), EVERY, BACK, AHEAD)
    return w.select("symbol", "anchor", "step", "trade_date", "open", "high", "low", "close", "volume")


def _thresholds(win):
    return TU.turn_thresholds(win.where("step <= 0"))


@REG.add(
    "turn_thresholds",
    "W-40",
    with_views(f"select symbol, anchor, {r('ac')} as anchor_close, {r('ds')} as dif_scale, {r('eps')} as dif_epsilon, {r('rs')} as return_scale, {r('prom')} as minimum_prominence from th", **_WIN),
)
def _(spark, sf):
    return _thresholds(_windows(spark, sf))


@REG.add(
    "window_extrema",
    "W-43 K-03",
    with_views(f"select symbol, anchor, arg_min(step, (low, step)) as low_step, {r('min(low)')} as lowest, arg_min(step, (-high, step)) as high_step, {r('max(high)')} as highest from win where step > 0 group by all", win=_WIN["win"]),
)
def _(spark, sf):
    return TU.window_extrema(_windows(spark, sf).where("step > 0"))


_PRICE_TURNS = """select symbol, anchor, step, kind as turn_kind, case when ok and n2 is not null and s * (n2 - l) >= 0.5 * rs then 'CONFIRMED' when ok then 'PENDING' else 'REJECTED' end as status, least(dn, up) as prominence
      from (select *, dn >= rs and up >= rs and least(dn, up) >= prom and dn + up >= 2 * rs as ok from (
        select *, s * (p - l) as dn, s * (n - l) as up from (
          select p.symbol, p.anchor, p.step, p.l, p.p, p.n, p.n2, t.rs, t.prom, k.kind, k.s from (
            select symbol, anchor, step, ln(close) as l, lag(ln(close)) over o as p, lead(ln(close)) over o as n, lead(ln(close), 2) over o as n2 from win where step > 0 window o as (partition by symbol, anchor order by step)) p
          join th t on t.symbol = p.symbol and t.anchor = p.anchor, (values ('BOTTOM', 1.0::double), ('TOP', -1.0::double)) k(kind, s) where p.p is not null and p.n is not null)) where dn > 0 and up > 0)"""
_DIF_TURNS = """select symbol, anchor, step, kind as turn_kind, case when n1 is null then 'PENDING' when s * n1 >= 0.5 * eps and s * (ndif - dif) > 0 and s * (ndea - dea) >= 0 and s * (nh - h) > 0 then 'CONFIRMED' else 'REJECTED' end as status, abs(d1 - p1) as prominence
      from (select p.*, t.eps, k.kind, k.s from (
          select symbol, anchor, step, dif, dea0 as dea, 2 * (dif - dea0) as h, d1, d1 - lag(d1) over o as d2, lag(d1) over o as p1, lead(d1) over o as n1, lead(dif) over o as ndif, lead(dea0) over o as ndea, lead(2 * (dif - dea0)) over o as nh
          from hx window o as (partition by symbol, anchor order by step)) p
        join th t on t.symbol = p.symbol and t.anchor = p.anchor, (values ('BOTTOM', 1.0::double), ('TOP', -1.0::double)) k(kind, s) where p.step > 1)
      where s * p1 <= -eps and s * d1 >= eps and s * d2 > 0"""


@REG.add(
    "price_turning_points",
    "W-41",
    with_views(f"select symbol, anchor, step, turn_kind, status, {r('prominence')} as prominence from pt", **_WIN, pt=_PRICE_TURNS),
)
def _(spark, sf):
    win = _windows(spark, sf)
    return TU.price_turns(win.where("step > 0"), _thresholds(win))


def _dif_path(win):
    """Indicators carried from the history into the path; only the path steps are kept."""
    m = I.macd(win, signal_seed="zero", by=TU.PATH, t="step")
    m = m.withColumn("d1", I.diff("dif", 1, TU.PATH, "step"))
    return m.withColumn("d2", I.diff("d1", 1, TU.PATH, "step")).where("step > 0")


@REG.add(
    "dif_turning_points",
    "W-42 M-21",
    with_views(f"select symbol, anchor, step, turn_kind, status, {r('prominence')} as prominence from dt", **_WIN, dt=_DIF_TURNS),
)
def _(spark, sf):
    win = _windows(spark, sf)
    return TU.dif_turns(_dif_path(win), _thresholds(win))


@REG.add(
    "turn_consistency",
    "W-44",
    with_views(
        """select k.symbol, k.anchor, case when p1 <> p2 or d1 <> d2 then 'AMBIGUOUS_TWO_SIDED' when p1 is null or d1 is null then 'UNCONFIRMED' when p1 <> d1 then 'TYPE_CONFLICT'
            when abs(ps - ds) <= 2 then 'TEMPORALLY_CONSISTENT' else 'TIME_CONFLICT' end as consistency,
          case when p1 is not null then 'CONFIRMED' when pp > 0 then 'PENDING' else 'NO_VALID_TURN' end as price_status, case when d1 is not null then 'CONFIRMED' when dp > 0 then 'PENDING' else 'NO_VALID_TURN' end as dif_status,
          case when p1 = p2 and d1 = d2 and p1 = d1 and abs(ps - ds) <= 2 then p1 end as action_kind, case when p1 = p2 and d1 = d2 and p1 = d1 and abs(ps - ds) <= 2 then greatest(ps, ds) - 1 end as action_start,
          case when p1 = p2 and d1 = d2 and p1 = d1 and abs(ps - ds) <= 2 then case when least(ps, ds) + 1 < greatest(ps, ds) - 1 then greatest(ps, ds) + 1 else least(ps, ds) + 1 end end as action_end
        from (select distinct symbol, anchor from win) k left join (
          select symbol, anchor, min(turn_kind) filter (g = 'P' and status = 'CONFIRMED') as p1, max(turn_kind) filter (g = 'P' and status = 'CONFIRMED') as p2, min(turn_kind) filter (g = 'D' and status = 'CONFIRMED') as d1,
            max(turn_kind) filter (g = 'D' and status = 'CONFIRMED') as d2, count(*) filter (g = 'P' and status = 'PENDING') as pp, count(*) filter (g = 'D' and status = 'PENDING') as dp,
            arg_max(step, (prominence, -step)) filter (g = 'P' and status = 'CONFIRMED') as ps, arg_max(step, (prominence, -step)) filter (g = 'D' and status = 'CONFIRMED') as ds
          from (select *, 'P' as g from pt union all by name select *, 'D' as g from dt) group by symbol, anchor) x on x.symbol = k.symbol and x.anchor = k.anchor""",
        **_WIN, pt=_PRICE_TURNS, dt=_DIF_TURNS,
    ),
)
def _(spark, sf):
    win = _windows(spark, sf)
    th = _thresholds(win)
    return TU.turn_consistency(win, TU.price_turns(win.where("step > 0"), th), TU.dif_turns(_dif_path(win), th))


@REG.add(
    "expected_path_turns",
    "W-45",
    with_views(
        """select symbol, anchor, week, case when inc > 0 then 'top' else 'bottom' end as turn_kind from (
          select symbol, anchor, step as week, inc, lag(inc) over o as p, lead(inc) over o as n from (
            select w.symbol, w.anchor, w.step, (w.close - lag(w.close) over (partition by w.symbol, w.anchor order by w.step)) / t.close as inc from win w join (select symbol, anchor, close from win where step = 0) t on t.symbol = w.symbol and t.anchor = w.anchor where w.step between 0 and 8)
          where step > 0 window o as (partition by symbol, anchor order by step)) where (inc > 0 and p < 0 and n < 0) or (inc < 0 and p > 0 and n > 0)""",
        win=_WIN["win"],
    ),
)
def _(spark, sf):
    win = _windows(spark, sf).where("step between 0 and 8")
    base = win.groupBy("symbol", "anchor").agg(F.array_sort(F.collect_list(F.struct("step", "close"))).alias("p"))
    paths = base.select("symbol", "anchor", F.transform(F.slice("p", 2, 8), lambda x: x["close"] / F.element_at("p", 1)["close"] - 1).alias("path"))
    return TU.path_turns(paths)


@REG.add(
    "first_slope_turn",
    "W-46",
    with_views(
        """select symbol, anchor, min(step) filter (k is not null) as turn_step, arg_min(k, step) filter (k is not null) as turn_kind from (
          select symbol, anchor, step, case when p < 0 and d1 >= 0 then 'bottom' when p > 0 and d1 <= 0 then 'top' end as k from (select *, lag(d1) over (partition by symbol, anchor order by step) as p from hx where step >= 0)) group by symbol, anchor""",
        **{k: _WIN[k] for k in ("win", "we", "wd", "wa", "hx")},
    ),
)
def _(spark, sf):
    m = I.macd(_windows(spark, sf), by=TU.PATH, t="step")
    m = m.withColumn("d1", I.diff("dif", 1, TU.PATH, "step"))
    return TU.first_turn(m.where("step >= 0"), "d1")


@REG.add(
    "trend_states",
    "W-47",
    with_views(
        f"""select {KEY}, case when d1 is null then 'INSUFFICIENT' when d1 < 0 and d2 > 0 then 'POTENTIAL_BOTTOMING' when p1 < 0 and d1 >= 0 and d2 > 0 then 'UPWARD_TURN'
            when d1 > 0 and p1 > 0 and q1 > 0 then case when dif > least(pdif, qdif) and dea > pdea and hist > ph and close > least(pc, qc) then 'UPTREND_CONFIRMED' else 'UPTREND_EARLY_CONFIRMED' end
            when d1 > 0 then 'UPWARD_TURN_UNCONFIRMED' else 'WEAK_OR_FALLING' end as trend_state
        from (select *, d1 - lag(d1) over {OW} as d2, lag(d1) over {OW} as p1, lag(d1, 2) over {OW} as q1, lag(dif) over {OW} as pdif, lag(dif, 2) over {OW} as qdif, lag(dea) over {OW} as pdea, lag(hist) over {OW} as ph,
            lag(close) over {OW} as pc, lag(close, 2) over {OW} as qc from (select *, dif - lag(dif) over {OW} as d1 from macd_w))"""
    ),
)
def _(spark, sf):
    return TU.trend_state(I.macd(V.bars_weekly(spark, sf))).select("symbol", "trade_date", "trend_state")


@REG.add(
    "observed_confirmations",
    "W-48",
    with_views(
        f"""select {KEY}, coalesce(rn >= 30 and q1 <= -eps and p1 >= eps and d1 >= 0.5 * eps and dif > pdif and dea >= pdea and hist > ph and close >= pc, false)::bigint as buy_confirmed,
          coalesce(rn >= 30 and q1 >= eps and p1 <= -eps and d1 <= -0.5 * eps and dif < pdif and dea <= pdea and hist < ph and close <= pc, false)::bigint as sell_confirmed
        from (select *, close * 0.001 as eps, lag(d1) over {OW} as p1, lag(d1, 2) over {OW} as q1, lag(dif) over {OW} as pdif, lag(dea) over {OW} as pdea, lag(hist) over {OW} as ph, lag(close) over {OW} as pc
          from (select *, dif - lag(dif) over {OW} as d1 from macd_w))"""
    ),
)
def _(spark, sf):
    out = TU.observed_confirmation(I.macd(V.bars_weekly(spark, sf)), F.col("close") * 0.001)
    return out.select("symbol", "trade_date", "buy_confirmed", "sell_confirmed")
