"""Queries over rule strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import arrays as A
from barloom.operators import bars as B, indicators as I, labels as L, panel as P, rules as R
from barloom.plans import views as V
from barloom.plans.registry import REG
from barloom.plans.sqlviews import day, r, with_views

KEY = f"symbol, {day('trade_date')} as trade_date"
OW = "(partition by symbol order by trade_date)"


def fr(n: int) -> str:
    return f"(partition by symbol order by trade_date rows between {n - 1} preceding and current row)"


# Weekly rows with every input of the rule scores: first-value MACD, simple RSI, range position as valuation.
_RI = f"""select *, lag(dif) over {OW} as pdif, lag(dea) over {OW} as pdea from (select *, avg(close) over {fr(20)} as ma_20, avg(close) over {fr(60)} as ma_60, avg(volume) over {fr(20)} as volume_ma_20, close / max(close) over {OW} - 1 as current_drawdown,
    case when count(mv) over {fr(6)} = 6 then case when avg(greatest(-mv, 0)) over {fr(6)} = 0 then 100 else 100 - 100 / (1 + avg(greatest(mv, 0)) over {fr(6)} / avg(greatest(-mv, 0)) over {fr(6)}) end end as rsi_6,
    case when rn >= 20 then (close - min(close) over {fr(20)}) / nullif(max(close) over {fr(20)} - min(close) over {fr(20)}, 0) end as vp,
    case when count(x) over {fr(13)} = 13 then stddev_pop(x) over {fr(13)} * sqrt(52) / 10 end as volatility_20
  from (select m.symbol, m.trade_date, m.rn, m.close, m.dif, m.dea, m.hist, m.e12, w.volume, m.close - lag(m.close) over o as mv, m.close / lag(m.close) over o - 1 as x from macd_w m join w on w.symbol = m.symbol and w.trade_date = m.trade_date
    window o as (partition by m.symbol order by m.trade_date)))"""


def _inputs(spark, sf):
    w = V.bars_weekly(spark, sf)
    w = I.macd(I.ema(w, "close", 12, "ema_12"))
    w = I.rsi(w, 6, "simple", out="rsi_6")
    w = I.volatility(w, 13, 52, "pop", out="volatility_20")
    w = I.drawdown(w)
    f = P.trailing(20)
    lo, hi = F.min("close").over(f), F.max("close").over(f)
    vp = F.when(F.count("close").over(f) == 20, (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return w.withColumns(
        {"ma_20": I.sma("close", 20), "ma_60": I.sma("close", 60), "volume_ma_20": I.sma("volume", 20), "vp": vp, "volatility_20": F.col("volatility_20") / 10}
    )


_PARTS = """case when vp is null then null when vp <= 0.3 then 1 when vp >= 0.7 then -1 else 0 end as s1,
  (case when close >= ma_20 then 1 else -1 end + case when ma_20 >= ma_60 then 1 else -1 end) / 2.0::double as s2,
  case when rsi_6 is not null then (case when rsi_6 <= 35 then 1 when rsi_6 >= 70 then -1 else 0 end + case when hist >= 0 then 1 else -1 end) / 2.0::double end as s3,
  case when volume / volume_ma_20 >= 1.2 then 1 when volume / volume_ma_20 <= 0.8 then -1 else 0 end as s4,
  case when volatility_20 is null then null when volatility_20 <= 0.35 then 1 else -1 end as s5, case when current_drawdown <= -0.2 then -1 else 1 end as s6"""


@REG.add(
    "rule_scores",
    "S-01",
    with_views(
        f"""select {KEY}, {r('sc')} as score, {r('cf')} as confidence, case when cf < 0.5 then 'HOLD' when sc <= -0.75 then 'PAUSE' when sc <= -0.45 then 'SELL_PARTIAL' when sc <= -0.2 then 'REDUCE' when sc < 0 then 'HOLD' when sc < 0.35 then 'NORMAL' else 'INCREASE' end as recommendation,
          (case when vp <= 0.3 or vp >= 0.7 then 1 else 0 end + (close >= ma_20)::int + (ma_20 >= ma_60)::int + coalesce(rsi_6 is not null and hist >= 0, false)::int + (s4 > 0)::int + coalesce(s5 > 0, false)::int + 1 + (cf < 0.5)::int + (cf >= 0.5 and sc <= -0.45 and sc > -0.75)::int)::bigint as rules
        from (select *, (coalesce(s1, 0) * 0.25 + s2 * 0.25 + coalesce(s3, 0) * 0.15 + s4 * 0.1 + coalesce(s5, 0) * 0.1 + s6 * 0.15) / (0.5 + (s1 is not null)::int * 0.25 + (s3 is not null)::int * 0.15 + (s5 is not null)::int * 0.1)::double as sc,
            (7 + (vp is not null)::int + (rsi_6 is not null)::int + (volatility_20 is not null)::int) / 10.0::double * 0.6
            + greatest(coalesce(s1 > 0, false)::int + (s2 > 0)::int + coalesce(s3 > 0, false)::int + (s4 > 0)::int + coalesce(s5 > 0, false)::int + (s6 > 0)::int, coalesce(s1 < 0, false)::int + (s2 < 0)::int + coalesce(s3 < 0, false)::int + (s4 < 0)::int + coalesce(s5 < 0, false)::int + (s6 < 0)::int) / n * 0.25::double
            + n / 6.0::double * 0.15 as cf
          from (select *, 3.0::double + (s1 is not null)::int + (s3 is not null)::int + (s5 is not null)::int as n from (select *, {_PARTS} from ri)))""",
        ri=_RI,
    ),
)
def _(spark, sf):
    s = R.rule_score(_inputs(spark, sf).withColumn("valuation_percentile", F.col("vp")))
    return s.select("symbol", "trade_date", "score", "confidence", "recommendation", F.size("rules").alias("rules"))


@REG.add("rule_score_explanations", "S-01 S-02")
def _(spark, sf):
    s = R.rule_score(_inputs(spark, sf).withColumn("valuation_percentile", F.col("vp")).withColumn("holding", F.lit(0.4)), holding="holding")
    amount = R.suggest_amounts(F.lit(1000.0), "recommendation", "multiplier", 200.0, 1200.0)
    return s.select("symbol", "trade_date", "recommendation", "multiplier", "suggested_sell_ratio", amount.alias("suggested_buy"), F.array_join("rules", ",").alias("rules"), F.array_join("risks", ",").alias("risks"))


@REG.add(
    "suggested_amounts",
    "S-02",
    f"""select o_orderkey, {r('case when k in (0, 1) then least(greatest(a * (case when k = 0 then 1.3 else 1.0 end)::double, 20000), 200000) else 0 end')} as suggested from (select o_orderkey, o_totalprice as a, o_orderkey % 6 as k from orders)""",
)
def _(spark, sf):
    names = ["INCREASE", "NORMAL", "REDUCE", "PAUSE", "HOLD", "SELL_PARTIAL"]
    mult = [1.3, 1.0, 0.75, 0.5, 1.0, 0.7]
    k = (F.col("o_orderkey") % 6).cast("int")
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", R.suggest_amounts("o_totalprice", F.element_at(F.array(*map(F.lit, names)), k + 1), F.element_at(F.array(*map(F.lit, mult)), k + 1), 20000.0, 200000.0).alias("suggested"))


_JUDGE = """select *, case when vp is null then 0 else greatest(-100, least(100, (50 - vp * 100) * 2)) end as c1,
    sign(dea) * 50 + sign(hist) * 25 + sign(dif - dea) * 25 as c2, sign(dif) * 45 + sign(dif - dea) * 35 + sign(hist) * 20 as c3, sign(e12 - ma_20) * 50 + sign(e12 - ma_60) * 50 as c5,
    case when rsi_6 is null then 0 else greatest(-40, least(40, (rsi_6 - 50) * 2)) end + greatest(-15, least(15, (volume / volume_ma_20 - 1) * 30)) - case when current_drawdown <= -0.2 then 35 when current_drawdown <= -0.1 then 15 else 0 end
      - case when volatility_20 >= 0.1 then 30 when volatility_20 >= 0.06 then 15 else 0 end as c6 from ri"""


@REG.add(
    "weekly_judgements",
    "S-03 F-13",
    with_views(
        f"""select {KEY}, {r('sc')} as score, case when hot then 'HOT' when vp * 100 <= 30 then 'CHEAP' else 'SCORE' end as rule,
          case when hot or vp * 100 <= 30 then 'up' when sc >= 12 then 'up' when sc <= -12 then 'down' else 'neutral' end as direction,
          case when hot then 70 when vp * 100 <= 30 then 20 when sc >= 65 then 85 when sc >= 40 then 75 when sc >= 20 then 65 when sc >= 8 then 60 when sc >= -8 then 50 when sc >= -20 then 40 when sc >= -40 then 30 when sc >= -65 then 20 else 15 end::bigint as target_position
        from (select *, c1 * 0.3 + greatest(-100, least(100, c2)) * 0.2 + greatest(-100, least(100, c3)) * 0.2 + c5 * 0.05 + greatest(-100, least(100, c6)) * 0.1 as sc,
          coalesce(vp * 100 >= 85 and dif > 0 and dea > 0 and e12 >= ma_20 and e12 >= ma_60, false) as hot from jd)""",
        ri=_RI, jd=_JUDGE,
    ),
)
def _(spark, sf):
    f = _inputs(spark, sf).withColumns(
        {"valuation_percentile": F.col("vp") * 100, "volume_ratio": F.col("volume") / F.col("volume_ma_20"), "golden_strength": F.lit(0), "black_strength": F.lit(0), "golden_point": F.lit(False), "black_point": F.lit(False)}
    )
    return R.weekly_judgement(f).select("symbol", "trade_date", "score", "rule", "direction", "target_position")


@REG.add(
    "legacy_component_scores",
    "S-04",
    with_views(
        f"""select {KEY}, {r('a1')} as s_valuation, {r('a2')} as s_eda, {r('a3')} as s_dip, {r('a5')} as s_trend, {r('a6')} as s_market_regime, case when t >= 75 then 95 when t >= 55 then 85 when t >= 35 then 70 when t >= 15 then 60 when t >= -15 then 50 when t >= -35 then 35 when t >= -55 then 25 when t >= -75 then 15 else 10 end::bigint as legacy_target
        from (select *, a1 * 0.3 + a2 * 0.2 + a3 * 0.2 + a5 * 0.1 + a6 * 0.1 as t from (
          select *, case when vp is null then 0 else greatest(-100, least(100, (50 - vp * 100) * 2)) end as a1, sign(dea) * 35 + case when pdea is null then 0 else greatest(-45, least(45, (dea - pdea) * 12)) end as a2, sign(dif - dea) * 35 + case when pdif is null then 0 else greatest(-45, least(45, (dif - pdif) * 12)) end as a3,
            (case when close >= ma_20 then 40 else -40 end + case when close >= ma_60 then 40 else -40 end) as a5,
            case when rsi_6 is null then 0 else greatest(-35, least(35, (rsi_6 - 50) * 2)) end + greatest(-20, least(20, (volume / volume_ma_20 - 1) * 50)) - case when current_drawdown < -0.2 then 25 else 0 end as a6 from ri))""",
        ri=_RI,
    ),
)
def _(spark, sf):
    f = _inputs(spark, sf).withColumns({"valuation_percentile": F.col("vp") * 100, "volume_ratio": F.col("volume") / F.col("volume_ma_20"), "golden_strength": F.lit(0), "black_strength": F.lit(0)})
    out = R.component_scores(f, {"valuation": 30.0, "eda": 20.0, "dip": 20.0, "signal_point": 10.0, "trend": 10.0, "market_regime": 10.0})
    return out.select("symbol", "trade_date", "s_valuation", "s_eda", "s_dip", "s_trend", "s_market_regime", "legacy_target")


@REG.add("weekly_signals", "S-05")
def _(spark, sf):
    w = _inputs(spark, sf).withColumn("valuation_percentile", F.col("vp") * 100).drop("dif", "dea", "hist")
    s = R.weekly_signal(w, {"momentum": 0.25, "trend": 0.25, "macd": 0.2, "valuation": 0.15, "risk": 0.15})
    return s.select("symbol", "trade_date", "signal_score", "signal_direction", "signal_state", "signal_market_state", "base_target", "signal_confidence")


@REG.add(
    "daily_corrections",
    "S-05",
    with_views(
        f"""select {KEY}, dd as daily_direction, pa::bigint as position_adjustment, ca::bigint as confidence_adjustment from (
          select *, case when wk = 'up' and dd = 'down' then least(p0, -5) when wk = 'down' and dd = 'up' then greatest(p0, 5) else p0 end as pa,
            case when hot then least(b, -3) when cold then case when wk = 'down' then least(b, -2) else greatest(b, 2) end else b end as ca
          from (select *, case when hot then -5 when cold then 5 else 0 end as p0, case when dd = wk and dd <> 'sideways' then 3 when dd <> wk and dd <> 'sideways' then -4 else 0 end as b
            from (select symbol, trade_date, case when vp > 0.6 then 'up' when vp < 0.4 then 'down' else 'sideways' end as wk, case when dif > dea and close > ma_20 then 'up' when dif < dea and close < ma_20 then 'down' else 'sideways' end as dd,
                rsi_6 >= 70 or close / ma_20 - 1 >= 0.07 as hot, rsi_6 <= 30 or close / ma_20 - 1 <= -0.07 as cold from ri where vp is not null)))""",
        ri=_RI,
    ),
)
def _(spark, sf):
    f = _inputs(spark, sf).where("vp is not null")
    f = f.select("symbol", "trade_date", F.when(F.col("vp") > 0.6, "up").when(F.col("vp") < 0.4, "down").otherwise("sideways").alias("signal_direction"),
                 F.col("dif").alias("d_dif"), F.col("dea").alias("d_dea"), F.col("rsi_6").alias("d_rsi"), F.col("close").alias("d_close"), F.col("ma_20").alias("d_ma20"))
    return R.daily_correction(f).select("symbol", "trade_date", "daily_direction", "position_adjustment", "confidence_adjustment")


# ---- confirmation and targets -----------------------------------------------------------

def _forecast_wide(spark, sf, weekly):
    f = V.forecasts(weekly)
    pick = lambda h, c: F.max(F.when(F.col("h") == h, F.col(c)))
    return f.groupBy("symbol", F.col("anchor").alias("trade_date")).agg(
        pick(4, "p50").alias("expected_4"), pick(8, "p50").alias("expected_8"), pick(8, "p10").alias("p10_8"),
        pick(4, "p_up").alias("p_up_4"), pick(4, "p_down").alias("p_down_4"), pick(8, "p_up").alias("p_up_8"), pick(8, "p_down").alias("p_down_8"),
    ).where("expected_8 is not null")


_QUAD = f"""select x.*, f8.p_up - f8.p_down as e8, f8.p50 as x8, f8.p10 as p10, f4.p_up - f4.p_down as e4, f4.p50 as x4 from (
  select symbol, trade_date, rn, close, case when rn >= 35 then dif / close end as d, case when rn >= 35 then d1 / close end as f1, case when rn >= 35 then (d1 - pd1) / close end as f2, close / ma20 - 1 as md, sl / close as sl, close / ma60 - 1 as md60,
    close / lo - 1 as rb, close / hi - 1 as dd,
    row_number() over (partition by symbol, isl order by trade_date) as rl, coalesce(sum((pg <= 0 and g > 0)::int) over {OW}, 0) as gc
  from (select *, sum(chg) over {OW} as isl, lag(d1) over {OW} as pd1 from (select *, case when st is not distinct from lag(st) over {OW} then 0 else 1 end as chg from (
    select *, (dif >= 0)::varchar || coalesce(d1 > 0, false)::varchar as st from (
      select *, dif - lag(dif) over {OW} as d1, dif - dea as g, lag(dif - dea) over {OW} as pg, case when rn >= 20 then avg(close) over {fr(20)} end as ma20, case when rn >= 60 then avg(close) over {fr(60)} end as ma60,
        case when count(close) over {fr(20)} = 20 then regr_slope(close, rn) over {fr(20)} end as sl, min(close) over (partition by symbol order by trade_date rows between unbounded preceding and 1 preceding) as lo, max(close) over {OW} as hi from macd_w))))) x
  join fc f8 on f8.symbol = x.symbol and f8.anchor = x.trade_date and f8.h = 8 join fc f4 on f4.symbol = x.symbol and f4.anchor = x.trade_date and f4.h = 4"""
_CONF = """select *, case when q = 'NEGATIVE_DIF_FALLING' then case when md < 0 and coalesce(sl <= 0, true) and -e8 > 0.15 then 'BEARISH_CONFIRMED' else 'UNCONFIRMED' end
    when q = 'POSITIVE_DIF_FALLING' then case when md < 0 and coalesce(sl <= 0, true) then 'TOP_CONFIRMED' when -e8 > 0.25 and md < 0 then 'SIGNAL_CONFLICT' else 'UNCONFIRMED' end
    when q = 'NEGATIVE_DIF_RISING' then case when rb > 0 and rl >= 2 then 'PARTIALLY_CONFIRMED_BOTTOM' when rb > 0 then 'PRICE_BOTTOM_CONFIRMED' when rl >= 2 then 'DIF_BOTTOM_CONFIRMED' else 'NEGATIVE_DIF_RISING' end
    when q like 'POSITIVE_DIF%' then case when md > 0 and coalesce(sl > 0, true) and coalesce(md60 > -0.05, true) and e8 > 0 and gc >= 2 then 'TREND_CONFIRMED' else 'POSITIVE_DIF_RISING' end else 'UNCONFIRMED' end as cs
  from (select *, case when d is null or f1 is null then 'UNCONFIRMED' when d < 0 and f1 < 0 then 'NEGATIVE_DIF_FALLING' when d < 0 and f1 > 0 then 'NEGATIVE_DIF_RISING'
    when d > 0 and f1 > 0 then case when f2 < 0 then 'POSITIVE_DIF_RISING_DECELERATING' else 'POSITIVE_DIF_ACCELERATING' end when d > 0 and f1 < 0 then 'POSITIVE_DIF_FALLING' else 'UNCONFIRMED' end as q from qd)"""
_CAP = "case cs when 'BEARISH_CONFIRMED' then 10 when 'TOP_CONFIRMED' then 10 when 'SIGNAL_CONFLICT' then 20 when 'PRICE_BOTTOM_CONFIRMED' then 40 when 'DIF_BOTTOM_CONFIRMED' then 40 when 'PARTIALLY_CONFIRMED_BOTTOM' then 50 when 'POSITIVE_DIF_RISING' then case when q like '%DECEL%' then 60 else 60 end when 'TREND_CONFIRMED' then case when q like '%DECEL%' then 60 else 80 end else 30 end"


def _state_inputs(spark, sf):
    w = V.bars_weekly(spark, sf)
    out = I.dif_regime(I.macd(w))
    o = P.ordered()
    out = out.withColumn("_d1", F.col("dif") - F.lag("dif").over(o)).withColumn("_rn", F.row_number().over(o))
    stable = F.col("_rn") >= 35
    rebound_low = F.min("close").over(P.before())
    out = out.withColumns(
        {
            "dif_rel": F.when(stable, F.col("dif") / F.col("close")), "dif_first_change": F.when(stable, F.col("_d1") / F.col("close")),
            "dif_second_change": F.when(stable, (F.col("_d1") - F.lag("_d1").over(o)) / F.col("close")),
            "ma20_distance": F.col("close") / I.sma("close", 20, partial=False) - 1, "ma60_distance": F.col("close") / I.sma("close", 60, partial=False) - 1,
            "ma20_slope": I.slope("close", 20, "close"), "rebound": F.col("close") / rebound_low - 1, "from_high": F.col("close") / F.max("close").over(P.running()) - 1,
        }
    )
    return out.join(_forecast_wide(spark, sf, w), ["symbol", "trade_date"]).withColumn("valuation_percentile", F.lit(None).cast("double"))


@REG.add(
    "confirmation_states",
    "S-06",
    with_views(f"select {KEY}, q as dif_quadrant, cs as confirmation, ({_CAP})::bigint as state_cap from cn", qd=_QUAD, cn=_CONF),
)
def _(spark, sf):
    return R.confirmation(_state_inputs(spark, sf)).select("symbol", "trade_date", "dif_quadrant", "confirmation", "state_cap")


_TARGETS = f"""select *, ({_CAP}) as cap, case when sc <= -0.6 then 0 when sc <= -0.35 then 10 when sc <= -0.15 then 20 when sc <= 0.1 then 30 when sc <= 0.3 then 45 when sc <= 0.55 then 60 else 80 end as bt from (
            select *, greatest(-1, least(1, 0.35 * greatest(-1, least(1, (x4 + x8) / 2 / 0.08)) + 0.3 * greatest(-1, least(1, (e4 + e8) / 2))
              + 0.2 * greatest(-1, least(1, 0.4 * case when d > 0 then 1 else -1 end + 0.3 * case when f1 > 0 then 1 else -1 end + 0.3 * greatest(-1, least(1, coalesce(sl, 0) / 0.01))))
              + 0.15 * greatest(-1, least(1, -p10 / 0.15 - greatest(-dd / 0.25, 0) * 0.5)))) as sc from cn)"""


@REG.add(
    "position_targets",
    "S-07 F-13",
    with_views(
        f"""select {KEY}, {r('sc')} as strategy_score, bt::bigint as base_target, (round_even(least(bt, cap) / 5.0::double, 0) * 5)::bigint as final_target from (
          {_TARGETS})""",
        qd=_QUAD, cn=_CONF,
    ),
)
def _(spark, sf):
    return R.position_target(_state_inputs(spark, sf)).select("symbol", "trade_date", "strategy_score", "base_target", "final_target")


@REG.add(
    "volatility_targeted_positions",
    "S-07",
    with_views(
        f"""select t.symbol, {day('t.trade_date')} as trade_date, bt::bigint as base_target, cap::bigint as state_cap, (round_even(least(80, round_even(least(bt, cap) * greatest(0.75, least(1.25, 0.5 / greatest(coalesce(v.v26, 0.2), 1e-9))) / 5.0::double, 0) * 5) / 5.0::double, 0) * 5)::bigint as final_target
        from ({_TARGETS}) t join (select symbol, trade_date, case when count(rt) over f = 26 then stddev_pop(rt) over f * sqrt(52) end as v26 from (select *, close / lag(close) over (partition by symbol order by trade_date) - 1 as rt from w)
          window f as (partition by symbol order by trade_date rows between 25 preceding and current row)) v on v.symbol = t.symbol and v.trade_date = t.trade_date""",
        qd=_QUAD, cn=_CONF,
    ),
)
def _(spark, sf):
    w = I.volatility(V.bars_weekly(spark, sf), 26, 52, "pop", out="volatility_26").select("symbol", "trade_date", "volatility_26")
    out = R.position_target(_state_inputs(spark, sf).join(w, ["symbol", "trade_date"]), target_vol=0.5)
    return out.select("symbol", "trade_date", "base_target", "state_cap", "final_target")


_POL = """select event_id, (event_id % 21) * 5 as cur, (event_id % 11) / 10.0::double as up, (1 - (event_id % 11) / 10.0::double) * ((event_id % 7) / 7.0::double) as dn, case event_id % 3 when 0 then 'BOTTOM' when 1 then 'TOP' end as kind,
    case event_id % 5 when 0 then 'TEMPORALLY_CONSISTENT' when 1 then 'TYPE_CONFLICT' else 'UNCONFIRMED' end as cst, case when event_id % 13 = 0 then 'MODEL_DEGRADED' else 'MODEL_NORMAL' end as health, value as rel, (event_id % 101)::double as val from events"""
_POL_FN = """select *, case when weak then least(cur, 30) when t1 > cur and k <> 'BOTTOM' then cur when t1 < cur and k not in ('TOP', 'NONE') then cur else t1 end as t2 from (
    select *, case when val >= 90 then least(unc, case when k = 'TOP' then 30 else 70 end) when val <= 15 and unc > cur and k <> 'BOTTOM' then least(unc, cur + 10) else unc end as t1 from (
      select *, coalesce(kind, 'NONE') as k, health <> 'MODEL_NORMAL' as weak, case when abs(e) < 0.1 or side >= greatest(up, dn) or rel < 40 then cur when e >= 0.35 then 80 when e >= 0.2 then 70 when e >= 0.1 then 60 when e <= -0.35 then 20 when e <= -0.2 then 30 else 40 end as unc
      from (select *, up - dn as e, 1 - up - dn as side from pol)))"""
_POL_T3 = """select *, case when cst = 'TEMPORALLY_CONSISTENT' and rel >= 70 and abs(e) >= 0.35 then 20 else 10 end as fl, case when cst = 'TYPE_CONFLICT' and t2 > cur then cur else t2 end as t3 from pf"""


def _policy_rows(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.col("event_id")
    up = (k % 11) / 10.0
    down = (1 - up) * ((k % 7) / 7.0)
    return e.select(
        "event_id", ((k % 21) * 5).cast("int").alias("current"), up.alias("p_up"), down.alias("p_down"), (1 - up - down).alias("p_side"),
        F.when(k % 3 == 0, "BOTTOM").when(k % 3 == 1, "TOP").alias("action_kind"),
        F.when(k % 5 == 0, "TEMPORALLY_CONSISTENT").when(k % 5 == 1, "TYPE_CONFLICT").otherwise("UNCONFIRMED").alias("consistency"),
        F.when(k % 13 == 0, "MODEL_DEGRADED").otherwise("MODEL_NORMAL").alias("health"), F.col("value").alias("reliability"), (k % 101).cast("double").alias("valuation_percentile"),
    )


@REG.add(
    "policy_targets",
    "S-08 F-13",
    with_views(
        """select event_id, unc::bigint as uncapped, t as target, case when t > cur then 'BUY' when t < cur then 'SELL' else 'HOLD' end as action, case when e >= 0.3 then '7:3' when e >= 0.1 then '6:4' when e > -0.1 then '5:5' when e > -0.3 then '4:6' else '3:7' end as ratio
        from (select *, case when abs(t3 - cur) > fl + 60 then cur + sign(t3 - cur) * (fl + 60) else t3 end::bigint as t from p3)""",
        pol=_POL, pf=_POL_FN, p3=_POL_T3,
    ),
)
def _(spark, sf):
    return R.policy_target(_policy_rows(spark, sf)).select("event_id", "uncapped", "target", "action", "ratio")


@REG.add("policy_batches", "S-09")
def _(spark, sf):
    p = R.policy_target(_policy_rows(spark, sf))
    return p.select("event_id", F.size("batches").alias("batches"), F.abs(F.col("target") - F.col("current")).alias("total"), F.array_join("batches", "+").alias("split"))


@REG.add(
    "batch_schedule",
    "S-10 J-14",
    with_views(
        f"""select symbol, {day('trade_date')} as trade_date, k as batch, d::varchar as batch_date from (
          select w.symbol, w.trade_date, c.session_date as d, row_number() over (partition by w.symbol, w.trade_date order by c.session_date) as k, day(w.trade_date) % 5 as n from w join cal c on c.session_date > w.trade_date and c.session_date <= w.trade_date + 91) where k <= n"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf).select("symbol", "trade_date", (F.dayofmonth("trade_date") % 5).alias("n"))
    return R.batch_dates(w, V.calendar(spark, sf), "n").select("symbol", "trade_date", "batch", "batch_date")


@REG.add(
    "fusion_positions",
    "S-11",
    """select event_id, (round_even(greatest(0, least(80, case when f <= -0.6 then 0 when f <= -0.35 then 10 when f <= -0.15 then 20 when f <= 0.1 then 30 when f <= 0.3 then 45 when f <= 0.55 then 60 else 80 end - case when event_id % 4 = 0 then 5 else 0 end)) / 5.0::double, 0) * 5)::bigint as position
    from (select event_id, case when event_id % 6 = 0 then greatest(0, least(1, value / 100)) else 0.8::double * greatest(0, least(1, value / 100)) + 0.2::double * ((event_id % 10) / 10.0::double) end as f from events)""",
)
def _(spark, sf):
    k = F.col("event_id")
    up = F.when(k % 6 != 0, (k % 10) / 10.0)
    conflict = F.when(k % 4 == 0, "HIGH_CONFLICT").otherwise("NONE")
    return V.table(spark, sf, "events").select("event_id", R.fusion_position("value", up, F.lit(30), conflict).alias("position"))


@REG.add(
    "batch_states",
    "S-25",
    """select event_id, case when st in ('EXPIRED') then st when event_id % 11 = 0 then 'CANCELLED' when event_id % 13 = 0 then 'EXPIRED' when event_id % 17 = 0 then 'WAITING_CONFIRMATION' when event_id % 3 = 0 and st = 'ELIGIBLE' then 'EXECUTED_OBSERVED'
      when not (event_id % 2 = 0) or event_id % 9 < 5 then 'DEFERRED' when value > 30 then 'ELIGIBLE' else 'DEFERRED' end as next_state from (select event_id, value, case event_id % 4 when 0 then 'EXPIRED' when 1 then 'ELIGIBLE' else 'WAITING' end as st from events)""",
)
def _(spark, sf):
    k = F.col("event_id")
    e = V.table(spark, sf, "events").select(
        "event_id", F.when(k % 4 == 0, "EXPIRED").when(k % 4 == 1, "ELIGIBLE").otherwise("WAITING").alias("state"), (k % 2 == 0).alias("previous_executed"), (k % 9).alias("cooldown_sessions"),
        (F.col("value") > 30).alias("confirmation_met"), (k % 11 == 0).alias("invalidated"), (k % 13 == 0).alias("expired"), (k % 3 == 0).alias("execution_observed"), (k % 17 == 0).alias("not_started"),
    )
    return R.batch_state(e).select("event_id", "next_state")


@REG.add(
    "repair_eligibility",
    "S-27",
    with_views(
        """select w.symbol, count(*) filter (w.rn > p.p) as after, count(*) filter (w.rn - p.p >= 8) as eligible, (count(*) filter (w.rn - p.p >= 8) >= 8)::bigint as review_due from wn w
        join (select symbol, max(rn) - case when symbol like 'A%' then 10 else 30 end as p from wn group by symbol) p on p.symbol = w.symbol group by w.symbol"""
    ),
)
def _(spark, sf):
    w = B.bar_context(V.bars_weekly(spark, sf)).select("symbol", "ordinal")
    p = w.groupBy("symbol").agg(F.max("ordinal").alias("m")).select("symbol", (F.col("m") - F.when(F.col("symbol").startswith("A"), 10).otherwise(30)).alias("ordinal"))
    return R.eligible_after(w, p, ["symbol"])


_LP20 = {
    "lp": """select a.symbol, a.rn, a.trade_date, b.rn - a.rn as step, b.close / a.close - 1 as ret from wn a join wn b on b.symbol = a.symbol and b.rn between a.rn + 1 and a.rn + 20 join (select symbol, max(rn) as n from wn group by symbol) x on x.symbol = a.symbol where a.rn + 20 <= x.n""",
}


@REG.add(
    "path_targets",
    "S-28",
    with_views(
        f"""select {KEY}, (greatest(0, least(100, round_even(case when val >= 90 then case when top and t < 0 then least(raw, 15) else least(raw, 70) end when val <= 15 then case when bot and t >= 0 then greatest(raw, 80) else least(raw, 40) end else raw end / 5, 0) * 5)))::bigint as target,
          case when t >= 0.1 then '7:3' when t >= 0.03 then '6:4' when t > -0.03 then '5:5' when t > -0.1 then '4:6' else '3:7' end as ratio from (
          select *, 50 + t / 0.3 * 25 + greatest(-15, least(0, dd * 100 + 5)) as raw from (
            select symbol, trade_date, any_value(rn) as rn, arg_max(ret, step) as t, min((1 + ret) / pk - 1) as dd, any_value(rn) % 101 as val, any_value(rn) % 2 = 0 as top, any_value(rn) % 3 = 0 as bot from (
              select *, max(1 + ret) over (partition by symbol, trade_date order by step) as pk from lp) group by symbol, trade_date))""",
        **_LP20,
    ),
)
def _(spark, sf):
    p = L.label_path(B.bar_context(V.bars_weekly(spark, sf)), 20).where("path is not null")
    o = F.col("ordinal")
    p = p.withColumns(
        {"threshold": F.lit(0.3), "current": F.lit(30), "direction": F.when(F.element_at("path", -1) < 0, "down").otherwise("up"), "top_confirmed": o % 2 == 0, "bottom_confirmed": o % 3 == 0, "valuation_percentile": (o % 101).cast("double")}
    )
    return R.path_target(p).select("symbol", "trade_date", "target", "ratio")


@REG.add(
    "daily_path_adjustments",
    "S-28",
    with_views(
        f"""select {KEY}, (greatest(-10, least(10, round_even(n * 10 / 5, 0) * 5)))::bigint + 0 as position_adjustment, {r('n * 10')} as confidence_adjustment, case when n > 0.15 then 'bullish' when n < -0.15 then 'bearish' else 'neutral' end as correction_state
        from (select symbol, trade_date, greatest(-1, least(1, sum(ret / 10) / 0.075::double)) as n from lp where step <= 4 group by symbol, trade_date)""",
        **_LP20,
    ),
)
def _(spark, sf):
    p = L.label_path(V.bars_weekly(spark, sf), 20).where("path is not null").withColumn("corr", F.transform("path", lambda x: x / 10))
    return p.select("symbol", "trade_date", *[v.alias(k) for k, v in R.daily_adjustments("corr").items()])


@REG.add(
    "external_targets",
    "S-29",
    """select event_id, t as target, ceil(t / 10.0::double)::bigint as batches from (
      select event_id, case when event_type = 'error' then 0 else (round_even(case when p >= 0.6 then 40 when p >= 0.5 then 20 when p >= 0.4 then 10 else 0 end * (case when event_id % 2 = 0 then 1.0 else 0.5 end)::double / 5, 0) * 5) end::bigint as t from (select *, least(1, greatest(0, value / 100)) as p from events))""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "BEARISH").otherwise("BULLISH").alias("trend"), (F.col("value") / 100).alias("probability"), F.when(F.col("event_id") % 2 == 0, "LOW").otherwise("HIGH").alias("risk_level")
    )
    return R.external_target(e).select("event_id", "target", F.size("batches").alias("batches"))


@REG.add("greedy_batches", "S-30 F-14")
def _(spark, sf):
    amount = (F.col("event_id") % 21) * 5
    shares = A.largest_remainder(amount, [0.4, 0.3, 0.2, 0.1])
    return V.table(spark, sf, "events").select("event_id", amount.alias("amount"), F.array_join(A.split_greedy(amount), "+").alias("greedy"), F.array_join(shares, "+").alias("shares"))


@REG.add(
    "largest_remainder_shares",
    "F-14",
    """select event_id, string_agg((b + case when rk <= left_over then 1 else 0 end)::bigint::varchar, '+' order by i) as shares from (
      select *, t - sum(b) over (partition by event_id) as left_over, row_number() over (partition by event_id order by round(x - b, 12) desc, i) as rk from (
        select event_id, i, t, t * w as x, floor(t * w) as b from (select event_id, event_id % 97 as t from events), (values (0, 0.4::double), (1, 0.35::double), (2, 0.25::double)) ws(i, w))) group by event_id""",
)
def _(spark, sf):
    shares = A.largest_remainder(F.col("event_id") % 97, [0.4, 0.35, 0.25])
    return V.table(spark, sf, "events").select("event_id", F.array_join(F.transform(shares, lambda x: x.cast("bigint")), "+").alias("shares"))


@REG.add(
    "conflict_states",
    "M-35",
    """select event_id, case when a >= 0.5 and b >= 0.5 then case when least(a, b) >= 0.65 then 'CONSENSUS_STRONG_BULL' else 'CONSENSUS_BULL' end when a < 0.5 and b < 0.5 then case when greatest(a, b) <= 0.35 then 'CONSENSUS_STRONG_BEAR' else 'CONSENSUS_BEAR' end else 'CONSENSUS_NEUTRAL' end as consensus,
      case when a >= 0.5 and b < 0.5 then 'LOCAL_BULL_EXTERNAL_BEAR' when a < 0.5 and b >= 0.5 then 'LOCAL_BEAR_EXTERNAL_BULL' when abs(a - b) >= 0.25 then 'HIGH_CONFLICT' else 'NONE' end as conflict from (select event_id, value / 100 as a, (event_id % 100) / 100.0::double as b from events)""",
)
def _(spark, sf):
    c = R.conflict_state(F.col("value") / 100, (F.col("event_id") % 100) / 100.0)
    return V.table(spark, sf, "events").select("event_id", c["consensus"].alias("consensus"), c["conflict"].alias("conflict"))
