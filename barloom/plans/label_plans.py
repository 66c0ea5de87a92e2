"""Queries over labels, evaluation and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import arrays as A, scalar as S
from barloom.operators import bars as B, labels as L, panel as P, pit
from barloom.plans import views as V
from barloom.plans.registry import REG
from barloom.plans.sqlviews import day, r, with_views

KEY = f"symbol, {day('trade_date')} as trade_date"
OW = "(partition by symbol order by trade_date)"
AS_OF = "2001-06-27"

# Long form of the 13-week label paths, one row per (symbol, anchor, step).
LP = {
    "lp": """select a.symbol, a.rn, a.trade_date, b.rn - a.rn as step, b.close / a.close - 1 as ret from wn a
      join wn b on b.symbol = a.symbol and b.rn between a.rn + 1 and a.rn + 13 join (select symbol, max(rn) as n from wn group by symbol) x on x.symbol = a.symbol where a.rn + 13 <= x.n"""
}


def _paths(spark, sf):
    return L.label_path(V.bars_weekly(spark, sf), 13).where("path is not null")


@REG.add(
    "label_paths",
    "L-01 J-10",
    with_views(f"select {KEY}, step, {r('ret')} as ret from lp", **LP),
)
def _(spark, sf):
    return L.explode_path(_paths(spark, sf), ["symbol", "trade_date"])


@REG.add(
    "label_maturity",
    "L-02",
    with_views(
        f"""select symbol, case when k >= 13 then 'FULLY_MATURE_13W' when k >= 8 then 'MATURE_8W' when k >= 4 then 'MATURE_4W' when k >= 1 then 'MATURE_1W' else 'IMMATURE' end as maturity, count(*) as n
        from (select symbol, max(rn) over (partition by symbol) - rn as k from wn where trade_date <= date '{AS_OF}') group by all"""
    ),
)
def _(spark, sf):
    return L.realised_weeks(V.bars_weekly(spark, sf), AS_OF).groupBy("symbol", "maturity").agg(F.count("*").alias("n"))


@REG.add(
    "matured_labels",
    "L-04",
    with_views(f"select symbol, count(*) as n, max(trade_date)::varchar as last_anchor from (select symbol, trade_date, lead(trade_date, 13) over {OW} as e from w) where e <= date '{AS_OF}' group by symbol"),
)
def _(spark, sf):
    m = L.eligible_matured(L.label_path(V.bars_weekly(spark, sf), 13), AS_OF)
    return m.groupBy("symbol").agg(F.count("*").alias("n"), F.max("trade_date").alias("last_anchor"))


@REG.add(
    "verified_week_counts",
    "L-03 A-04",
    with_views(
        f"""select w.symbol, {day('w.trade_date')} as trade_date, coalesce((select min(o) from cov z where z.symbol = w.symbol and z.o > c.o and not z.good), c.n + 1) - c.o - 1 as verified
        from w join cov c on c.symbol = w.symbol and c.week = w.period""",
        cov=f"""select s.symbol, week, row_number() over (partition by s.symbol order by week) as o, count(*) over (partition by s.symbol) as n, have = sessions and last_session <= date '{AS_OF}' as good from (
          select s.symbol, date_trunc('week', c.session_date) as week, count(*) as sessions, count(d.trade_date) as have, max(c.session_date) as last_session
          from (select distinct symbol from d) s, cal c left join d on d.symbol = s.symbol and d.trade_date = c.session_date group by all) s""",
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf)
    cal = V.calendar(spark, sf)
    # every symbol is held to the whole calendar: its two ends as scalar subqueries
    lo, hi = (cal.select(f("session_date")).scalar() for f in (F.min, F.max))
    ends = d.select("symbol").distinct().withColumns({"lo": lo, "hi": hi}).select("symbol", F.explode(F.array("lo", "hi")).alias("trade_date"))
    expected = B.calendar_by_key(ends, cal)
    return L.verified_weeks(V.bars_weekly(spark, sf).select("symbol", "trade_date"), L.week_coverage(d, expected), AS_OF)


@REG.add(
    "projected_label_ends",
    "L-17",
    with_views(
        f"""select {KEY}, e::varchar as label_end from w join (select week, lead(last_session, 13) over (order by week) as e from (
          select date_trunc('week', session_date)::date as week, max(session_date) as last_session from cal group by 1)) x on x.week = w.period"""
    ),
)
def _(spark, sf):
    return L.label_end(V.calendar(spark, sf), V.bars_weekly(spark, sf).select("symbol", "trade_date"), 13)


@REG.add(
    "label_turn_steps",
    "L-06 K-03",
    with_views(
        f"""select {KEY}, arg_min(step, (-ret, step)) as high_step, arg_min(step, (ret, step)) as low_step, {r('arg_max(ret, step)')} as terminal,
          case when arg_max(ret, step) >= 0 then arg_min(step, (-ret, step)) else arg_min(step, (ret, step)) end as price_turn_step, case when arg_max(ret, step) >= 0 then 'top' else 'bottom' end as price_turn_kind
        from lp group by symbol, trade_date""",
        **LP,
    ),
)
def _(spark, sf):
    return L.label_turns(L.explode_path(_paths(spark, sf), ["symbol", "trade_date"]), ["symbol", "trade_date"])


@REG.add(
    "label_20_sessions",
    "L-15",
    with_views(
        f"""select {KEY}, max(case when step = 15 then case when c >= close then 1 else -1 end end)::bigint as direction_15, arg_min(step, (c, step)) as low_day, arg_min(step, (-c, step)) as high_day
        from (select a.symbol, a.trade_date, a.close, b.rn - a.rn as step, b.close as c from dn a join dn b on b.symbol = a.symbol and b.rn between a.rn + 1 and a.rn + 20) group by symbol, trade_date having count(*) = 20"""
    ),
)
def _(spark, sf):
    return L.label_20d(V.bars_daily(spark, sf)).where("low_day is not null").select("symbol", "trade_date", "direction_15", "low_day", "high_day")


def _predictions(spark, sf):
    """Rule predictions per weekly bar and the daily rows of their next 13 weeks."""
    w = B.bar_context(V.bars_weekly(spark, sf)).withColumn("past", F.col("close") / F.lag("close", 4).over(P.ordered()) - 1)
    n = w.groupBy("symbol").agg(F.max("ordinal").alias("_n"))
    w = w.join(n, "symbol").where("past is not null")
    p = w.select(
        "symbol", F.col("ordinal").alias("anchor"), F.col("close").alias("baseline"),
        F.when(F.col("past") > 0.1, "up").when(F.col("past") < -0.1, "down").otherwise("neutral").alias("predicted_direction"),
        F.when(F.col("past") > 0.1, "buy").when(F.col("past") < -0.1, "sell").otherwise("hold").alias("operation_side"),
        (0.5 + F.least(F.abs("past"), F.lit(0.4))).alias("probability"),
        (F.col("ordinal") % 20 + 1).alias("predicted_step"), (F.col("ordinal") % 12).alias("trade_count"),
        F.least(F.col("_n") - F.col("ordinal"), F.lit(13)).alias("verified"),
    )
    d = V.bars_daily(spark, sf).select("symbol", "trade_date", "close", S.week_start("trade_date").alias("period"))
    weeks = w.select("symbol", "period", "ordinal")
    d = d.join(weeks, ["symbol", "period"])
    rows = d.select("symbol", "trade_date", "close", "ordinal", F.explode(F.sequence(F.greatest(F.col("ordinal") - 13, F.lit(1)), F.greatest(F.col("ordinal") - 1, F.lit(1)))).alias("anchor"))
    rows = rows.where("anchor < ordinal").withColumn("week_no", F.col("ordinal") - F.col("anchor"))
    return p, rows.withColumn("step", F.row_number().over(P.ordered(["symbol", "anchor"], "trade_date"))).select("symbol", "anchor", "step", "week_no", "close")


_PRED = {
    "pr0": f"select *, close / lag(close, 4) over {OW} - 1 as past, max(rn) over (partition by symbol) as n from wn",
    "pr": """select symbol, rn as anchor, close as baseline, past, least(n - rn, 13) as verified, rn % 20 + 1 as pstep, rn % 12 as trades, 0.5 + least(abs(past), 0.4) as prob,
      case when past > 0.1 then 'up' when past < -0.1 then 'down' else 'neutral' end as dir, case when past > 0.1 then 'buy' when past < -0.1 then 'sell' else 'hold' end as side,
      case when n - rn >= 13 then 13 when n - rn >= 4 then 4 when n - rn >= 1 then 1 else 0 end as wk from pr0 where past is not null""",
    "hz": """select p.*, d.close as c, row_number() over (partition by p.symbol, p.anchor order by d.trade_date) as step from pr p join wn x on x.symbol = p.symbol and x.rn > p.anchor and x.rn <= p.anchor + p.wk
      join d on d.symbol = x.symbol and date_trunc('week', d.trade_date) = x.period""",
    "hg": """select symbol, anchor, any_value(baseline) as b, any_value(dir) as dir, any_value(side) as side, any_value(prob) as prob, any_value(pstep) as pstep, any_value(trades) as trades, any_value(wk) as wk,
      count(*) as n, arg_max(c, step) as last, min(c) as lo, max(c) as hi, arg_min(step, (c, step)) as ls, arg_min(step, (-c, step)) as hs from hz group by symbol, anchor""",
    "hl": """select *, case when last > b then 'up' when last < b then 'down' else 'neutral' end as act, case side when 'sell' then hs when 'buy' then ls end - pstep as dev,
      case dir when 'up' then (b - lo) / b when 'down' then (hi - b) / b else greatest((b - lo) / b, (hi - b) / b) end as adv from hg""",
    "ll": """select *, pow(prob - (dir = act)::int, 2) as cal, case when wk = 13 then case when side = 'hold' then 0 else least(abs(dev)::double / greatest(n - 1, 1), 1) end end as turn, least(greatest(adv, 0), 1) as adverse, least(trades / 10.0::double, 1) as ov from hl""",
}


@REG.add(
    "label_losses",
    "L-05",
    with_views(
        f"""select symbol, anchor, case wk when 13 then 'mature_13w' when 4 then 'mature_4w' else 'partial_1w' end as status, act as actual_direction, (dir = act)::bigint as direction_hit, {r('cal')} as direction_calibration,
        {r('turn')} as turning_deviation, {r('case when wk = 13 then 0.45 * turn + 0.3 * cal + 0.15 * adverse + 0.1 * ov end')} as total_loss from ll""",
        **_PRED,
    ),
)
def _(spark, sf):
    p, h = _predictions(spark, sf)
    out = L.label_losses(p, h, ["symbol", "anchor"]).where("status <> 'pending'")
    return out.select("symbol", "anchor", "status", "actual_direction", "direction_hit", "direction_calibration", "turning_deviation", "total_loss")


@REG.add(
    "rolling_label_metrics",
    "A-10",
    with_views(
        f"""select symbol, wd as "window", count(*) as samples, {r('avg(0.45 * turn + 0.3 * cal + 0.15 * adverse + 0.1 * ov)')} as total_loss, {r('avg((dir = act)::int)')} as direction_hit, {r('avg(cal)')} as direction_calibration
        from (select *, row_number() over (partition by symbol order by anchor desc) as k from ll where wk = 13), (values ('20', 20), ('52', 52)) ws(wd, m) where k <= m group by symbol, wd""",
        **_PRED,
    ),
)
def _(spark, sf):
    p, h = _predictions(spark, sf)
    mature = L.label_losses(p, h, ["symbol", "anchor"]).where("status = 'mature_13w'")
    return L.rolling_metrics(mature, ["total_loss", "direction_hit", "direction_calibration"], "anchor")


@REG.add(
    "deviation_curve",
    "L-16",
    with_views(
        f"""select p.symbol, p.anchor, {r('last_value(r20 ignore nulls) over o')} as rolling_20, {r('last_value(r52 ignore nulls) over o')} as rolling_52 from pr p left join (
          select symbol, anchor, case when count(*) over f20 = 20 then avg(abs(dev)) over f20 end as r20, case when count(*) over f52 = 52 then avg(abs(dev)) over f52 end as r52 from ll where wk = 13 and dev is not null
          window f20 as (partition by symbol order by anchor rows between 19 preceding and current row), f52 as (partition by symbol order by anchor rows between 51 preceding and current row)) x
          on x.symbol = p.symbol and x.anchor = p.anchor window o as (partition by p.symbol order by p.anchor)""",
        **_PRED,
    ),
)
def _(spark, sf):
    p, h = _predictions(spark, sf)
    out = L.label_losses(p, h, ["symbol", "anchor"])
    return L.deviation_curve(out, "anchor", "deviation_sessions").select("symbol", "anchor", "rolling_20", "rolling_52")


@REG.add(
    "iteration_curve",
    "L-14",
    with_views(
        f"""select symbol, anchor, row_number() over o as iteration, {r('avg(cal) over f')} as rolling_loss, {r('avg((dir = act)::int) over f')} as rolling_accuracy, {r('min(cal) over o')} as best_loss from ll
        window o as (partition by symbol order by anchor), f as (partition by symbol order by anchor rows between 19 preceding and current row)""",
        **_PRED,
    ),
)
def _(spark, sf):
    p, h = _predictions(spark, sf)
    out = L.label_losses(p, h, ["symbol", "anchor"]).where("status <> 'pending'")
    return L.iteration_curve(out, "anchor", "direction_calibration", "direction_hit").select("symbol", "anchor", "iteration", "rolling_loss", "rolling_accuracy", "best_loss")


# ---- forecast evaluation -----------------------------------------------------------------

def scored(spark, sf, lookback: int = 52):
    f = V.forecasts(V.bars_weekly(spark, sf), lookback).where("actual is not null")
    return f.withColumn("actual_class", L.direction_class("actual", 0.05))


_CLASS = "case when actual > 0.05 then 'UP' when actual < -0.05 then 'DOWN' else 'SIDEWAYS' end"
_HALF = f"0.5 * (pow(p_up - ({_CLASS} = 'UP')::int, 2) + pow(p_side - ({_CLASS} = 'SIDEWAYS')::int, 2) + pow(p_down - ({_CLASS} = 'DOWN')::int, 2))"
_WIS = "(0.5 * abs(actual - p50) + 0.1 * (p90 - p10 + 10 * greatest(p10 - actual, actual - p90, 0))) / 1.5"


@REG.add(
    "forecast_path_errors",
    "L-07",
    with_views(f"select symbol, h, {r('avg(abs(p50 - actual))')} as mae, {r('sqrt(avg(pow(p50 - actual, 2)))')} as rmse, count(actual) as n, {r('avg(abs(p50 - actual) / greatest(p90 - p10, 0.01))')} as normalised_mae from fc where actual is not null group by symbol, h"),
)
def _(spark, sf):
    return L.path_errors(scored(spark, sf), ["symbol", "h"], "p50", "actual", F.col("p90") - F.col("p10"))


@REG.add(
    "brier_scores",
    "L-08",
    with_views(f"select symbol, h, {r(f'avg({_HALF})')} as brier_half, {r(f'avg({_HALF} * 2 / 3)')} as brier_third, {r('avg(pow(p_up - (actual > 0.05)::int, 2))')} as brier_binary from fc where actual is not null group by symbol, h"),
)
def _(spark, sf):
    args = ("p_up", "p_side", "p_down", "actual_class")
    return scored(spark, sf).groupBy("symbol", "h").agg(
        F.avg(L.brier(*args)).alias("brier_half"), F.avg(L.brier(*args, kind="third")).alias("brier_third"), F.avg(L.brier(*args, kind="binary")).alias("brier_binary")
    )


_PIN = " + ".join(f"greatest({q} * (actual - {c}), ({q} - 1) * (actual - {c}))" for q, c in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")))


@REG.add(
    "interval_scores",
    "L-09",
    with_views(
        f"""select symbol, h, {r(f'avg({_WIS})')} as wis, {r(f'avg(({_PIN}) / 3)')} as pinball, {r('avg((actual between p10 and p90)::int)')} as coverage, {r('avg(greatest(p10 - actual, 0) + greatest(actual - p90, 0))')} as outside,
        {r('abs(avg((actual between p10 and p90)::int) - 0.8)')} as coverage_penalty from fc where actual is not null group by symbol, h"""
    ),
)
def _(spark, sf):
    return L.interval_scores(scored(spark, sf), ["symbol", "h"])


@REG.add(
    "path_risk",
    "L-10 F-08",
    with_views(
        f"""select {KEY}, {r('max((peak - wealth) / peak)')} as max_drawdown, {r('stddev_pop(inc) filter (step > 0) * sqrt(52)')} as volatility from (
          select *, max(wealth) over (partition by symbol, trade_date order by step) as peak, ln(wealth / lag(wealth) over (partition by symbol, trade_date order by step)) as inc from (
            select symbol, trade_date, step, 1 + ret as wealth from lp union all select distinct symbol, trade_date, 0, 1.0::double from lp)) group by symbol, trade_date""",
        **LP,
    ),
)
def _(spark, sf):
    return _paths(spark, sf).select("symbol", "trade_date", A.path_max_drawdown("path").alias("max_drawdown"), A.path_volatility("path").alias("volatility"))


@REG.add(
    "path_risk_errors",
    "L-10 L-11",
    with_views(
        f"""select a.symbol, count(*) as n, {r('avg(abs(a.dd - b.dd))')} as drawdown_error, {r('avg(abs(a.v - b.v))')} as volatility_error from pv a join pv b on b.symbol = a.symbol and b.rn = a.rn - 13 group by a.symbol""",
        **LP,
        pv="""select symbol, rn, max((peak - wealth) / peak) as dd, stddev_pop(inc) filter (step > 0) * sqrt(52) as v from (
          select *, max(wealth) over (partition by symbol, rn order by step) as peak, ln(wealth / lag(wealth) over (partition by symbol, rn order by step)) as inc from (
            select symbol, rn, step, 1 + ret as wealth from lp union all select distinct symbol, rn, 0, 1.0::double from lp)) group by symbol, rn""",
    ),
)
def _(spark, sf):
    p = B.bar_context(V.bars_weekly(spark, sf))
    p = L.label_path(p, 13).where("path is not null").select("symbol", "ordinal", "path")
    prev = p.select("symbol", (F.col("ordinal") + 13).alias("ordinal"), F.col("path").alias("predicted"))
    e = L.risk_errors(p.join(prev, ["symbol", "ordinal"]), "predicted", "path")
    return e.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("drawdown_error").alias("drawdown_error"), F.avg("volatility_error").alias("volatility_error"))


@REG.add(
    "composite_losses",
    "L-11",
    with_views(
        f"""select symbol, {r(f'avg(0.35 * abs(p50 - actual) + 0.15 * greatest(p10 - actual, actual - p90, 0) + 0.15 * abs(p50 - actual) + 0.15 * ({_HALF}) + 0.10 * h / 13.0::double + 0.10 * p_side)')} as loss from fc where actual is not null group by symbol"""
    ),
)
def _(spark, sf):
    f = scored(spark, sf)
    e = F.abs(F.col("p50") - F.col("actual"))
    parts = {
        "path": e, "quantile": L.outside_mass("p10", "p90", "actual"), "terminal": e,
        "direction": L.brier("p_up", "p_side", "p_down", "actual_class"), "timing": F.col("h") / 13.0, "position": F.col("p_side"),
    }
    return f.groupBy("symbol").agg(F.avg(L.composite_loss(parts, L.ANALOGUE_WEIGHTS)).alias("loss"))


_TREND = "case when p_up > 0.5 then 'BULLISH' when p_up > p_down then 'NEUTRAL_BULLISH' when p_down > 0.5 then 'BEARISH' else 'NEUTRAL_BEARISH' end"


@REG.add(
    "external_forecast_evaluation",
    "L-12",
    with_views(
        f"""select symbol, count(*) as n, count(*) filter (hit) as hits, {r('avg(abs(e4 - a4))')} as mae_4, {r('avg(abs(e8 - a8))')} as mae_8, {r('avg(pow(u4 - (a4 > 0)::int, 2))')} as brier_4, count(*) filter (a8 >= 0.05 and bull) as recognised,
          count(*) filter (a8 >= 0.05 and not bull) as missed, count(*) filter (a8 >= -0.03 and not bull) as false_alarms
        from (select x.symbol, x.p50 as e8, x.actual as a8, y.p50 as e4, y.actual as a4, y.p_up as u4, {_TREND.replace('p_', 'x.p_')} like '%BULLISH' as bull, case when {_TREND.replace('p_', 'x.p_')} like '%BULLISH' then x.actual > 0 else x.actual < 0 end as hit
          from fc x join fc y on y.symbol = x.symbol and y.anchor = x.anchor and y.h = 4 where x.h = 8 and x.actual is not null) group by symbol"""
    ),
)
def _(spark, sf):
    f = V.forecasts(V.bars_weekly(spark, sf))
    x = f.where("h = 8 and actual is not null").select("symbol", "anchor", F.col("p50").alias("expected_8"), F.col("actual").alias("actual_8"), F.col("p_up").alias("p_up_8"), "p_up", "p_down")
    y = f.where("h = 4").select("symbol", "anchor", F.col("p50").alias("expected_4"), F.col("actual").alias("actual_4"), F.col("p_up").alias("p_up_4"))
    trend = F.when(F.col("p_up") > 0.5, "BULLISH").when(F.col("p_up") > F.col("p_down"), "NEUTRAL_BULLISH").when(F.col("p_down") > 0.5, "BEARISH").otherwise("NEUTRAL_BEARISH")
    e = L.evaluate_external(x.join(y, ["symbol", "anchor"]).withColumn("trend", trend))
    return e.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if("direction_hit").alias("hits"), F.avg("mae_4").alias("mae_4"), F.avg("mae_8").alias("mae_8"), F.avg("brier_4").alias("brier_4"),
        F.count_if("strong_up_recognised").alias("recognised"), F.count_if("up_missed").alias("missed"), F.count_if("down_false_alarm").alias("false_alarms"),
    )


@REG.add(
    "residual_paths",
    "L-13",
    with_views(
        f"""select a.symbol, {day('a.trade_date')} as trade_date, a.step, {r('(ln(1 + a.ret) - ln(1 + b.ret)) / 0.05')} as standardised from lp a join lp b on b.symbol = a.symbol and b.rn = a.rn - 13 and b.step = a.step""",
        **LP,
    ),
)
def _(spark, sf):
    p = L.label_path(B.bar_context(V.bars_weekly(spark, sf)), 13).where("path is not null").select("symbol", "trade_date", "ordinal", "path")
    prev = p.select("symbol", (F.col("ordinal") + 13).alias("ordinal"), F.col("path").alias("predicted"))
    e = L.residual_records(p.join(prev, ["symbol", "ordinal"]).withColumn("sigma", F.lit(0.05)), "predicted", "path", "sigma")
    return L.explode_path(e, ["symbol", "trade_date"], "standardised", value="standardised")


@REG.add(
    "path_shapes",
    "F-10",
    with_views(
        f"""select symbol, count(*) as n, case when abs(t) <= s and hi - lo <= 3 * s then 'RANGE' when lo_i < 6 and t - lo > s then 'V_SHAPE' when hi_i < 6 and hi - t > s then 'INVERTED_V' when t > 0 then 'TREND_UP' else 'TREND_DOWN' end as shape
        from (select symbol, rn, arg_max(ret, step) as t, greatest(stddev_pop(ret), 0.01) as s, min(ret) as lo, max(ret) as hi, arg_min(step, (ret, step)) - 1 as lo_i, arg_min(step, (-ret, step)) - 1 as hi_i from lp group by symbol, rn) group by all""",
        **LP,
    ),
)
def _(spark, sf):
    return _paths(spark, sf).groupBy("symbol", A.path_shape("path").alias("shape")).agg(F.count("*").alias("n"))


@REG.add(
    "array_path_functions",
    "F-08 F-10",
    with_views(
        f"""select {KEY}, arg_min(step, (-ret, step)) as best_step, arg_min(step, (ret, step)) as worst_step, {r('arg_max(ret, step)')} as terminal, {r('max(inc)')} as largest_step, {r('stddev_pop(ret)')} as deviation
        from (select *, ret - coalesce(lag(ret) over (partition by symbol, trade_date order by step), 0) as inc from lp) group by symbol, trade_date""",
        **LP,
    ),
)
def _(spark, sf):
    steps = A.increments("path")
    return _paths(spark, sf).select(
        "symbol", "trade_date", A.argmax("path").alias("best_step"), A.argmin("path").alias("worst_step"), F.element_at(A.cumulate(steps), -1).alias("terminal"),
        F.array_max(steps).alias("largest_step"), A.std_pop("path").alias("deviation"),
    )
