"""Queries over reports and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import features as FE, indicators as I, ledger as LG, panel as P, prices as X, reports as R
from barloom.plans import views as V
from barloom.plans.model_plans import _SG, _WINDOWS, _two_accounts
from barloom.plans.registry import REG
from barloom.plans.rule_plans import _state_inputs
from barloom.operators import rules as RU
from barloom.functions import arrays as A
from barloom.plans.sqlviews import day, r, with_views

KEY = f"symbol, {day('trade_date')} as trade_date"
OW = "(partition by symbol order by trade_date)"


@REG.add(
    "latest_cards",
    "A-15",
    with_views(
        f"""select symbol, {day('trade_date')} as trade_date, {r('close')} as latest, {r('p')} as previous, {r('close - p')} as change, {r('close / p - 1')} as change_ratio from (select *, lag(close) over {OW} as p from d) qualify row_number() over (partition by symbol order by trade_date desc) = 1"""
    ),
)
def _(spark, sf):
    return R.latest_card(V.bars_daily(spark, sf))


@REG.add(
    "market_context",
    "A-16",
    with_views(
        f"""select a.symbol, {r('a.r1')} as d_ret_1, {r('a.r5')} as d_ret_5, {r('a.m')} as d_ma20_distance, {r('b.r4')} as w_ret_4, {r('b.r8')} as w_ret_8, {r('b.m')} as w_ma20_distance, {r('a.s')} as closes_sum from (
          select symbol, close / lag(close) over {OW} - 1 as r1, close / lag(close, 5) over {OW} - 1 as r5, close / avg(close) over (partition by symbol order by trade_date rows between 19 preceding and current row) - 1 as m,
            sum(close) over (partition by symbol order by trade_date rows between 9 preceding and current row) as s from d qualify row_number() over (partition by symbol order by trade_date desc) = 1) a
        join (select symbol, close / lag(close, 4) over {OW} - 1 as r4, close / lag(close, 8) over {OW} - 1 as r8, close / avg(close) over (partition by symbol order by trade_date rows between 19 preceding and current row) - 1 as m from w
          qualify row_number() over (partition by symbol order by trade_date desc) = 1) b on b.symbol = a.symbol"""
    ),
)
def _(spark, sf):
    c = R.market_context(V.bars_daily(spark, sf), V.bars_weekly(spark, sf))
    return c.select("symbol", "d_ret_1", "d_ret_5", "d_ma20_distance", "w_ret_4", "w_ret_8", "w_ma20_distance", A.total("d_closes").alias("closes_sum"))


def _candidates(spark, sf):
    c, n = V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    why = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, F.lit("RETURN")), F.when(F.col("c_custkey") % 3 == 0, F.lit("DRAWDOWN")), F.when(F.col("c_custkey") % 7 == 0, F.lit("WIN_RATE"))))
    return j.select(F.col("n_regionkey").cast("string").alias("market"), why.alias("reasons"), (F.col("c_custkey") % 5 == 0).alias("identical"))


@REG.add(
    "candidate_totals",
    "A-11",
    """select coalesce(market, 'ALL') as market, count(*) as candidates, count(*) filter (k % 5 = 0) as identical, count(*) filter (not (bal < 0) and k % 3 <> 0 and k % 7 <> 0) as accepted from (
      select n_regionkey::varchar as market, c_custkey as k, c_acctbal as bal from customer join nation on c_nationkey = n_nationkey) group by rollup (market)""",
)
def _(spark, sf):
    return R.candidate_summary(_candidates(spark, sf), "market", "reasons", "identical")[0]


@REG.add(
    "candidate_reasons",
    "A-11",
    """select market, reason, count(*) as n from (select n_regionkey::varchar as market, unnest([x for x in [case when c_acctbal < 0 then 'RETURN' end, case when c_custkey % 3 = 0 then 'DRAWDOWN' end, case when c_custkey % 7 = 0 then 'WIN_RATE' end] if x is not null]) as reason
      from customer join nation on c_nationkey = n_nationkey) group by all""",
)
def _(spark, sf):
    return R.candidate_summary(_candidates(spark, sf), "market", "reasons", "identical")[1]


@REG.add(
    "decision_funnel",
    "A-12",
    with_views(
        f"""select symbol, count(*) as "rows", count(*) filter (k <= 52) as recent_rows, count(*) filter (a) as rising, count(*) filter (a and k <= 52) as recent_rising, count(*) filter (a and b) as confirmed, count(*) filter (a and b and k <= 52) as recent_confirmed,
          {r('count(*) filter (a and k <= 52) / 52.0::double')} as recent_rising_ratio, {r('count(*) filter (a and b and k <= 52) / 52.0::double')} as recent_confirmed_ratio
        from (select symbol, coalesce(close > lag(close) over {OW}, false) as a, close > open as b, row_number() over (partition by symbol order by trade_date desc) as k from w) group by symbol"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf).withColumn("up", F.coalesce(F.col("close") > F.lag("close").over(P.ordered()), F.lit(False)))
    return R.decision_funnel(w, ["symbol"], {"rising": F.col("up"), "confirmed": F.col("up") & (F.col("close") > F.col("open"))}, "trade_date")


@REG.add(
    "market_report",
    "A-13",
    with_views(
        f"""select symbol, count(*) as n, {r('avg(x)')} as mean, {r('quantile_cont(x, 0.5)')} as median, {r('min(x)')} as low, {r('max(x)')} as high, count(*) filter (x > 0) as positive, min(trade_date)::varchar as first_date, max(trade_date)::varchar as last_date
        from (select symbol, trade_date, close / lag(close) over {OW} - 1 as x from w) group by symbol"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf).select("symbol", "trade_date", X.ret("close").alias("x"))
    return R.market_report(w, ["symbol"], "x", "trade_date")


@REG.add(
    "indicator_staleness",
    "A-19",
    with_views(
        """select symbol, count(*) filter (trade_date > date '2001-10-01' and symbol like 'A%') as missing, 0::bigint as orphan, (count(*) filter (trade_date > date '2001-10-01' and symbol like 'A%') > 0)::bigint as stale from w group by symbol"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf)
    ind = I.macd(w).where("not (trade_date > date'2001-10-01' and symbol like 'A%')")
    return R.indicator_staleness(w, ind, ["dif", "dea"]).select("symbol", "missing", "orphan", "stale")


@REG.add("binding_statistics", "A-23")
def _(spark, sf):
    t = RU.position_target(_state_inputs(spark, sf)).withColumn("batches", A.split_batches("final_target", 10, 20))
    return R.binding_stats(t, ["symbol"], "trade_date")


@REG.add(
    "activity_health",
    "A-24",
    with_views(
        f"""select symbol, count(*) as strong_windows, {r('avg(posb)')} as exposure, (count(*) >= 3 and avg(posb) < 10)::bigint as degraded from (select wp.*, (select arg_max(close, trade_date) / arg_min(close, trade_date) - 1 from w z where z.symbol = wp.symbol and z.trade_date between wp.we0 and wp.window_end) as mk
          from (select p.*, (select min(trade_date) from sg s where s.symbol = p.symbol and s.rn = p.window_start) as we0 from wpx p) wp) where window_end <= date '2001-10-01' and window_end >= date '2001-10-01' - 182 and mk >= 0.05 group by symbol""",
        sg=_SG, wpx=_WINDOWS,
    ),
)
def _(spark, sf):
    a = _two_accounts(spark, sf)
    p = LG.window_panel(V.bars_weekly(spark, sf).withColumn("x", X.ret("close")).where("x is not null").select("symbol", "trade_date", "close"), 8)
    ev = p.groupBy("symbol", "window_start").agg(F.max("trade_date").alias("window_end"), (F.max_by("close", "window_step") / F.min_by("close", "window_step") - 1).alias("actual_return"))
    return R.activity_health(ev.drop("window_start"), a.select("symbol", "window_end", F.col("candidate_position").alias("average_position")), ["symbol"], "2001-10-01")


@REG.add(
    "state_audit",
    "A-26",
    "select o_orderpriority, o_orderstatus, count(*) as \"rows\", min(o_orderdate)::date::varchar as first_date, max(o_orderdate)::date::varchar as last_date, count(distinct o_orderdate::date) as dates from orders group by all",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return R.state_audit(o, ["o_orderpriority"], "o_orderstatus", "d")


@REG.add(
    "review_context",
    "A-27",
    with_views(
        f"""select symbol, count(*) filter (k <= 16) as forecasts, count(*) filter (k <= 26) as decisions, min(trade_date) filter (k <= 16)::varchar as oldest_forecast, {r('sum(close) filter (k <= 26)')} as decision_sum from (
          select *, row_number() over (partition by symbol order by trade_date desc) as k from w where trade_date <= date '2001-06-27') group by symbol"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf).select("symbol", "trade_date", "close")
    c = R.review_context(w, w, "2001-06-27", ["symbol"], "trade_date")
    return c.select("symbol", F.size("forecasts").alias("forecasts"), F.size("decisions").alias("decisions"), F.element_at("forecasts", 1)["trade_date"].alias("oldest_forecast"), A.total(F.transform("decisions", lambda x: x["close"])).alias("decision_sum"))
