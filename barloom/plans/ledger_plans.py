"""Queries over positions, ledgers, accounts and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as I, ledger as LG, panel as P, prices as X
from barloom.plans import views as V
from barloom.plans.registry import REG
from barloom.plans.sqlviews import day, r, with_views

ORDER = ["trade_date", *V.TICK_ORDER]
def MONTH():
    return F.trunc("trade_date", "month")

OW = "(partition by symbol order by trade_date)"


@REG.add(
    "position_replay",
    "S-12",
    """select event_id, p as position, case when k = 1 and event_id % 2 <> 0 then 'FIRST_EVENT_NOT_INCREASE' when p < 0 then 'BELOW_ZERO' when p > 100 then 'ABOVE_HUNDRED' end as violation
    from (select event_id, sum(case when event_id % 2 = 0 then 5 else -5 end) over o::bigint as p, row_number() over o as k from events window o as (partition by event_type order by ts, event_id))""",
)
def _(spark, sf):
    ev = V.position_events(spark, sf)
    return LG.replay_positions(ev, ["ts", "event_id"], F.date_trunc("hour", "ts")).select("event_id", "position", "violation")


@REG.add(
    "event_resequencing",
    "S-13",
    "select event_id, row_number() over (partition by event_type, ts::date order by ts, event_id) as sequence from events",
)
def _(spark, sf):
    ev = V.position_events(spark, sf)
    return LG.resequence(ev, ["ts", "event_id"], "operation_date", F.date_trunc("hour", "ts")).select("event_id", "sequence")


@REG.add(
    "current_positions",
    "S-14",
    """select s.symbol, coalesce(p, 0)::bigint as position from (select distinct event_type as symbol from events union select 'unused') s
    left join (select event_type, sum(case when event_id % 2 = 0 then 5 else -5 end) as p from events group by 1) e on e.event_type = s.symbol""",
)
def _(spark, sf):
    ev = V.position_events(spark, sf)
    out = LG.replay_positions(ev, ["ts", "event_id"], F.date_trunc("hour", "ts"))
    symbols = ev.select("symbol").distinct().withColumn("symbol", F.explode(F.array("symbol", F.lit("unused"))))
    return LG.current_positions(out, symbols, ["ts", "event_id"])


@REG.add(
    "fee_breakdown",
    "F-12",
    """select o_orderkey, floor(greatest(g * 0.00025, 5) * 1e6 + 0.4987) / 1e6 as commission, floor(g * 0.001 * 1e6 + 0.4987) / 1e6 as stamp_duty, floor((greatest(g * 0.00025, 5) + g * 0.001) * 1e6 + 0.4987) / 1e6 as total
    from (select o_orderkey, o_totalprice / 10 as g from orders)""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("f", LG.fee_breakdown(F.col("o_totalprice") / 10, F.lit("SELL"), LG.Fees(stamp_rate=0.001)))
    return o.select("o_orderkey", "f.commission", "f.stamp_duty", "f.total")


@REG.add(
    "order_sizes",
    "S-16",
    """select l_orderkey, sum(q)::double as lots_quantity, max(debit <= a or q = 0)::int::bigint as fits from (
      select l_orderkey, a, p, q, q * p + greatest(q * p * 0.00025, 5) as debit from (
        select l_orderkey, a, p, (select coalesce(max(k), 0) from range(0, 400) t(k) where k * 10 * p + case when k > 0 then greatest(k * 10 * p * 0.00025, 5) else 0 end <= a) * 10 as q
        from (select l_orderkey, l_extendedprice as a, l_extendedprice / l_quantity / 40 as p from lineitem))) group by l_orderkey""",
)
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") / F.col("l_quantity") / 40).alias("p"))
    li = li.withColumn("q", LG.size_orders("a", "p", 10))
    fits = (F.col("q") * F.col("p") + F.greatest(F.col("q") * F.col("p") * 0.00025, F.lit(5.0)) <= F.col("a")) | (F.col("q") == 0)
    return li.groupBy("l_orderkey").agg(F.sum("q").alias("lots_quantity"), F.max(fits.cast("int")).alias("fits"))


# ---- average cost -----------------------------------------------------------------------

def _ledger(spark, sf):
    t = V.trades(spark, sf)
    fee = LG.fee_breakdown(F.col("quantity") * F.col("price"), "side")["total"]
    return LG.ledger_fold(t.withColumn("fee", fee), ORDER, MONTH())


LG_SQL = {
    "tr": """select *, greatest(quantity * price * 0.00025, 5) as fee, row_number() over (partition by account_id, symbol order by trade_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as k from trd""",
    "lg": """
  select account_id, symbol, k, trade_date, side, price, quantity, fee, case when side = 'BUY' then quantity else 0.0::double end as h, case when side = 'BUY' then quantity * price + fee else 0.0::double end as c, 0.0::double as real,
    case when side = 'BUY' then -(quantity * price + fee) else 0.0::double end as cash from tr where k = 1
  union all
  select t.account_id, t.symbol, t.k, t.trade_date, t.side, t.price, t.quantity, t.fee, case when t.side = 'BUY' then p.h + t.quantity else greatest(p.h - t.quantity, 0) end,
    case when t.side = 'BUY' then p.c + t.quantity * t.price + t.fee when t.quantity >= p.h then 0 else p.c - p.c / p.h * t.quantity end,
    case when t.side = 'SELL' and p.h > 0 then least(p.h, t.quantity) * t.price - t.fee - case when t.quantity >= p.h then p.c else p.c / p.h * t.quantity end else 0 end,
    case when t.side = 'BUY' then -(t.quantity * t.price + t.fee) when p.h > 0 then least(p.h, t.quantity) * t.price - t.fee else 0 end
  from lg p join tr t on t.account_id = p.account_id and t.symbol = p.symbol and t.k = p.k + 1""",
}


@REG.add(
    "average_cost_ledger",
    "S-15",
    with_views(
        f"select account_id, symbol, count(*) as trades, {r('arg_max(h, k)')} as holding, {r('arg_max(c, k)', 4)} as total_cost, {r('sum(real)', 3)} as realized_pnl, {r('sum(cash)', 3)} as cash_change from lg group by account_id, symbol", **LG_SQL
    ),
)
def _(spark, sf):
    from barloom.functions.scalar import cut

    led = _ledger(spark, sf)
    last = lambda c: F.max_by(c, F.struct(*ORDER))
    return led.groupBy("account_id", "symbol").agg(
        F.count("*").alias("trades"), last("holding").alias("holding"), cut(last("total_cost"), 4).alias("total_cost"),
        cut(F.sum("realized_pnl"), 3).alias("realized_pnl"), cut(F.sum("cash_change"), 3).alias("cash_change"),
    )


@REG.add(
    "ledger_steps",
    "S-15",
    with_views(
        f"select symbol, {day('trade_date')} as trade_date, count(*) as n, {r('sum(h)')} as holdings, {r('sum(c)', 2)} as costs from lg group by symbol, trade_date", **LG_SQL
    ),
)
def _(spark, sf):
    """State after every single trade, checked through daily sums."""
    from barloom.functions.scalar import cut

    return _ledger(spark, sf).groupBy("symbol", "trade_date").agg(F.count("*").alias("n"), F.sum("holding").alias("holdings"), cut(F.sum("total_cost"), 2).alias("costs"))


def _prices(spark, sf):
    """Closes per line status, which is what trades name: the mean over the series of that status."""
    return V.bars_daily(spark, sf).groupBy(F.substring("symbol", 2, 1).alias("symbol"), "trade_date").agg(F.avg("close").alias("close"))


PX = {"px": "select symbol[2] as symbol, trade_date, avg(close) as close from d group by all"}


@REG.add(
    "account_totals",
    "A-17 J-01",
    with_views(
        f"""select account_id, {r('sum(h)')} as holding, {r('sum(h * close)', 3)} as market_value, {r('sum(c)', 3)} as total_cost, {r('sum(re)', 3)} as realized_pnl, {r('sum(h * close - c)', 3)} as unrealized_pnl, {r('sum(fe)', 4)} as fees
        from (select account_id, symbol, arg_max(h, k) as h, arg_max(c, k) as c, sum(real) as re, sum(fee) as fe from lg group by account_id, symbol) l
        join (select symbol, arg_max(close, trade_date) as close from px group by symbol) p on p.symbol = l.symbol group by account_id""",
        **LG_SQL, **PX,
    ),
)
def _(spark, sf):
    from barloom.functions.scalar import cut

    t = LG.account_totals(_ledger(spark, sf), _prices(spark, sf), ORDER)
    return t.select("account_id", "holding", *[cut(c, 3).alias(c) for c in ("market_value", "total_cost", "realized_pnl", "unrealized_pnl")], cut("fees", 4).alias("fees"))


SNAP = {
    "fd": "select account_id, min(trade_date) as f from tr group by account_id",
    "own": "select distinct account_id, symbol from tr",
    "ax": """select a.account_id, o.symbol, a.sd from (select account_id, trade_date as sd from tr union
      select own.account_id, px.trade_date from own join fd on fd.account_id = own.account_id join px on px.symbol = own.symbol and px.trade_date >= fd.f) a join own o on o.account_id = a.account_id""",
    "st": """select account_id, symbol, trade_date, arg_max(h, k) as h, arg_max(c, k) as c, arg_max(cr, k) as real, arg_max(ci, k) as inn, arg_max(cc, k) as cash from (
      select *, sum(real) over o as cr, sum(case when side = 'BUY' then -cash else 0 end) over o as ci, sum(case when side = 'SELL' then cash else 0 end) over o as cc from lg window o as (partition by account_id, symbol order by k)) group by all""",
    "sn": """select account_id, sd, coalesce(sum(cash), 0) as cash, coalesce(sum(h * coalesce(close, 0)), 0) as mv, coalesce(sum(inn), 0) as inn, coalesce(sum(real), 0) as real, coalesce(sum(h), 0) as h, coalesce(sum(c), 0) as c from (
      select ax.account_id, ax.symbol, ax.sd, st.cash, st.h, st.inn, st.real, st.c from ax asof left join st on st.account_id = ax.account_id and st.symbol = ax.symbol and ax.sd >= st.trade_date) x
      asof left join px on px.symbol = x.symbol and x.sd >= px.trade_date group by account_id, sd""",
    "rt": """select *, product(case when pr > 0 then (ta - fl) / pr else 1 end) over u - 1 as twr, min(least(0, case when pk > 0 then ta / pk - 1 end)) over u as md, count(*) filter (pr > 0) over u as n, case when pr > 0 then (ta - fl) / pr - 1 end as pret from (
      select account_id, sd, inn, cash + mv as ta, lag(cash + mv) over o as pr, inn - coalesce(lag(inn) over o, 0) as fl, max(cash + mv) over o as pk, min(sd) over o as f from sn where true window o as (partition by account_id order by sd))
      where inn > 0 window u as (partition by account_id order by sd)""",
}


def _months(spark, sf, values, funded=False):
    """Every account's days of a month in one row, so that the marks of all days are compared."""
    return LG.account_months(_ledger(spark, sf), _prices(spark, sf), ORDER, values, funded)


_MONTH = f"account_id, {day("date_trunc('month', sd)::date")} as month, count(*) as days, {day('max(sd)')} as snapshot_date"


@REG.add(
    "account_snapshots",
    "S-17 J-08 A-18 U-01",
    with_views(
        f"""select {_MONTH}, {r('avg(mv)', 1)} as market_value, {r('arg_max(cash, sd)', 2)} as cash_balance, {r('arg_max(inn, sd)', 2)} as total_contribution, {r('arg_max(real, sd)', 2)} as realized_pnl, {r('avg(mv - c)', 1)} as unrealized_pnl,
          {r('min(cash + mv)', 1)} as least_assets, {r('max(cash + mv)', 1)} as most_assets, {r('arg_max(cash + mv, sd)', 1)} as last_assets, sum(h) as holding_days from sn group by account_id, date_trunc('month', sd)""",
        **LG_SQL, **PX, **SNAP,
    ),
)
def _(spark, sf):
    from barloom.functions.scalar import cut

    means, ends = ("market_value", "unrealized_pnl"), ("cash_balance", "total_contribution", "realized_pnl")
    assets = {f"{how}_assets": ("total_assets", how) for how in ("least", "most", "last")}
    m = _months(spark, sf, {c: (c, "mean") for c in means} | {c: (c, "last") for c in ends} | assets | {"holding_days": ("holding", "sum")})
    return m.withColumns({c: cut(c, 1) for c in (*means, *assets)} | {c: cut(c, 2) for c in ends})


@REG.add(
    "account_returns",
    "S-18",
    with_views(
        f"""select account_id, {day('sd')} as snapshot_date, {r('pret')} as period_return, {r('case when inn > 0 then ta / inn - 1 end')} as cumulative_return, {r('case when n > 0 then gr - 1 end', 4)} as time_weighted_return, {r('md')} as max_drawdown,
          {r('case when n > 0 and sd - f >= 30 and gr > 0 then ln(case when gr > 0 then gr end) * 365 / greatest(sd - f, 1) end', 4)} as annualized_log_return from dy""",
        **LG_SQL, **PX, **SNAP,
        dy="""select *, product(case when pr > 0 then (ta - fl) / pr else 1 end) over u as gr, min(case when pk > 0 then ta / pk - 1 end) over u as md, count(*) filter (pr > 0) over u as n, case when pr > 0 then (ta - fl) / pr - 1 end as pret from (
      select account_id, sd, inn, cash + mv as ta, lag(cash + mv) over o as pr, inn - coalesce(lag(inn) over o, 0) as fl, max(cash + mv) over o as pk, min(sd) over o as f from sn where true window o as (partition by account_id order by sd))
      where true window u as (partition by account_id order by sd)""",
    ),
)
def _(spark, sf):
    """All returns of every account on every one of its days; the annualised one is given as a logarithm."""
    from barloom.functions.scalar import cut

    returns = ("period_return", "cumulative_return", "time_weighted_return", "max_drawdown", "annualized_log_return")
    d = LG.account_days(_ledger(spark, sf), _prices(spark, sf), ORDER, returns)
    return d.withColumns({c: cut(c, 4) for c in ("time_weighted_return", "annualized_log_return")})


@REG.add(
    "time_weighted_returns",
    "S-18",
    with_views(
        f"""select {_MONTH}, {r('arg_max_null(case when n > 0 and twr > -1 then ln(1 + twr) end, sd)', 4)} as log_growth, {r('arg_max_null(case when n > 0 and sd - f >= 30 and twr > -1 then least(exp(ln(case when twr > -1 then 1 + twr end) * 365 / greatest(sd - f, 1)) - 1, 1000) end, sd)', 4)} as annualized_return,
          arg_max_null(case when n > 0 then (twr <= -1)::int::bigint end, sd) as wiped_out
        from rt group by account_id, date_trunc('month', sd)""",
        **LG_SQL, **PX, **SNAP,
    ),
)
def _(spark, sf):
    from barloom.functions.scalar import cut

    m = _months(spark, sf, {c: (c, "last") for c in ("time_weighted_return", "annualized_return")}, funded=True)
    growth, annual = F.col("time_weighted_return") + 1, F.col("annualized_return")
    values = {"log_growth": F.log(F.when(growth > 0, growth)), "annualized_return": F.when(annual.isNotNull(), F.least(annual, F.lit(1000.0)))}
    m = m.withColumns({n: cut(v, 4) for n, v in values.items()})
    return m.withColumn("wiped_out", (F.col("time_weighted_return") <= -1).cast("int")).drop("time_weighted_return")


@REG.add(
    "weekly_snapshot_resample",
    "A-18",
    "select o_custkey as account_id, date_trunc('month', o_orderdate)::date::varchar as bucket, max(o_orderdate::date)::varchar as snapshot_date, arg_max(v, o_orderdate) as v from (select o_custkey, o_orderdate, max(o_totalprice) as v from orders group by all) group by 1, 2",
)
def _(spark, sf):
    s = V.cashflows(spark, sf).groupBy("account_id", F.col("flow_date").alias("snapshot_date")).agg(F.max("amount").alias("v"))
    return LG.snapshot_resample(s, "month")


@REG.add(
    "money_weighted_returns",
    "S-19",
    with_views(
        f"""select account_id, {day('v')} as valuation_date, case when t * 365 >= 29.5 and b > 0 then {r('(lo + hi) / 2', 5)} end as money_weighted_return from bis where i = 96""",
        fl="select o_custkey as account_id, o_orderdate::date as d, sum(o_totalprice) as a from orders group by all",
        vd="select unnest([date '1994-06-30', date '1996-12-31', date '1998-12-31', date '2001-12-31']) as v",
        ac="select account_id, min(d) as s, v, sum(a) * 1.5 as e, (v - min(d)) / 365.0::double as t, list((d - s0) / 365.0::double) as ts, list(a) as am from (select *, min(d) over (partition by account_id) as s0 from fl) join vd on d <= v group by account_id, v",
        br="select *, (select min(pow(2.0, k)) from range(0, 33) z(k) where list_sum([-am[j] * exp(-ln(1 + pow(2.0, k)) * ts[j]) for j in range(1, len(am) + 1)]) + e * exp(-ln(1 + pow(2.0, k)) * t) <= 0) as b from ac",
        bis="""
  select account_id, v, t, e, ts, am, b, 0 as i, -0.999999::double as lo, coalesce(b, 1.0)::double as hi from br
  union all
  select account_id, v, t, e, ts, am, b, i + 1, case when f > 0 then (lo + hi) / 2 else lo end, case when f > 0 then hi else (lo + hi) / 2 end from (
    select *, list_sum([-am[j] * exp(-ln(1 + (lo + hi) / 2) * ts[j]) for j in range(1, len(am) + 1)]) + e * exp(-ln(1 + (lo + hi) / 2) * t) as f from bis) where i < 96""",
    ),
)
def _(spark, sf):
    from barloom.functions.scalar import cut

    c = V.cashflows(spark, sf)
    dates = F.explode(F.array(*[F.lit(d).cast("date") for d in ("1994-06-30", "1996-12-31", "1998-12-31", "2001-12-31")]))
    e = c.withColumn("valuation_date", dates).where("flow_date <= valuation_date").groupBy("account_id", "valuation_date").agg((F.sum("amount") * 1.5).alias("ending_value"))
    m = LG.mwr(c, e)
    return m.withColumn("money_weighted_return", cut("money_weighted_return", 5))


@REG.add(
    "dca_benchmark",
    "S-20 S-16",
    with_views(
        f"""select account_id, symbol, {day('trade_date')} as trade_date, {r('sum(q) over o', 4)} as benchmark_quantity, {r('sum(amount - q * close - greatest(q * close * 0.00025, 5)) over o', 3)} as benchmark_cash
        from (select *, floor(greatest(least(amount / (close * 1.00025), (amount - 5) / close), 0) * 1e8) / 1e8 as q from (
          select c.*, p.close from (select account_id, symbol, trade_date, sum(quantity * price) as amount from trd where side = 'BUY' group by all) c asof join px p on p.symbol = c.symbol and c.trade_date >= p.trade_date))
        window o as (partition by account_id, symbol order by trade_date)""",
        **PX,
    ),
)
def _(spark, sf):
    from barloom.functions.scalar import cut

    t = V.trades(spark, sf).where("side = 'BUY'").withColumn("amount", F.col("quantity") * F.col("price"))
    b = LG.dca_benchmark(t, _prices(spark, sf))
    return b.select("account_id", "symbol", "trade_date", cut("benchmark_quantity", 4).alias("benchmark_quantity"), cut("benchmark_cash", 3).alias("benchmark_cash"))


@REG.add(
    "account_comparison",
    "S-21 J-07",
    with_views(
        f"""select account_id, {day('sd')} as snapshot_date, {r('a - b', 2)} as diff_amount from (
          select account_id, sd, last_value(a ignore nulls) over o as a, last_value(b ignore nulls) over o as b from (
            select coalesce(x.account_id, y.account_id) as account_id, coalesce(x.d, y.d) as sd, x.v as a, y.v as b
            from (select o_custkey as account_id, o_orderdate::date as d, max(o_totalprice) as v from orders where o_orderpriority < '3' group by all) x
            full join (select o_custkey as account_id, o_orderdate::date as d, max(o_totalprice) as v from orders where o_orderpriority >= '3' group by all) y on x.account_id = y.account_id and x.d = y.d)
          window o as (partition by account_id order by sd rows between unbounded preceding and current row))"""
    ),
)
def _(spark, sf):
    from barloom.functions.scalar import cut

    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderdate").cast("date").alias("snapshot_date"), F.col("o_totalprice").alias("amount"), "o_orderpriority")
    snap = lambda d: d.groupBy("account_id", "snapshot_date").agg(F.max("amount").alias("amount"))
    c = LG.compare_accounts(snap(o.where("o_orderpriority < '3'")), snap(o.where("o_orderpriority >= '3'")), ["account_id"], ["amount"])
    return c.select("account_id", "snapshot_date", cut("diff_amount", 2).alias("diff_amount"))


@REG.add(
    "price_deviation_warnings",
    "S-22 J-04",
    with_views(
        f"""select account_id, count(*) as n, count(*) filter (abs(t.price / p.close - 1) > 0.1) as warnings, {r('max(t.price / p.close - 1)')} as worst
        from trd t asof left join px p on p.symbol = t.symbol and t.trade_date >= p.trade_date group by account_id""",
        **PX,
    ),
)
def _(spark, sf):
    j = P.asof_join(V.trades(spark, sf).select("account_id", "symbol", "trade_date", "price"), _prices(spark, sf).withColumnRenamed("trade_date", "price_date"), ["symbol"], "trade_date", "price_date", ["close"])
    j = j.withColumns(LG.price_deviation("price", "close"))
    return j.groupBy("account_id").agg(F.count("*").alias("n"), F.count_if("price_deviation_warning").alias("warnings"), F.max("price_deviation").alias("worst"))


# ---- position paths ---------------------------------------------------------------------

def _positions(spark, sf):
    w = V.bars_weekly(spark, sf).withColumn("ma", I.sma("close", 10))
    pos = F.coalesce(F.when(F.lag("close").over(P.ordered()) > F.lag("ma").over(P.ordered()), 80).otherwise(20), F.lit(0))
    return w.withColumn("position", pos).select("symbol", "trade_date", "open", "close", "position")


_PP = {
    "ps": f"select symbol, trade_date, rn, open, close, case when lag(close) over {OW} > lag(ma) over {OW} then 80 else 20 end as pos from (select *, avg(close) over (partition by symbol order by trade_date rows between 9 preceding and current row) as ma from wn)",
    "pp": f"""select *, (1 + old / 100.0::double * ov) * (1 + pos / 100.0::double * se) as g, abs(pos - old) / 100.0::double as tn, (1 + least((rn - 2) * 5, 100) / 100.0::double * ov) * (1 + least((rn - 1) * 5, 100) / 100.0::double * se) as dc
      from (select *, lag(pos) over {OW} as old, open / lag(close) over {OW} - 1 as ov, close / open - 1 as se, close / lag(close) over {OW} as bh from ps) where rn > 1""",
    "pq": "select *, g * (1 - tn * 0.0005::double) as nr from pp",
    "pe2": f"select *, product(nr) over {OW} as eq, product(bh) over {OW} as bheq, product(dc) over {OW} as dceq from pq",
}


@REG.add(
    "position_performance",
    "S-23",
    with_views(
        f"""select symbol, {r('ln(arg_max(eq, trade_date))')} as realized_log_return, {r('min(eq / greatest(pk, 1) - 1)')} as maximum_drawdown, {r('avg(nr - 1) / stddev_samp(nr) * sqrt(52)')} as sharpe, {r('sum(tn)')} as turnover,
          {r('sum(tn * 0.0005)')} as transaction_cost, {r('arg_max(bheq, trade_date) - 1')} as buy_hold_return, {r('least(arg_max(dceq, trade_date) - 1, 1e6)', 4)} as dca_return
        from (select *, max(eq) over {OW} as pk from pe2) group by symbol""",
        **_PP,
    ),
)
def _(spark, sf):
    from barloom.functions.scalar import cut

    s = LG.performance_summary(LG.position_performance(_positions(spark, sf)))
    s = s.withColumn("realized_log_return", F.log1p("realized_return")).drop("realized_return")
    return s.withColumn("dca_return", cut(F.least("dca_return", F.lit(1e6)), 4))


@REG.add(
    "exposure_statistics",
    "A-22",
    with_views(
        f"""select symbol, {r('coalesce(avg(pos / 100.0::double) filter (bh > 1), 0)')} as up_participation, {r('coalesce(avg(1 - pos / 100.0::double) filter (bh < 1), 0)')} as down_defence, {r('avg(pos)')} as average_position, {r('sum(tn)')} as turnover,
        (avg(pos) < 5 and sum(tn) = 0)::bigint as no_action from pp group by symbol""",
        **_PP,
    ),
)
def _(spark, sf):
    p = _positions(spark, sf)
    m = LG.position_performance(p).join(p.select("symbol", "trade_date", X.ret("close").alias("market_return")), ["symbol", "trade_date"])
    return LG.exposure_stats(m, ["symbol"])


@REG.add(
    "eight_week_windows",
    "S-24",
    with_views(
        f"""select a.symbol, a.rn as window_start, a.trade_date::varchar as start_date, {r('max(b.close)')} as high_close, {r('arg_max(b.close, b.rn) / arg_min(b.close, b.rn) - 1')} as window_return, count(*) as n
        from wn a join wn b on b.symbol = a.symbol and b.rn between a.rn and a.rn + 7 group by a.symbol, a.rn, a.trade_date having count(*) = 8"""
    ),
)
def _(spark, sf):
    p = LG.window_panel(V.bars_weekly(spark, sf), 8)
    return p.groupBy("symbol", "window_start").agg(
        F.min("trade_date").alias("start_date"), F.max("close").alias("high_close"),
        (F.max_by("close", "window_step") / F.min_by("close", "window_step") - 1).alias("window_return"), F.count("*").alias("n"),
    )


@REG.add(
    "weekly_contribution",
    "S-26",
    """select o_orderkey, case when k = 0 then 0.0 when k = 1 then 0.0 when k = 2 then least(greatest(floor(o_totalprice / 1000), 50.0), 300.0) else least(greatest(100.0 * (1 + k / 10.0::double), 50.0), 300.0) end::double as amount
    from (select o_orderkey, o_totalprice, o_orderkey % 7 as k from orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 7
    rec = F.when(k == 0, "PAUSE").when(k == 1, "SELL_PARTIAL").when(k == 2, "BUY")
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        LG.weekly_amount(F.lit(100.0), rec, suggested=F.when(k == 2, F.floor(F.col("o_totalprice") / 1000).cast("double")), multiplier=1 + k / 10.0, minimum=50.0, maximum=300.0).alias("amount"),
    )
