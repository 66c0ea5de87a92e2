"""The same panels as SQL common table expressions, for the SQL side of the comparison."""

from __future__ import annotations

import re

ORD = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"

_TRADED = """
  select l_returnflag || l_linestatus as symbol, l_shipdate::date as trade_date,
         l_extendedprice / l_quantity as price, l_quantity as volume,
         row_number() over (partition by l_returnflag, l_linestatus, l_shipdate::date order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as k_first,
         row_number() over (partition by l_returnflag, l_linestatus, l_shipdate::date order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) as k_last
  from lineitem"""


def _resampled(unit: str) -> str:
    return f"""
  select symbol, date_trunc('{unit}', trade_date)::date as period, min(trade_date) as period_start, max(trade_date) as trade_date,
         arg_min(open, trade_date) as open, max(high) as high, min(low) as low, arg_max(close, trade_date) as close,
         sum(volume) as volume, count(*) as sessions
  from d group by symbol, date_trunc('{unit}', trade_date)"""


CTES: dict[str, str] = {
    "tk": _TRADED,
    "d": """
  select symbol, trade_date, max(price) filter (k_first = 1) as open, max(price) as high, min(price) as low,
         max(price) filter (k_last = 1) as close, sum(volume) as volume
  from tk group by symbol, trade_date""",
    "w": _resampled("week"),
    "m": _resampled("month"),
    "cal": "select distinct l_shipdate::date as session_date from lineitem",
    "val": """
  select o_orderpriority as symbol, o_orderdate::date as trade_date,
         sum(round(o_totalprice * 100)::bigint)::double / count(*) / 1000000.0 as pe
  from orders group by all""",
    "obs": """
  select event_type as series, ts::date as effective_date, ts as available_at, event_id as vintage, value,
         case when event_id % 17 = 0 then 'rejected' else 'accepted' end as quality
  from events""",
    "trd": """
  select o_custkey as account_id, l_linestatus as symbol, l_shipdate::date as trade_date,
         case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side, l_quantity as quantity,
         l_extendedprice / l_quantity as price, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
  from lineitem join orders on l_orderkey = o_orderkey""",
    # numbered series used by recursive checks
    "wn": "select *, row_number() over (partition by symbol order by trade_date) as rn from w",
    "dn": "select *, row_number() over (partition by symbol order by trade_date) as rn from d",
    "fc_r": """
  select symbol, trade_date as anchor, rn as ordinal, h, close / lag(close, h) over (partition by symbol, h order by trade_date) - 1 as past,
         lead(close, h) over (partition by symbol, h order by trade_date) / close - 1 as actual
  from wn, (values (1), (4), (8), (13)) hs(h)""",
    "fc": """
  select symbol, anchor, ordinal, h, p10, p50, p90, p_up, 1 - p_up - p_down as p_side, p_down, actual from (
    select *, quantile_cont(past, 0.1) over f as p10, quantile_cont(past, 0.5) over f as p50, quantile_cont(past, 0.9) over f as p90,
           avg((past > 0.05)::int) over f as p_up, avg((past < -0.05)::int) over f as p_down, count(past) over f as n
    from fc_r window f as (partition by symbol, h order by anchor rows between 51 preceding and current row)) where n = 52""",
    "fc26": """
  select symbol, anchor, ordinal, h, p10, p50, p90, p_up, 1 - p_up - p_down as p_side, p_down, actual from (
    select *, quantile_cont(past, 0.1) over f as p10, quantile_cont(past, 0.5) over f as p50, quantile_cont(past, 0.9) over f as p90,
           avg((past > 0.05)::int) over f as p_up, avg((past < -0.05)::int) over f as p_down, count(past) over f as n
    from fc_r window f as (partition by symbol, h order by anchor rows between 25 preceding and current row)) where n = 26""",
    "pe_ev": """
  select event_type as symbol, ts, ts::date as operation_date, event_id, case when event_id % 2 = 0 then '+' else '-' end as direction, 5 as pct
  from events""",
    # first-value-seeded MACD over the weekly closes, as a plain recursion
    "ema_w": """
  select symbol, trade_date, rn, close, close as e12, close as e26 from wn where rn = 1
  union all
  select n.symbol, n.trade_date, n.rn, n.close, e.e12 + (n.close - e.e12) * 2.0::double / 13, e.e26 + (n.close - e.e26) * 2.0::double / 27
  from ema_w e join wn n on n.symbol = e.symbol and n.rn = e.rn + 1""",
    "dif_w": "select symbol, trade_date, rn, close, e12, e26, e12 - e26 as dif from ema_w",
    "dea_w": """
  select symbol, trade_date, rn, close, e12, e26, dif, dif as dea from dif_w where rn = 1
  union all
  select n.symbol, n.trade_date, n.rn, n.close, n.e12, n.e26, n.dif, e.dea + (n.dif - e.dea) * 0.2::double
  from dea_w e join dif_w n on n.symbol = e.symbol and n.rn = e.rn + 1""",
    "macd_w": "select *, 2 * (dif - dea) as hist from dea_w",
}

for _name, _base in (("d", "dn"),):
    CTES[f"ema_{_name}"] = CTES["ema_w"].replace("ema_w", f"ema_{_name}").replace("wn", _base)
    CTES[f"dif_{_name}"] = CTES["dif_w"].replace("ema_w", f"ema_{_name}")
    CTES[f"dea_{_name}"] = CTES["dea_w"].replace("dea_w", f"dea_{_name}").replace("dif_w", f"dif_{_name}")
    CTES[f"macd_{_name}"] = CTES["macd_w"].replace("dea_w", f"dea_{_name}")

MATERIALIZED = {"d", "w", "m", "wn", "dn", "dif_w", "dif_d", "fc_r", "fc", "fc26", "macd_w", "macd_d", "win", "fbase", "val"}


def _needs(text: str, extra: dict[str, str]) -> list[str]:
    names = {**CTES, **extra}
    found = re.findall(r"\b(?:from|join)\s+([a-z_0-9]+)|,\s*([a-z_0-9]+)\s+[a-z]\b", text)
    return [n for pair in found for n in pair if n in names]


def with_views(final: str, **extra: str) -> str:
    """final with the needed expressions in front; ``extra`` adds query-local ones in order."""
    names = {**CTES, **extra}
    order: list[str] = []

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in order or name in trail:
            return
        for dep in _needs(names[name], extra):
            if dep != name:
                visit(dep, (*trail, name))
        order.append(name)

    for body in (*extra.values(), final):
        for name in _needs(body, extra):
            visit(name, ())
    for name in extra:
        visit(name, ())
    parts = [f"{n} as {'materialized ' if n in MATERIALIZED else ''}({names[n]})" for n in order]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + final


def r(expr: str, digits: int = 6) -> str:
    """Same cut to a decimal grid as :func:`barloom.functions.scalar.cut`."""
    return f"(floor(({expr})::double * 1e{digits} + 0.4987) / 1e{digits} + 0.0)"


def day(expr: str) -> str:
    return f"({expr})::varchar"
