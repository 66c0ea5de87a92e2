"""Queries over sources, ingestion, gates and point-in-time reads."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, functions as F

from barloom.functions import scalar as S
from barloom.operators import bars as B, indicators as I, ingest as G, panel as P, pit, prices as X, sampling as K
from barloom.plans import views as V
from barloom.plans.registry import REG
from barloom.plans.sqlviews import day, r, with_views
from barloom.session import shared_dir
from barloom.sources import readers as R, sinks

KEY = f"symbol, {day('trade_date')} as trade_date"


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex[:8]}"


@REG.add("bar_table_scan", "O-01", with_views(f"select {KEY}, {r('close')} as close from w where trade_date between date '1997-01-01' and date '1999-06-30'"))
def _(spark, sf):
    path = _scratch(spark, "bars")
    sinks.write_bars(V.bars_weekly(spark, sf).withColumn("timeframe", F.lit("weekly")), path)
    return R.read_bars(spark, path, "weekly", "1997-01-01", "1999-06-30", ["symbol", "trade_date", "close"])


def _text_bars(spark, sf):
    """Weekly bars as display text: two date styles, thousand separators, and faulty cells."""
    w = V.bars_weekly(spark, sf)
    k = F.dayofmonth("trade_date")
    num = lambda c: F.format_number(F.floor(F.col(c)), 0)
    return w.select(
        "symbol",
        F.when(k % 3 == 0, F.date_format("trade_date", "yyyyMMdd")).when(k == 5, F.lit("n/a")).otherwise(F.date_format("trade_date", "yyyy-MM-dd")).alias("日期"),
        num("open").alias("Open Price"),
        num("high").alias("HIGH"),
        F.when(k == 7, F.lit("--")).otherwise(num("low")).alias("low"),
        num("close").alias("raw_close"),
        F.when(k == 8, F.lit("lots")).otherwise(num("volume")).alias("成交量"),
    )


_OK = "day(trade_date) not in (5, 7, 8)"


@REG.add(
    "parsed_bar_text",
    "O-02 O-03 O-06",
    with_views(f"select {KEY}, floor(open)::double as open, floor(low)::double as low, floor(close)::double as close, floor(volume)::double as volume from w where {_OK}"),
)
def _(spark, sf):
    valid, _ = R.parse_bars(R.rename_by_alias(_text_bars(spark, sf), extra=["symbol"]))
    return valid.select("symbol", "trade_date", "open", "low", "close", "volume")


@REG.add(
    "rejected_bar_text",
    "O-03 O-04",
    with_views(
        f"""select symbol, count(*) filter (day(trade_date) = 5) as bad_date, count(*) filter (day(trade_date) = 7) as bad_low, count(*) filter (day(trade_date) = 8) as bad_volume
        from w where not ({_OK}) group by symbol"""
    ),
)
def _(spark, sf):
    _, rejects = R.parse_bars(R.rename_by_alias(_text_bars(spark, sf), extra=["symbol"]))
    has = lambda c: F.count_if(F.array_contains("errors", c))
    return rejects.groupBy("symbol").agg(has("trade_date").alias("bad_date"), has("low").alias("bad_low"), has("volume").alias("bad_volume"))


@REG.add("import_preview_counts", "O-04", with_views(f"select count(*) as total, count(*) filter ({_OK}) as valid, count(*) filter (not ({_OK})) as invalid from w"))
def _(spark, sf):
    _, counts = R.preview(R.rename_by_alias(_text_bars(spark, sf), extra=["symbol"]))
    return counts


@REG.add("csv_round_trip", "O-02 O-23", with_views(f"select {KEY}, floor(open)::double as open, floor(close)::double as close from w where {_OK}"))
def _(spark, sf):
    path = _scratch(spark, "csv")
    sinks.write_csv(_text_bars(spark, sf), path)
    valid, _ = R.parse_bars(R.read_bar_csv(spark, path, extra=["symbol"]))
    return valid.select("symbol", "trade_date", "open", "close")


@REG.add(
    "ledger_csv_round_trip",
    "O-23 O-24",
    with_views("select account_id, side, count(*) as n, sum(quantity)::double as quantity from trd group by account_id, side"),
)
def _(spark, sf):
    path = _scratch(spark, "ledger")
    t = V.trades(spark, sf).select(
        "account_id", "symbol", "trade_date", "side", F.col("quantity").cast("decimal(38,8)").alias("quantity"),
        F.col("price").cast("decimal(38,8)").alias("price"), F.lit(0).cast("decimal(38,8)").alias("fee"),
    )
    sinks.write_csv(t, path)
    return R.read_ledger_csv(spark, path).groupBy("account_id", "side").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@REG.add(
    "vendor_normalisation",
    "O-05 O-28",
    """select l_orderkey, sum(l_quantity::bigint * 100)::double as volume, sum(l_quantity::bigint * 200)::double as effective_volume, count(*) as n from lineitem group by l_orderkey""",
)
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("vol"), F.lit(None).cast("double").alias("成交量"), F.lit("成交量(手)").alias("head"))
    rec = G.normalise_records(li, {"volume": ("成交量", "vol")}, {"volume": G.header_scale("head")})
    rec = G.effective_volume(rec.withColumn("volume_multiplier", F.lit(2)))
    return rec.groupBy("l_orderkey").agg(F.sum("volume").alias("volume"), F.sum("effective_volume").alias("effective_volume"), F.count("*").alias("n"))


@REG.add(
    "cleaned_numbers_dates",
    "O-06 F-07",
    """select o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then -floor(o_totalprice) else floor(o_totalprice) end as amount,
      case when o_orderkey % 7 = 0 then null else o_orderdate::date::varchar end as order_date, last_day(o_orderdate::date)::varchar as month_end,
      floor(o_totalprice)::bigint::varchar || '.5' as canonical from orders""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    shown = F.format_number(F.floor("o_totalprice"), 0)
    text = F.when(k % 5 == 0, F.lit("--")).when(k % 5 == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(k % 5 == 2, F.concat(shown, F.lit("%"))).otherwise(shown)
    dates = (
        F.when(k % 7 == 0, F.lit("nan")).when(k % 7 == 1, F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日")))
        .when(k % 7 == 2, F.date_format(d, "yyyyMMdd")).when(k % 7 == 3, F.date_format(d, "yyyy/M/d")).otherwise(d.cast("string"))
    )
    return o.select(
        "o_orderkey", S.clean_decimal(text).alias("amount"), S.clean_date(dates).alias("order_date"), S.month_end(d).alias("month_end"),
        S.canonical_number(F.floor("o_totalprice") + F.lit(0.5)).alias("canonical"),
    )


# ---- upsert family -----------------------------------------------------------------

def _target_updates(spark, sf):
    d = V.bars_daily(spark, sf).select("symbol", "trade_date", "close", "volume")
    changed = F.when(F.dayofmonth("trade_date") == 3, F.col("close") + 1).otherwise(F.col("close"))
    return d.where("trade_date < date'2001-01-01'"), d.where("trade_date >= date'1999-01-01'").withColumn("close", changed)


_OUTCOME = "case when trade_date < date '1999-01-01' then 'kept' when trade_date >= date '2001-01-01' then 'added' when day(trade_date) = 3 then 'updated' else 'skipped' end"


@REG.add(
    "upsert_merge",
    "O-07",
    with_views(f"select {KEY}, {r(chr(10).join(['close + case when trade_date >= date', repr('1999-01-01'), 'and day(trade_date) = 3 then 1 else 0 end']))} as close, {r('volume')} as volume, {_OUTCOME} as outcome from d"),
)
def _(spark, sf):
    target, updates = _target_updates(spark, sf)
    merged, audit = G.upsert(target, updates, ["symbol", "trade_date"], ["close", "volume"])
    return merged.join(audit, ["symbol", "trade_date"])


@REG.add(
    "refresh_log",
    "O-25",
    with_views(
        f"""select symbol, count(*) filter (o <> 'kept') as received, count(*) filter (o = 'added') as added, count(*) filter (o = 'updated') as updated, count(*) filter (o = 'skipped') as skipped,
        count(*) filter (o in ('added', 'updated')) as written, 'written' as status from (select symbol, {_OUTCOME} as o from d) group by symbol"""
    ),
)
def _(spark, sf):
    target, updates = _target_updates(spark, sf)
    return G.update_log(G.upsert(target, updates, ["symbol", "trade_date"], ["close", "volume"])[1])


@REG.add(
    "bundle_diff",
    "O-21",
    with_views(
        f"""select symbol, count(*) filter (o = 'added') as "new", count(*) filter (o = 'updated') as changed, count(*) filter (o = 'skipped') as same, count(*) filter (o = 'kept') as gone
        from (select symbol, {_OUTCOME} as o from d) group by symbol"""
    ),
)
def _(spark, sf):
    target, updates = _target_updates(spark, sf)
    return G.diff_tables(target, updates, ["symbol", "trade_date"], ["close", "volume"], ["symbol"])


@REG.add(
    "batch_classification",
    "O-08 O-25",
    """select event_id, outcome from (
      select event_id, case when prev is null and stored is null then 'added' when coalesce(prev, stored) <> v then 'updated' else 'skipped' end as outcome from (
        select e.event_id, e.v, lag(e.v) over (partition by e.event_type, e.d order by e.ts, e.event_id) as prev, s.v as stored
        from (select *, ts::date as d, floor(value / 10)::bigint as v from events) e
        left join (select event_type, ts::date as d, arg_min(floor(value / 10)::bigint, event_id) as v from events where ts < timestamp '2024-01-15' group by all) s
          on s.event_type = e.event_type and s.d = e.d))""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select(
        "event_type", F.col("ts").cast("date").alias("d"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.floor(F.col("value") / 10).alias("v")
    )
    target = e.where("ts < timestamp'2024-01-15'").groupBy("event_type", "d").agg(F.min_by("v", "event_id").alias("v"))
    return G.classify_batch(e, target, ["event_type", "d"], ["v"], ["ts", "event_id"], F.date_trunc("hour", "ts")).select("event_id", "outcome")


@REG.add("last_record_wins", "O-08", "select event_type, ts::date::varchar as d, max(event_id) as event_id, arg_max(value, event_id) as value from events group by all")
def _(spark, sf):
    e = V.table(spark, sf, "events").select("event_type", F.col("ts").cast("date").alias("d"), "event_id", "value")
    return G.dedupe_last(e, ["event_type", "d"], ["event_id"])


@REG.add(
    "placeholders_replaced",
    "O-09",
    with_views(f"select {KEY}, case when day(trade_date) % 2 = 0 then 'DEMO feed' else 'feed' end as source from d where not (day(trade_date) % 2 = 0 and symbol like 'A%')"),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf).select("symbol", "trade_date", F.when(F.dayofmonth("trade_date") % 2 == 0, "DEMO feed").otherwise("feed").alias("source"))
    updates = d.where("symbol like 'A%' or source like 'DEMO%'").withColumn("source", F.when(F.col("symbol").startswith("A"), "live").otherwise("demo2"))
    return G.drop_placeholders(d, updates)


@REG.add(
    "first_available_source",
    "O-10 U-04",
    with_views(
        f"""select {KEY}, {r('close')} as close, 0::bigint as priority from d where symbol like 'A%' union all
        select {KEY}, {r('close * 2')}, 1 from d where symbol like '%F' and symbol not like 'A%' union all
        select {KEY}, {r('close * 3')}, 2 from d where symbol not like '%F' and symbol not like 'A%'"""
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf).select("symbol", "trade_date", "close")
    second = d.where("symbol like '%F'").withColumn("close", F.col("close") * 2)
    return G.first_available([d.where("symbol like 'A%'"), second, d.withColumn("close", F.col("close") * 3)])


@REG.add(
    "spliced_sources",
    "O-11",
    with_views(f"select {KEY}, case when trade_date < date '2000-01-01' then {r('close')} else {r('close * 2')} end as close, case when trade_date < date '2000-01-01' then 'primary' else 'secondary' end as origin from d"),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf).select("symbol", "trade_date", "close")
    return G.append_newer(d.where("trade_date < date'2000-01-01'"), d.withColumn("close", F.col("close") * 2))


@REG.add(
    "patched_invalid_rows",
    "O-12",
    with_views(f"select {KEY}, case when day(trade_date) = 8 and symbol like 'A%' then 0.0 else {r('volume')} end as volume, (day(trade_date) = 8 and symbol not like 'A%')::bigint as patched from d"),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf).select("symbol", "trade_date", "volume")
    broken = d.withColumn("volume", F.when(F.dayofmonth("trade_date") == 8, 0.0).otherwise(F.col("volume")))
    return G.patch_invalid(broken, d.where("symbol not like 'A%'"), ["symbol", "trade_date"], F.col("volume") == 0, ["volume"])


@REG.add(
    "ingest_gate",
    "O-13",
    with_views(
        """select symbol, code, count(*) as n, min(d)::varchar as first_day, max(d)::varchar as last_day, case when code in ('IDENTICAL_DUPLICATE', 'POSSIBLE_STALE_END_DATE') then 'warning' else 'blocking' end as severity from (
          select symbol, trade_date as d, case when count(distinct (l_quantity)) > 1 then 'CONFLICTING_DUPLICATE' else 'IDENTICAL_DUPLICATE' end as code
            from (select l_returnflag || l_linestatus as symbol, l_shipdate::date as trade_date, l_quantity from lineitem) group by 1, 2 having count(*) > 1
          union all select symbol, trade_date, 'FUTURE_TRADE_DATE' from tk where trade_date > date '2001-06-30'
          union all select symbol, trade_date, 'DATE_BEFORE_REQUEST' from tk where trade_date < date '1995-02-01'
          union all select symbol, trade_date, 'DATE_AFTER_REQUEST' from tk where trade_date > date '2001-12-31'
          union all select symbol, trade_date, 'NONPOSITIVE_VOLUME' from tk where volume - 1 <= 0
          union all select symbol, max(trade_date), case when date '2001-12-31' - max(trade_date) > 14 then 'STALE_END_DATE' else 'POSSIBLE_STALE_END_DATE' end from tk group by symbol having date '2001-12-31' - max(trade_date) > 5)
        group by symbol, code"""
    ),
)
def _(spark, sf):
    t = V.ticks(spark, sf).select("symbol", F.col("ts").alias("trade_date"), (F.col("volume") - 1).alias("volume"))
    return G.ingest_gate(t, ["symbol", "trade_date"], ["volume"], "2001-06-30", "1995-02-01", "2001-12-31")


@REG.add(
    "appended_revisions",
    "O-14",
    """select vintage, 'append' as kind from (select event_id as vintage from events where event_id % 3 = 0)
    union all select event_id, 'conflict' from events where event_id % 3 = 1 and event_id % 7 = 0""",
)
def _(spark, sf):
    o = V.observations(spark, sf).select("series", "effective_date", "vintage", "value")
    existing = o.where("vintage % 3 <> 0").withColumn("value", F.when((F.col("vintage") % 3 == 1) & (F.col("vintage") % 7 == 0), F.col("value") + 1).otherwise(F.col("value")))
    batch = o.unionByName(o)
    fresh, clash = G.append_revisions(existing, batch, ["series", "effective_date", "vintage"], ["value"])
    return fresh.select("vintage", F.lit("append").alias("kind")).unionByName(clash.select("vintage", F.lit("conflict").alias("kind")))


_HASH = "sha256('event_type|' || event_type || '|user_id|' || user_id)"


@REG.add(
    "hash_chain_audit",
    "O-15 O-16",
    f"""select event_id, case when parent is distinct from prev then 'PARENT' when h <> {_HASH} then 'DIGEST' end as broken from (
      select event_id, event_type, user_id, h, case when event_id % 101 = 0 then 'x' else lag(h) over (partition by event_type order by ts, event_id) end as parent,
        lag(h) over (partition by event_type order by ts, event_id) as prev
      from (select *, case when event_id % 97 = 0 then 'bad' else {_HASH} end as h from events))
    where (parent is distinct from prev) or h <> {_HASH}""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("h", F.when(F.col("event_id") % 97 == 0, "bad").otherwise(G.payload_hash(["event_type", "user_id"])))
    hour = F.date_trunc("hour", "ts")
    chain = P.block_lag(e, ["event_type"], hour, ["ts", "event_id"], {"parent": "h"})
    chain = chain.withColumn("parent", F.when(F.col("event_id") % 101 == 0, "x").otherwise(F.col("parent")))
    return G.verify_chain(chain, ["event_type"], ["ts", "event_id"], "h", "parent", ["event_type", "user_id"], hour).select("event_id", "broken")


@REG.add(
    "group_content_hash",
    "O-16 A-14",
    """select o_orderpriority, sha256(string_agg(dg, '' order by b1)) as group_hash, sum(n)::bigint as "rows" from (
      select o_orderpriority, b1, sha256(string_agg(dg, '' order by b0)) as dg, sum(n) as n from (
        select o_orderpriority, o_orderkey // 100000 as b1, o_orderkey // 1000 as b0, sha256(string_agg(sha256('o_custkey|' || o_custkey || '|o_orderstatus|' || o_orderstatus), '' order by o_orderkey)) as dg, count(*) as n
        from orders group by all) group by all) group by o_orderpriority""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return G.group_hash(o, ["o_orderpriority"], ["o_orderkey"], ["o_custkey", "o_orderstatus"], [F.floor(key / 1000), F.floor(key / 100000)])


@REG.add(
    "table_fingerprint",
    "A-14",
    """select o_orderpriority, count(*) as "rows", bit_xor(('0x' || sha256('o_custkey|' || o_custkey || '|o_orderkey|' || o_orderkey || '|o_orderstatus|' || o_orderstatus)[1:15])::bigint) as fingerprint from orders group by o_orderpriority""",
)
def _(spark, sf):
    return G.table_fingerprint(V.table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@REG.add(
    "availability_policies",
    "O-17",
    """select d::varchar as observed, strftime(case dayofweek(d) when 4 then d + 4 when 5 then d + 4 when 6 then d + 3 when 0 then d + 2 else d + 2 end + interval '15 hours 59 minutes', '%Y-%m-%d %H:%M:%S') as fund_nav,
      strftime(date_trunc('month', d) + interval 1 month + interval 14 day + interval 4 hour, '%Y-%m-%d %H:%M:%S') as month_plus_14, strftime(d + interval 10 hour, '%Y-%m-%d %H:%M:%S') as same_day_evening
    from (select distinct o_orderdate::date as d from orders)""",
)
def _(spark, sf):
    d = V.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("observed")).distinct()
    return d.select("observed", *[G.available_at(F.col("observed"), F.lit(p)).alias(p) for p in ("fund_nav", "month_plus_14", "same_day_evening")])


@REG.add(
    "completed_daily_points",
    "O-18",
    "select l_orderkey, count(*) as n from lineitem where l_shipdate = date_trunc('day', l_shipdate) and dayofweek(l_shipdate) between 1 and 5 group by l_orderkey",
)
def _(spark, sf):
    return G.complete_daily(V.table(spark, sf, "lineitem"), "l_shipdate").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@REG.add(
    "html_table_extraction",
    "O-19",
    with_views(
        f"""select symbol || strftime(period, '%Y%m') as page_id, row_number() over (partition by symbol, strftime(period, '%Y%m') order by period) as row_no, (period)::varchar as day, floor(close)::double as nav from w
        where regexp_matches('x', 'x')"""
    ),
)
def _(spark, sf):
    """Whole page table plus pages whose tables Spark renders from weekly bars."""
    w = V.bars_weekly(spark, sf)
    row = F.concat(F.lit("<tr><td>"), F.col("period").cast("string"), F.lit("</td><td><b>"), F.format_number(F.floor("close"), 0), F.lit("</b></td></tr>"))
    made = w.groupBy(F.concat("symbol", F.date_format("period", "yyyyMM")).alias("page_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period", row.alias("r")))), lambda x: x["r"]), "").alias("_rows")
    )
    made = made.select("page_id", F.concat(F.lit("<p>x</p><TABLE class='t'><tr><th>净值日期</th><th>NAV</th></tr>"), "_rows", F.lit("</TABLE>")).alias("html"))
    pages = V.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("page_id"), "html")
    cells = R.extract_tables(pages.unionByName(made))
    wide = cells.groupBy("page_id", "table_no", "row_no").agg(
        F.max(F.when(F.col("header") == "净值日期", F.col("value"))).alias("day"), F.max(F.when(F.col("header") == "NAV", F.col("value"))).alias("nav")
    )
    return wide.select("page_id", "row_no", S.clean_date("day").alias("day"), S.clean_decimal("nav").alias("nav"))


@REG.add("chart_json_rows", "O-20", with_views(f"select symbol, {day('trade_date')} as trade_date, {r('close')} as close from w"))
def _(spark, sf):
    w = V.bars_weekly(spark, sf).groupBy("symbol", F.trunc("trade_date", "month").alias("m")).agg(
        F.array_sort(F.collect_list(F.struct(F.unix_timestamp(F.col("trade_date").cast("timestamp")).alias("t"), F.col("close").alias("c")))).alias("p")
    )
    payload = F.to_json(F.struct(F.transform("p", lambda x: x["t"]).alias("timestamp"), F.transform("p", lambda x: x["c"]).alias("close")))
    rows = R.explode_chart_json(w.select("symbol", payload.alias("payload")), ["symbol"])
    return rows.select("symbol", F.col("ts").cast("date").alias("trade_date"), "close")


@REG.add(
    "tick_size_prices",
    "O-22",
    with_views(f"select {KEY}, {r('round_even(close / k, 0) * k')} as close from (select *, case when symbol like 'A%' then 0.05::double when symbol like 'N%' then 0.5::double else 10.0::double end as k from d)"),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf).select("symbol", "trade_date", "close")
    tick = F.when(F.col("symbol").startswith("A"), 0.05).when(F.col("symbol").startswith("N"), 0.5).otherwise(10.0)
    return G.apply_ticks(d, d.select("symbol").distinct().withColumn("tick", tick), ["close"], ["symbol"]).drop("tick")


@REG.add(
    "freshness_check",
    "O-27 T-05",
    with_views(
        """select symbol, max(trade_date)::varchar as latest, max(e)::varchar as expected, (max(trade_date) >= max(e))::bigint as fresh
        from d, (select max(session_date) as e from cal where session_date + interval '7 hours 35 minutes' <= timestamp '2001-10-10 07:30:00') group by symbol"""
    ),
)
def _(spark, sf):
    return G.freshness(V.bars_daily(spark, sf), V.calendar(spark, sf), "2001-10-10 07:30:00", "15:05", "Asia/Shanghai")


@REG.add(
    "validated_forecasts",
    "O-29",
    """select event_id, case when not (event_type in ('click', 'view', 'purchase')) then 1 else 0 end + case when value > 50 then 1 else 0 end + case when event_id % 11 = 0 then 1 else 0 end as problems from events""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.when(F.col("event_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("trend"))).alias("reasons")
    )
    ok, bad = G.validate_forecasts(e, {"event_type": ("click", "view", "purchase")}, {"value": (-1e9, 50.0)}, "reasons")
    return ok.select("event_id", F.lit(0).alias("problems")).unionByName(bad.select("event_id", F.size("issues").alias("problems")))


# ---- point in time -----------------------------------------------------------------

CUTS = ("2024-01-08 00:00:00", "2024-01-15 12:00:00", "2024-01-31 00:00:00")


@REG.add(
    "latest_vintage_as_of",
    "J-02",
    with_views(
        f"""select series, {day('effective_date')} as effective_date, c::varchar as cutoff, arg_max(vintage, (available_at, vintage)) as vintage, arg_max(value, (available_at, vintage)) as value
        from obs, (values {', '.join(f"(timestamp '{c}')" for c in CUTS)}) cs(c) where available_at <= c and quality = 'accepted' group by all"""
    ),
)
def _(spark, sf):
    return pit.as_of_vintage(V.observations(spark, sf), CUTS).select("series", "effective_date", "cutoff", "vintage", "value")


@REG.add(
    "bar_revisions_as_of",
    "J-03",
    """select symbol, trade_date::varchar as trade_date, arg_max(p, k) as close from (
      select o_orderpriority as symbol, date_trunc('week', o_orderdate)::date as trade_date, o_orderdate as available, o_totalprice as p, (o_orderdate, o_orderkey) as k from orders) where available <= timestamp '1998-06-30' group by all""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), S.week_start("o_orderdate").alias("trade_date"), F.col("o_orderdate").cast("timestamp").alias("available_at"),
        F.col("o_orderkey").alias("revision"), F.col("o_totalprice").alias("close"),
    )
    return pit.bars_as_of(o, ["1998-06-30"], ["available_at", "revision"]).select("symbol", "trade_date", "close")


@REG.add(
    "trades_asof_price",
    "J-04 J-08",
    with_views(
        f"""select account_id, count(m.close) as matched, {r('sum(floor(m.close * 100))')} as total_cents, max(m.trade_date)::varchar as last_price_date
        from trd t asof left join (select symbol[2] as symbol, trade_date, max(close) as close from d group by all) m on m.symbol = t.symbol and t.trade_date >= m.trade_date group by account_id"""
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf).groupBy(F.substring("symbol", 2, 1).alias("symbol"), F.col("trade_date").alias("price_date")).agg(F.max("close").alias("close"))
    hit = P.asof_join(V.trades(spark, sf).select("account_id", "symbol", "trade_date"), d, ["symbol"], "trade_date", "price_date", ["close"])
    return hit.groupBy("account_id").agg(F.count("close").alias("matched"), F.sum(F.floor(F.col("close") * 100)).cast("double").alias("total_cents"), F.max("matched_price_date").alias("last_price_date"))


@REG.add(
    "benchmark_alignment_utc",
    "J-05",
    with_views(
        f"""select t.symbol, t.trade_date::varchar as trade_date, b.trade_date::varchar as bench_date, {r('b.close')} as bench_close
        from (select symbol, trade_date from d where symbol <> 'AF') t asof left join (select trade_date, close from d where symbol = 'AF') b on t.trade_date > b.trade_date"""
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf)
    bench = d.where("symbol = 'AF'").select("trade_date", F.col("close").alias("bench_close"))
    return pit.align_benchmark(d.where("symbol <> 'AF'").select("symbol", "trade_date"), bench, ["bench_close"])


@REG.add(
    "strict_previous_benchmark",
    "J-06 W-37",
    with_views(
        f"""select symbol, {day('trade_date')} as trade_date, {r('bench')} as bench_close, {r(f'case when count(g) over f = 20 then stddev_pop(g) over f * sqrt(252) end')} as tracking_error_20 from (
          select symbol, trade_date, bench, close / lag(close) over o - 1 - (bench / lag(bench) over o - 1) as g from (
            select t.symbol, t.trade_date, t.close, b.close as bench from (select * from d where symbol <> 'AF') t asof left join (select trade_date, close from d where symbol = 'AF') b on t.trade_date > b.trade_date)
          window o as (partition by symbol order by trade_date)) window f as (partition by symbol order by trade_date rows between 19 preceding and current row)"""
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf)
    bench = d.where("symbol = 'AF'").select(F.lit(1).alias("one"), F.col("trade_date").alias("bench_date"), F.col("close").alias("bench_close"))
    left = d.where("symbol <> 'AF'").select("symbol", "trade_date", "close", F.lit(1).alias("one"))
    hit = P.asof_join(left, bench, ["one"], "trade_date", "bench_date", ["bench_close"], strict=True)
    return pit.tracking_error(hit, "close", "bench_close", 20).select("symbol", "trade_date", "bench_close", "tracking_error_20")


def _series_pairs(series):
    """Pairs (first, second) of different series, first before second by name; the catalog of series is a small table."""
    catalog = series.select("symbol").distinct()
    names = catalog.select(F.array_sort(F.collect_set("symbol"))).scalar()
    return catalog.withColumn("_all", names).select(F.col("symbol").alias("first"), F.explode(F.filter("_all", lambda x: x > F.col("symbol"))).alias("second"))


def _side(df, pairs, side):
    """Rows of df for every pair in which their series is the first or the second."""
    return df.join(pairs.withColumn("symbol", F.col(side)), "symbol").drop("symbol")


@REG.add(
    "outer_fill_alignment",
    "J-07",
    with_views(
        f"""select "first", "second", {day('trade_date')} as trade_date, {r('a')} as a_close, {r('b')} as b_close, {r('a - b')} as diff_close from (
          select "first", "second", trade_date, last_value(a ignore nulls) over o as a, last_value(b ignore nulls) over o as b from (
            select p.a as "first", p.b as "second", t.trade_date, x.close as a, y.close as b
            from (select a.symbol as a, b.symbol as b from (select distinct symbol from d) a join (select distinct symbol from d) b on a.symbol < b.symbol) p
            join (select symbol, trade_date from d union all select 'week ' || symbol, trade_date from w) t on t.symbol in (p.a, 'week ' || p.b)
            left join d x on x.symbol = p.a and x.trade_date = t.trade_date left join w y on y.symbol = p.b and y.trade_date = t.trade_date group by all)
          window o as (partition by "first", "second" order by trade_date rows between unbounded preceding and current row))"""
    ),
)
def _(spark, sf):
    """Daily closes of each series beside the weekly closes of every later one, carried forward on the union of their dates."""
    daily, weekly = (v(spark, sf).select("symbol", "trade_date", "close") for v in (V.bars_daily, V.bars_weekly))
    pairs = _series_pairs(daily)
    return pit.align_outer_ffill(_side(daily, pairs, "first"), _side(weekly, pairs, "second"), ["first", "second"], "trade_date", ["close"])


@REG.add(
    "forward_returns",
    "J-10",
    with_views(f"select {KEY}, {r('lead(close, 4) over o / close - 1')} as close_fwd_4, {r('lead(close, 13) over o / close - 1')} as close_fwd_13 from w window o as (partition by symbol order by trade_date)"),
)
def _(spark, sf):
    return pit.lead_join(V.bars_weekly(spark, sf), "close", [4, 13], ["symbol"], "trade_date").select("symbol", "trade_date", "close_fwd_4", "close_fwd_13")


@REG.add(
    "overlap_weights",
    "J-11 M-09 A-20",
    with_views(
        f"""select symbol, {r('pow(sum(wt), 2) / sum(wt * wt)')} as effective_n, count(*) as n, max(c) as max_concurrent from (
          select a.symbol, a.trade_date, count(*) as c, 1.0::double / count(*) as wt
          from lab a join lab b on b.symbol = a.symbol and b.trade_date < a.e and a.trade_date < b.e group by a.symbol, a.trade_date) group by symbol""",
        lab="select * from (select symbol, trade_date, lead(trade_date, 13) over (partition by symbol order by trade_date) as e from w) where e is not null",
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf).withColumn("label_end", F.lead("trade_date", 13).over(P.ordered())).where("label_end is not null")
    out = pit.overlap_weights(w.select("symbol", F.col("trade_date").alias("anchor"), "label_end"), ["symbol"])
    return out.groupBy("symbol").agg(
        (F.pow(F.sum("weight"), 2) / F.sum(F.col("weight") * F.col("weight"))).alias("effective_n"), F.count("*").alias("n"), F.max("concurrent").alias("max_concurrent")
    )


@REG.add(
    "nearest_match",
    "J-13 J-14",
    with_views(
        f"""select symbol, {day('trade_date')} as trade_date, m::varchar as nearest_m_date, dist as session_distance from (
          select w.symbol, w.trade_date, m.trade_date as m, (select count(*) from cal where session_date <= m.trade_date) - (select count(*) from cal where session_date <= w.trade_date) as dist,
            row_number() over (partition by w.symbol, w.trade_date order by abs(m.trade_date - w.trade_date), m.trade_date) as k
          from w join m on m.symbol = w.symbol) where k = 1"""
    ),
)
def _(spark, sf):
    w = V.bars_weekly(spark, sf).select("symbol", "trade_date")
    m = V.bars_monthly(spark, sf).select("symbol", F.col("trade_date").alias("m_date"), "close")
    near = P.nearest_join(w, m, ["symbol"], "trade_date", "m_date", ["close"])
    return pit.session_distance(near, V.calendar(spark, sf), "trade_date", "nearest_m_date").drop("close")


_PAIRED = """(select a.symbol as a, b.symbol as b from (select distinct symbol from d) a join (select distinct symbol from d) b on a.symbol < b.symbol) p"""


@REG.add(
    "key_sets",
    "J-15 U-01 U-02 U-03",
    with_views(
        f"""select p.a as "first", p.b as "second", s.side, count(*) as n from {_PAIRED} join lateral (
          select 'both' as side, trade_date from d where symbol = p.a and trade_date in (select trade_date from d where symbol = p.b)
          union all select 'only_first', trade_date from d where symbol = p.a and trade_date not in (select trade_date from d where symbol = p.b)
          union all select 'only_second', trade_date from d where symbol = p.b and trade_date not in (select trade_date from d where symbol = p.a)
          union all select 'missing', trade_date from d where symbol = p.a and trade_date not in (select trade_date from d where symbol = p.b)
          union all select 'kept', trade_date from d where symbol = p.a and trade_date in (select trade_date from d where symbol = p.b)
          union all (select 'either', trade_date from d where symbol in (p.a, p.b) group by trade_date)) s on true group by all"""
    ),
)
def _(spark, sf):
    """Sessions that two series share, that only one has, and that either has, for every pair of series."""
    d = V.bars_daily(spark, sf).select("symbol", "trade_date")
    pairs = _series_pairs(d)
    a, b = _side(d, pairs, "first"), _side(d, pairs, "second")
    keys = ["first", "second", "trade_date"]
    sides = [
        pit.common_keys(a, b, keys).withColumn("side", F.lit("both")),
        pit.key_diff(a, b, keys),
        pit.only_missing(a, b, keys).withColumn("side", F.lit("missing")),
        pit.drop_stale(a, b, keys).withColumn("side", F.lit("kept")),
        a.select(*keys).union(b.select(*keys)).distinct().withColumn("side", F.lit("either")),
    ]
    return functools.reduce(DataFrame.unionByName, sides).groupBy("first", "second", "side").agg(F.count("*").alias("n"))


@REG.add(
    "observation_changes",
    "W-36",
    with_views(
        f"""select v.symbol as series, {day('v.trade_date')} as effective_date, {r('v.pe / o1.pe - 1')} as change_1, {r('v.pe / o4.pe - 1')} as change_4,
          {r('v.pe / v.p1 - 1 - (v.p1 / v.p2 - 1)')} as acceleration
        from (select *, trade_date - 7 as t1, trade_date - 28 as t4, lag(pe) over o as p1, lag(pe, 2) over o as p2 from val window o as (partition by symbol order by trade_date)) v
        asof left join val o1 on o1.symbol = v.symbol and v.t1 >= o1.trade_date asof left join val o4 on o4.symbol = v.symbol and v.t4 >= o4.trade_date"""
    ),
)
def _(spark, sf):
    v = V.valuation(spark, sf).select(F.col("symbol").alias("series"), F.col("trade_date").alias("effective_date"), F.col("pe").alias("value"))
    return pit.obs_changes(v, [1, 4]).drop("value")


@REG.add(
    "expanding_valuation_percentile",
    "W-35",
    with_views(
        f"""select symbol, {day('trade_date')} as trade_date, {r('100.0 * (select count(*) from val z where z.symbol = val.symbol and z.trade_date <= val.trade_date and z.pe <= val.pe) / row_number() over (partition by symbol order by trade_date)')} as pe_percentile,
          {r('100 * cume_dist() over (partition by symbol order by pe)')} as pe_percentile_full from val"""
    ),
)
def _(spark, sf):
    v = pit.expanding_percentile(V.valuation(spark, sf), "pe")
    return pit.percentile_full(v, "pe").select("symbol", "trade_date", "pe_percentile", "pe_percentile_full")


# ---- samples -------------------------------------------------------------------------

@REG.add(
    "weekly_session_sample",
    "K-04",
    with_views(
        f"""select symbol, wk as week_key, days[1 + [b for b in [('0x' || hx[i * 2 + 1 : i * 2 + 2])::int for i in range(0, 32)] if b < 256 - 256 % n][1] % n]::varchar as trade_date, n as candidates from (
          select symbol, wk, days, len(days) as n, sha256('20260730:' || symbol || ':' || wk) as hx from (
            select symbol, strftime(trade_date, '%G-W%V') as wk, list_sort(list(distinct trade_date)) as days from d group by symbol, strftime(trade_date, '%G-W%V')))"""
    ),
)
def _(spark, sf):
    return K.weekly_sample(V.bars_daily(spark, sf), 20260730)


@REG.add(
    "weekly_session_sample_mod64",
    "K-05",
    with_views(
        f"""select symbol, wk as week_key, days[1 + (('0x' || hx[1 : 16])::ubigint % n)::int]::varchar as trade_date, n as candidates from (
          select symbol, wk, days, len(days) as n, sha256('330020:' || symbol || ':' || wk) as hx from (
            select symbol, strftime(trade_date, '%G-W%V') as wk, list_sort(list(distinct trade_date)) as days from d group by symbol, strftime(trade_date, '%G-W%V')))"""
    ),
)
def _(spark, sf):
    return K.weekly_sample(V.bars_daily(spark, sf), 330020, kind="mod64")


@REG.add(
    "strided_anchor_sample",
    "K-06",
    with_views(
        f"""select symbol, {day('trade_date')} as trade_date from (select *, rn - 1 as j, count(*) over (partition by symbol) as n from wn) where j >= n - 52 or n <= 120
          or j in (select floor(i * greatest(1.0::double, (n - 52) / 68.0::double))::bigint from range(0, 68) t(i)) and j < n - 52"""
    ),
)
def _(spark, sf):
    return K.strided_sample(V.bars_weekly(spark, sf), 120).select("symbol", "trade_date")


@REG.add(
    "latest_rows",
    "K-01 K-03",
    with_views(
        f"""select a.symbol, {day('a.trade_date')} as trade_date, {r('a.close')} as close, x.lo_idx from (select * from wn qualify row_number() over (partition by symbol order by trade_date desc) <= 10) a
        join (select symbol, arg_min(rn, (close, rn)) as lo_idx from wn group by symbol) x on x.symbol = a.symbol"""
    ),
)
def _(spark, sf):
    w = B.bar_context(V.bars_weekly(spark, sf))
    lows = P.arg_extreme(w, ["symbol"], "close", "ordinal").withColumnRenamed("ordinal", "lo_idx")
    return P.last_n(w, 10).select("symbol", "trade_date", "close").join(lows, "symbol")
