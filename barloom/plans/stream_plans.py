"""Streaming jobs run over the events table until it is exhausted."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.scalar import cut
from barloom.operators import ledger as LG
from barloom.plans import views as V
from barloom.plans.ledger_plans import ORDER
from barloom.plans.registry import REG
from barloom.plans.sqlviews import r
from barloom.session import shared_dir
from barloom.streaming import jobs as J, ledger as SL


def _dir(spark, name: str) -> str:
    return f"{shared_dir(spark)}/barloom-stream-{name}-{uuid.uuid4().hex[:8]}"


def _events(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return J.read_stream(spark, sf, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@REG.add(
    "streamed_bars",
    "T-01 A-03",
    f"""select symbol, period::varchar as period, open, high, low, close, {r('volume')} as volume, (period + 7 <= max(lt) over ())::bigint as is_complete from (
      select event_type as symbol, date_trunc('week', ts)::date as period, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*)::double as volume, max(ts) as lt from events group by all)""",
)
def _(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    out = _dir(spark, "bars")
    J.run_bars(e, ["ts", "event_id"], out, _dir(spark, "cp"), "week").awaitTermination()
    return J.bars_view(spark, out).drop("period_end", "last_tick")


_LATE = "case when event_id % 5 = 0 then 3 when event_type = 'click' then 2 when dayofmonth(ts) <= 10 then 0 when dayofmonth(ts) <= 20 then 1 else 2 end"


@REG.add(
    "streamed_corrections",
    "T-02",
    f"select event_type as series, ts::date::varchar as d, arg_max(value, ({_LATE}) * 1000000000::bigint + event_id) as value from events group by all",
)
def _(spark, sf):
    """Four deliveries: two by date, one in which a series comes first, and one of corrections to all dates."""
    folder, out = _dir(spark, "deliveries"), _dir(spark, "fix")
    events = V.table(spark, sf, "events").withColumn("delivery", F.expr(_LATE))
    for i in range(4):
        events.where(F.col("delivery") == i).drop("delivery").coalesce(1).write.mode("append").parquet(folder)
    e = J.read_stream(spark, folder, "*.parquet", V.table(spark, sf, "events").schema, files_per_trigger=1)
    e = e.select(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("d"), "value", "event_id")
    J.run_batches(e, J.correction_sink(spark, out, ["series", "d"], ["value"], ["event_id"], whole_every=2), _dir(spark, "cp"), "append").awaitTermination()
    return J.current_table(spark, out, ["series", "d"], ["value"], whole_every=2)


@REG.add("streamed_revisions", "T-03", "select event_type as series, count(*) as revisions, max(event_id) as last_revision from events group by event_type")
def _(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("series"), "event_id", F.col("ts").alias("available_at"), "value")
    twice = e.unionByName(_events(spark, sf).select(F.col("event_type").alias("series"), "event_id", F.col("ts").alias("available_at"), "value"))
    out = _dir(spark, "rev")
    J.append_to(J.revision_stream(twice, ["series", "event_id"], watermark="60 days"), out, _dir(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).groupBy("series").agg(F.count("*").alias("revisions"), F.max("event_id").alias("last_revision"))


@REG.add(
    "streamed_positions",
    "T-04 S-12",
    "select event_id, sum(case when event_id % 2 = 0 then 5 else -5 end) over (partition by event_type order by ts, event_id)::bigint as position from events",
)
def _(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("symbol"), "ts", "event_id", F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("direction"), F.lit(5).alias("pct"))
    out = _dir(spark, "pos")
    sink = J.position_sink(spark, out, _dir(spark, "state"), ["symbol"], ["ts", "event_id"], lambda: F.date_trunc("hour", "ts"))
    J.run_batches(e, sink, _dir(spark, "cp"), "append").awaitTermination()
    return spark.read.parquet(out).select("event_id", "position")


@REG.add("streamed_ledger", "T-04 S-15", REG.sql["average_cost_ledger"])
def _(spark, sf):
    """Trades delivered in four batches by date; the query stops after each and goes on from its checkpoint."""
    folder, out, cp = _dir(spark, "trades"), _dir(spark, "ledger"), _dir(spark, "cp")
    trades = V.trades(spark, sf).withColumn("fee", LG.fee_breakdown(F.col("quantity") * F.col("price"), "side")["total"])
    columns = ["account_id", "symbol", *ORDER, "side", "quantity", "price", "fee"]
    cuts = ["1993-06-01", "1995-01-01", "1996-09-01"]
    part = sum((F.when(F.col("trade_date") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = trades.select(*columns, part.alias("_part"))
    lots = max(64, -(-V.table(spark, sf, "lineitem").count() // 16_384))
    for i in range(len(cuts) + 1):
        # one run takes all files of a delivery, however many, in one batch
        dealt.where(F.col("_part") == i).drop("_part").write.mode("append").parquet(folder)
        stream = J.read_stream(spark, folder, "*.parquet", dealt.drop("_part").schema)
        SL.run_ledger(stream, LG.HOLDING, ORDER, out, cp, lots).awaitTermination()
    last = lambda c: F.max_by(c, F.struct(*ORDER))
    return spark.read.parquet(out).groupBy(*LG.HOLDING).agg(
        F.count("*").alias("trades"), last("holding").alias("holding"), cut(last("total_cost"), 4).alias("total_cost"), cut(last("realized_pnl"), 3).alias("realized_pnl"), cut(last("cash_balance"), 3).alias("cash_change")
    )


@REG.add(
    "streamed_freshness_alerts",
    "T-05 O-27",
    """select user_id, max(ts::date)::varchar as latest, (select max(ts::date) from events)::varchar as expected from events group by user_id having max(ts::date) < (select max(ts::date) from events)""",
)
def _(spark, sf):
    cal = V.table(spark, sf, "events").select(F.col("ts").cast("date").alias("session_date")).distinct()
    out = _dir(spark, "fresh")
    sink = J.freshness_sink(cal, out, "2030-01-01 00:00:00", ["user_id"], "15:05", "Asia/Shanghai")
    J.run_batches(J.latest_session_stream(_events(spark, sf), ["user_id"]), sink, _dir(spark, "cp"), "update").awaitTermination()
    return spark.read.parquet(out).select("user_id", "latest", "expected")
