"""Panels derived from the given tables; every registered query starts from one of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.functions.scalar import safe_div
from barloom.operators.bars import resample_bars, ticks_to_bars

TICK_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        *TICK_ORDER,
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), TICK_ORDER)


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_bars(bars_daily(spark, sf_dir), "week")


def bars_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_bars(bars_daily(spark, sf_dir), "month")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("session_date")).distinct()


def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order value per priority; cents are summed exactly, so the mean has one value."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("trade_date")).agg(
        (F.sum(cents) / F.count("*") / 1000000.0).alias("pe")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("series"),
        F.col("ts").cast("date").alias("effective_date"),
        F.col("ts").cast("timestamp").alias("available_at"),
        F.col("event_id").alias("vintage"),
        "value",
        F.when(F.col("event_id") % 17 == 0, "rejected").otherwise("accepted").alias("quality"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("account_id"),
        F.col("l_linestatus").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        *TICK_ORDER,
    )


def cashflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("flow_date"),
        F.col("o_totalprice").alias("amount"),
        "o_orderkey",
    )


def position_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("operation_date"),
        "event_id",
        F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("direction"),
        F.lit(5).alias("pct"),
    )


def forecasts(weekly: DataFrame, lookback: int = 52, horizons: tuple[int, ...] = (1, 4, 8, 13)) -> DataFrame:
    """Naive forecasts per weekly anchor: quantiles and class shares of the trailing h-week returns."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    base = weekly.select("symbol", "trade_date", "close").withColumn("ordinal", F.row_number().over(w))
    per_h = base.withColumns({f"_r{h}": safe_div(F.col("close"), F.lag("close", h).over(w)) - 1 for h in horizons})
    per_h = per_h.withColumns({f"_a{h}": safe_div(F.lead("close", h).over(w), F.col("close")) - 1 for h in horizons})
    long = per_h.select(
        "symbol",
        F.col("trade_date").alias("anchor"),
        "ordinal",
        F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_r{h}").alias("past"), F.col(f"_a{h}").alias("actual")) for h in horizons])),
    )
    frame = f"over (partition by symbol, h order by anchor rows between {lookback - 1} preceding and current row)"
    wf = Window.partitionBy("symbol", "h").orderBy("anchor").rowsBetween(-(lookback - 1), 0)
    threshold = 0.05
    out = long.withColumns(
        {
            **{f"p{int(q * 100)}": F.expr(f"percentile(past, {q}) {frame}") for q in (0.1, 0.5, 0.9)},
            "p_up": F.avg((F.col("past") > threshold).cast("double")).over(wf),
            "p_down": F.avg((F.col("past") < -threshold).cast("double")).over(wf),
            "_n": F.count("past").over(wf),
        }
    )
    return out.where(F.col("_n") == lookback).select(
        "symbol", "anchor", "ordinal", "h", "p10", "p50", "p90", "p_up", (1 - F.col("p_up") - F.col("p_down")).alias("p_side"), "p_down", "actual"
    )
