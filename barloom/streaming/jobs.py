"""Structured Streaming jobs: bars from ticks, late corrections, revision logs, running positions, freshness.

All sinks write one folder per micro-batch and overwrite it on a retry, so a
batch that runs twice leaves the same files. State that must survive is either
Spark's own (windows, de-duplication) or such a folder; nothing lives on a driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.ingest import freshness, upsert
from barloom.operators.panel import block_scan, latest


def read_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process what is available now, batch by batch, and stop; rerun to continue from the checkpoint."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def write_batch(df: DataFrame, out: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(out, batch_id))


# ---- bars ---------------------------------------------------------------------------

def bar_stream(ticks: DataFrame, order: Sequence[str], unit: str = "day", watermark: str = "14 days", key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Day or week bars (weeks start on Monday) over an event-time window; update mode re-emits open periods."""
    span = F.window(ts, "1 day") if unit == "day" else F.window(ts, "7 days", "7 days", "4 days")
    o = F.struct(*order)
    g = ticks.withWatermark(ts, watermark).groupBy(key, span.alias("_w")).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"),
        F.sum("volume").alias("volume"), F.max(ts).alias("last_tick"),
    )
    return g.select(key, F.col("_w.start").cast("date").alias("period"), F.col("_w.end").alias("period_end"), "open", "high", "low", "close", "volume", "last_tick")


def bars_view(spark: SparkSession, out: str, key: str = "symbol") -> DataFrame:
    """Newest version of every bar; a bar is provisional until a tick after its period has been seen."""
    log = spark.read.parquet(out)
    newest = latest(log, [key, "period"], ["batch_id"])
    seen = log.select(F.max("last_tick")).scalar()
    return newest.withColumn("is_complete", F.col("period_end") <= seen).drop("batch_id")


def run_bars(ticks: DataFrame, order: Sequence[str], out: str, checkpoint: str, unit: str = "day", watermark: str = "14 days") -> StreamingQuery:
    return run_batches(bar_stream(ticks, order, unit, watermark), lambda df, i: write_batch(df, out, i), checkpoint)


# ---- late corrections ------------------------------------------------------------------

def correction_sink(spark: SparkSession, out: str, keys: Sequence[str], values: Sequence[str], order: Sequence[str], whole_every: int = 10) -> Callable[[DataFrame, int], None]:
    """Upsert each batch into a log of changes: the last record per key wins, unchanged rows are not written.

    Every row is applied, however old its date and however late its key is first seen. Every ``whole_every``-th batch
    writes the whole table, so a read needs that one and the changes after it.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        batch = latest(df.select(*keys, *values, *[c for c in order if c not in keys and c not in values]), keys, order).select(*keys, *values)
        stored = current_table(spark, out, keys, values, before=batch_id, whole_every=whole_every)
        if stored is None:
            write_batch(batch.withColumn("outcome", F.lit("added")), out, batch_id)
            return
        merged, audit = upsert(stored, batch, keys, values)
        outcomes = audit.where(F.col("outcome").isin("added", "updated")).select(*keys, "outcome")
        write_batch(merged.select(*keys, *values).join(outcomes, list(keys), "inner" if batch_id % whole_every else "left"), out, batch_id)

    return sink


def change_log(spark: SparkSession, out: str) -> DataFrame | None:
    """The log with its batch_id, or None while nothing has been written."""
    try:
        return spark.read.parquet(out)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def current_table(spark: SparkSession, out: str, keys: Sequence[str], values: Sequence[str], before: int | None = None, whole_every: int | None = None) -> DataFrame | None:
    """Latest version per key from the change log, or None while there is none.

    ``before``: batches from this one on do not count. ``whole_every``: the log holds the whole table so often.
    """
    log = change_log(spark, out)
    if log is None:
        return None
    if before is not None:
        log = log.where(F.col("batch_id") < before)
    last = log.select(F.max("batch_id")).first()[0]
    if last is None:
        return None
    if whole_every:
        log = log.where(F.col("batch_id") >= last // whole_every * whole_every)
    return latest(log.select(*keys, *values, "batch_id"), keys, ["batch_id"]).select(*keys, *values)


# ---- revision log ------------------------------------------------------------------------

def revision_stream(obs: DataFrame, identity: Sequence[str], ts: str = "available_at", watermark: str = "14 days") -> DataFrame:
    """Each revision identity once, however often its source repeats it within the watermark."""
    return obs.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(identity))


def append_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- running position ----------------------------------------------------------------------

def position_sink(spark: SparkSession, out: str, state: str, by: Sequence[str], order: Sequence[str], block: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """Running position per key across batches.

    A batch is scanned in two levels, as in the batch operator, so a hot key is
    spread over its time blocks; the total per key carried into the batch is the
    state folder of the previous one. Batches must arrive in event order.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        signed = F.when(F.col("direction") == "+", F.col("pct")).otherwise(-F.col("pct"))
        local = block_scan(df, by, block(), order, {"_run": signed})
        before = current_table(spark, state, by, ["total"], before=batch_id)
        if before is None:
            before = df.select(*by).distinct().withColumn("total", F.lit(0).cast("bigint"))
        carried = local.join(before, list(by), "left").withColumn("position", F.col("_run") + F.coalesce("total", F.lit(0)))
        write_batch(carried.drop("_run", "total"), out, batch_id)
        moved = df.groupBy(*by).agg(F.sum(signed).alias("_d"))
        after = moved.join(before, list(by), "left").select(*by, (F.col("_d") + F.coalesce("total", F.lit(0))).alias("total"))
        write_batch(after, state, batch_id)

    return sink


# ---- freshness ---------------------------------------------------------------------------------

def freshness_sink(calendar: DataFrame, out: str, now: str, by: Sequence[str], close_hhmm: str, zone: str, delay_minutes: int = 30) -> Callable[[DataFrame, int], None]:
    """Alerts of every batch: keys whose latest session is behind the calendar. ``df`` has by and trade_date."""
    def sink(df: DataFrame, batch_id: int) -> None:
        state = freshness(df, calendar, now, close_hhmm, zone, delay_minutes, by)
        write_batch(state.where(~F.col("fresh")), out, batch_id)

    return sink


def latest_session_stream(events: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    return events.groupBy(*by).agg(F.max(F.col(ts).cast("date")).alias("trade_date"))
