"""Sinks: partitioned bar tables and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars in folders by timeframe, clustered by symbol and date inside the files so footers prune."""
    out = df if "timeframe" in df.columns else df.withColumn("timeframe", F.lit("daily"))
    out.repartitionByRange("timeframe", "symbol", "trade_date").sortWithinPartitions("timeframe", "symbol", "trade_date").write.mode(
        mode
    ).partitionBy("timeframe").parquet(path)


def write_bar_table(df: DataFrame, name: str, buckets: int = 64) -> None:
    """Managed table bucketed by symbol: windows and joins per symbol then need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "trade_date").saveAsTable(name)


def replace_periods(df: DataFrame, path: str) -> None:
    """Overwrite only the period folders present in ``df`` (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
