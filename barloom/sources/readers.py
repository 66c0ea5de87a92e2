"""Sources: bar tables, bar CSV with header aliases, HTML tables, chart JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.scalar import SCALE8, clean_date, clean_decimal, header_key

# Accepted header spellings of a bar file.
BAR_ALIASES: dict[str, tuple[str, ...]] = {
    "trade_date": ("date", "trade_date", "日期"),
    "open": ("raw_open", "open", "open_price", "开盘"),
    "high": ("raw_high", "high", "high_price", "最高"),
    "low": ("raw_low", "low", "low_price", "最低"),
    "close": ("raw_close", "close", "close_price", "收盘"),
    "adjusted_close": ("adj_close", "adjusted_close", "adjusted_close_price"),
    "volume": ("volume", "成交量"),
    "amount": ("amount", "成交额"),
}


def read_bars(
    spark: SparkSession, path: str, timeframe: str | None = None, start: str | None = None, end: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Bars of one timeframe and date range. Written with :func:`write_bars`, the
    timeframe is a folder and the dates are pushed to the Parquet footers."""
    df = spark.read.parquet(path)
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe)
    if start is not None:
        df = df.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return df.select(*columns) if columns else df


def rename_by_alias(df: DataFrame, aliases: dict[str, Sequence[str]] = BAR_ALIASES, extra: Sequence[str] = ()) -> DataFrame:
    """Columns under their common names; spelling ignores case, blanks, underscores and a BOM."""
    lookup = {header_key(c): c for c in df.columns}
    out = []
    for name, options in aliases.items():
        hit = next((lookup[header_key(o)] for o in options if header_key(o) in lookup), None)
        out.append((F.col(f"`{hit}`") if hit is not None else F.lit(None).cast("string")).alias(name))
    return df.select(*[F.col(f"`{c}`") for c in extra], *out)


def read_bar_csv(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]] = BAR_ALIASES, encoding: str = "UTF-8", extra: Sequence[str] = ()) -> DataFrame:
    """All-text bar rows from CSV files; use ``encoding="GB18030"`` for legacy exports."""
    return rename_by_alias(spark.read.csv(path, header=True, encoding=encoding), aliases, extra)


def parse_bars(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows and rejects. Every failed field of a row is named in ``errors``; nothing raises."""
    typed = df.withColumns(
        {
            "_d": clean_date("trade_date"),
            **{f"_{c}": clean_decimal(c) for c in ("open", "high", "low", "close", "adjusted_close", "volume", "amount")},
        }
    )
    given = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    checks = [F.when(F.col("_d").isNull(), F.lit("trade_date"))]
    checks += [F.when(F.col(f"_{c}").isNull(), F.lit(c)) for c in ("open", "high", "low", "close")]
    checks += [F.when(given(c) & F.col(f"_{c}").isNull(), F.lit(c)) for c in ("adjusted_close", "volume", "amount")]
    typed = typed.withColumn("errors", F.array_compact(F.array(*checks)))
    keep = [c for c in df.columns if c not in BAR_ALIASES]
    names = ("open", "high", "low", "close", "adjusted_close", "volume", "amount")
    valid = typed.where(F.size("errors") == 0).select(*keep, F.col("_d").alias("trade_date"), *[F.col(f"_{c}").alias(c) for c in names])
    return valid, typed.where(F.size("errors") > 0).select(*df.columns, "errors")


def preview(df: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(first n rows, counts of all rows, valid and invalid ones)."""
    valid, rejects = parse_bars(df)
    flags = valid.select(F.lit(1).alias("ok")).unionByName(rejects.select(F.lit(0).alias("ok")))
    counts = flags.agg(F.count("*").alias("total"), F.count_if(F.col("ok") == 1).alias("valid"), F.count_if(F.col("ok") == 0).alias("invalid"))
    return df.limit(n), counts


def _strip(html):
    text = F.regexp_replace(html, r"(?is)<[^>]*>", "")
    text = F.regexp_replace(F.regexp_replace(text, "&nbsp;", " "), "&amp;", "&")
    return F.trim(text)


def extract_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Cells of every HTML table: (page, table, row, column, header, value); the first row names the columns."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)).alias("table_no", "_t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_no", "_r"), "_t")
    cells = F.regexp_extract_all("_r", F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1)
    first = F.regexp_extract("_t", r"(?is)<tr[^>]*>(.*?)</tr>", 1)
    header = F.regexp_extract_all(first, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1)
    long = rows.where("row_no > 0").select(key, "table_no", "row_no", header.alias("_h"), F.posexplode(cells).alias("col_no", "_v"))
    return long.select(key, "table_no", "row_no", "col_no", _strip(F.try_element_at("_h", F.col("col_no") + 1)).alias("header"), _strip("_v").alias("value"))


def explode_chart_json(df: DataFrame, keys: Sequence[str], payload: str = "payload", zone: str = "UTC") -> DataFrame:
    """Rows of a chart payload with parallel arrays ``timestamp`` (epoch seconds) and ``close``; NULL closes are dropped."""
    parsed = F.from_json(payload, "timestamp array<bigint>, close array<double>")
    rows = df.select(*keys, F.inline(F.arrays_zip(parsed["timestamp"].alias("timestamp"), parsed["close"].alias("close"))))
    ts = F.from_utc_timestamp(F.timestamp_seconds("timestamp"), zone)
    return rows.where("timestamp is not null and close is not null").select(*keys, ts.alias("ts"), "close")


LEDGER_SCHEMA = "account_id bigint, symbol string, trade_date date, side string, quantity decimal(38,8), price decimal(38,8), fee decimal(38,8)"


def read_ledger_csv(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)
