"""Row-level price operators: sanity checks, adjustment, returns, candles, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.scalar import as_col, change, safe_div
from barloom.operators.panel import BY, T, ordered

OHLC = ("open", "high", "low", "close")


def _positive_finite(c: str) -> Column:
    col = F.col(c)
    return F.coalesce(col.isNotNull() & ~F.isnan(col) & (col > 0) & (col < float("inf")), F.lit(False))


def ohlc_valid(tolerant: bool = False, relative: float = 1e-12) -> Column:
    """Positive finite prices with high and low containing open and close.

    ``tolerant`` forgives machine rounding: 1e-9 or ``relative`` of the price scale, whichever is more.
    """
    positive = _positive_finite("open") & _positive_finite("high") & _positive_finite("low") & _positive_finite("close")
    slack = F.greatest(F.lit(1e-9), F.greatest(F.lit(1.0), *[F.col(c) for c in OHLC]) * relative) if tolerant else F.lit(0.0)
    upper, lower = F.greatest("open", "close"), F.least("open", "close")
    contains = (
        (F.col("high") + slack >= upper) & (F.col("low") - slack <= lower) & (F.col("high") + slack >= F.col("low"))
    )
    return positive & F.coalesce(contains, F.lit(False))


def price_basis(kind: str = "adjusted") -> Column:
    """Adjusted close where present, else the raw one; or always the raw one."""
    return F.coalesce("adjusted_close", "close") if kind == "adjusted" else F.col("close")


def adjust_ohlc(df: DataFrame) -> DataFrame:
    """Scale O/H/L/C by adjusted/raw close so that candle shapes do not change; keep ``raw_close``."""
    factor = safe_div(price_basis(), "close")
    basis = price_basis()
    return df.select(
        *[c for c in df.columns if c not in OHLC],
        F.coalesce(F.col("open") * factor, basis).alias("open"),
        F.coalesce(F.col("high") * factor, basis).alias("high"),
        F.coalesce(F.col("low") * factor, basis).alias("low"),
        basis.alias("close"),
        F.col("close").alias("raw_close"),
    )


def ret(c: str, n: int = 1, by: Sequence[str] = BY, t: str = T) -> Column:
    return change(F.col(c), F.lag(c, n).over(ordered(by, t)))


def logret(c: str, n: int = 1, by: Sequence[str] = BY, t: str = T) -> Column:
    ratio = safe_div(F.col(c), F.lag(c, n).over(ordered(by, t)))
    return F.when(ratio > 0, F.log(ratio))


def candle(df: DataFrame, by: Sequence[str] = BY, t: str = T) -> DataFrame:
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    return df.withColumns(
        {
            "body_ratio": (F.col("close") - F.col("open")) / span,
            "upper_shadow_ratio": (F.col("high") - F.greatest("open", "close")) / span,
            "lower_shadow_ratio": (F.least("open", "close") - F.col("low")) / span,
            "close_location": (F.col("close") - F.col("low")) / span,
            "gap": change(F.col("open"), F.lag("close").over(ordered(by, t))),
        }
    )


def period_return_pct(df: DataFrame, c: str = "close", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Percent change to the strictly earlier previous row; NULL on a non-positive base."""
    w = ordered(by, t)
    base, day = F.lag(c).over(w), F.lag(t).over(w)
    return df.withColumn("period_return_pct", F.when((base > 0) & (day < F.col(t)), (F.col(c) / base - 1) * 100))


def deny_sources(df: DataFrame, markers: Sequence[str], source: str = "source") -> DataFrame:
    """Drop rows whose source carries one of the markers, in any case."""
    text = F.upper(F.coalesce(F.col(source), F.lit("")))
    keep = F.lit(True)
    for marker in markers:
        keep = keep & ~text.contains(marker.upper())
    return df.where(keep)


def future_rows(df: DataFrame, cutoff, t: str = T) -> DataFrame:
    """Issue rows for anything dated after the cutoff."""
    return df.where(F.col(t) > F.lit(cutoff).cast("date")).withColumn("code", F.lit("ROW_AFTER_CUTOFF"))


def assert_no_future(df: DataFrame, cutoff, t: str = T) -> DataFrame:
    """Same rows; the job fails when one lies after the cutoff."""
    late = F.col(t) > F.lit(cutoff).cast("date")
    guard = F.when(late, F.raise_error(F.concat(F.lit("row after cutoff: "), F.col(t).cast("string"))).cast("date"))
    return df.withColumn(t, F.coalesce(guard, F.col(t)))


def sign_agree(a, b) -> Column:
    """True when both have the same non-zero sign."""
    a, b = F.signum(F.coalesce(as_col(a), F.lit(0.0))), F.signum(F.coalesce(as_col(b), F.lit(0.0)))
    return (a == b) & (b != 0)


def missing_masks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"missing_{c}": F.col(c).isNull().cast("int") for c in cols})


def anonymise(df: DataFrame, c: str = "close", by: Sequence[str] = BY, t: str = T) -> DataFrame:
    """Relative index (0 newest, -1 before it ...) and price over the newest price; no dates, no levels."""
    newest = df.groupBy(*by).agg(F.max_by(c, t).alias("_anchor"), F.count("*").alias("_n"))
    return (
        df.withColumn("_rn", F.row_number().over(ordered(by, t)))
        .join(newest, list(by))
        .select(*by, (F.col("_rn") - F.col("_n")).alias("t_index"), safe_div(c, "_anchor").alias("relative_price"))
    )


def flatten_sequence(df: DataFrame, sequence: str, fields: Sequence[str], length: int) -> DataFrame:
    """Spread an array<struct> of fixed length into seq_<field>_<position> columns, newest position 0."""
    item = lambda i, f: F.try_element_at(F.col(sequence), F.lit(-(i + 1)))[f]
    wide = {f"seq_{f}_{i:03d}": item(i, f) for i in range(length) for f in fields}
    return df.withColumns(wide).drop(sequence)


def current_universe(df: DataFrame, slots: DataFrame, on: str = "symbol") -> DataFrame:
    """Rows whose key is an active member of the catalog."""
    return df.join(slots.where("active").select(on).distinct(), on, "left_semi")


def align_axis(dates: DataFrame, values: DataFrame, on: Sequence[str]) -> DataFrame:
    """Values on a given date axis; gaps stay NULL."""
    return dates.join(values, list(on), "left")


def session_axis(keys: DataFrame, sessions: DataFrame, t: str = "trade_date") -> DataFrame:
    """Every session for every key: the months of the calendar are listed per key and met with their sessions by month."""
    months = sessions.select(t, F.trunc(t, "month").alias("_month"))
    ends = sessions.select(F.trunc(F.min(t), "month").alias("a"), F.trunc(F.max(t), "month").alias("b"))
    listed = keys.withColumns({"_a": ends.select("a").scalar(), "_b": ends.select("b").scalar()}).where("_a is not null")
    listed = listed.select(*keys.columns, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("_month"))
    return listed.join(months, "_month").drop("_month")
