"""Earlier states and windows most like each one of a series, exactly, for every anchor.

A bar series is bounded by its calendar, so a task may hold the history of one key; the anchors of a key are dealt out in
blocks, so a key is the work of many tasks. Nothing forms pairs of rows in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Digits to which distances are rounded, so that ties are ties in any engine.
DIGITS = 12


def _blocks(history: DataFrame, targets: DataFrame, by: Sequence[str], ordinal: str, block: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """History rows dealt to every later block of targets (``reach`` rows earlier at least), and the targets with their block."""
    own = targets.withColumn("_block", F.floor(F.col(ordinal) / block).cast("int"))
    last = own.groupBy(*by).agg(F.max("_block").alias("_last"))
    first = F.greatest(F.lit(0), F.floor((F.col(ordinal) + reach) / block)).cast("int")
    dealt = history.join(last, list(by)).withColumn("_first", first).where("_first <= _last").withColumn("_block", F.explode(F.sequence("_first", "_last")))
    return dealt.drop("_first", "_last"), own.toDF(*own.columns)  # names of its own, as both sides may come from one frame


def pivots(rows: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: the first one, then again and again the one farthest from those chosen."""
    at, far = [0], np.full(len(rows), np.inf)
    for _ in range(min(count, len(rows)) - 1):
        far = np.minimum(far, np.abs(rows - rows[at[-1]]) @ weights)
        at.append(int(np.argmax(far)))
    return rows[at]


def nearest_rows(target: np.ndarray, rows: np.ndarray, to_pivots: np.ndarray, from_pivots: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of smallest weighted L1 distance, ties to the earlier row; exact.

    By the triangle inequality, |d(target, p) - d(row, p)| never exceeds d(target, row) for any pivot p. The rows with the
    k smallest of these bounds give a distance that the k-th best cannot exceed; only rows whose bound reaches no
    farther are measured.
    """
    def measured(at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at))
        for j, w in enumerate(weights):
            total = total + w * np.abs(rows[at, j] - target[j])
        return np.round(total, DIGITS)

    bound = np.abs(from_pivots - to_pivots).max(axis=1) if len(rows) else np.zeros(0)
    at = np.arange(len(rows))
    if len(rows) > k:
        some = np.argpartition(bound, k - 1)[:k]
        at = np.flatnonzero(bound <= measured(some).max() + 1e-9)
    found = measured(at)
    order = np.lexsort((at, found))[:k]
    return at[order], found[order]


def nearest_history(history: DataFrame, targets: DataFrame, weights: dict[str, float], k: int, horizon: int, by: Sequence[str] = ("symbol",), ordinal: str = "ordinal", block: int = 64, pivot_count: int = 6) -> DataFrame:
    """(by, target, ordinal, distance, rank): for every target row the k nearest history rows at least ``horizon`` earlier.

    Rows with a missing feature are neither found nor answered.
    """
    names, keys = list(weights), list(by)
    w = np.array([weights[n] for n in names], float)
    known = lambda df: df.select(*keys, F.col(ordinal).cast("long").alias(ordinal), *[F.col(n).cast("double").alias(n) for n in names]).where(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    dealt, own = _blocks(known(history), known(targets), keys, ordinal, block, horizon)

    def search(key, past: pa.Table, anchors: pa.Table) -> pa.Table:
        order = np.argsort(past.column(ordinal).to_numpy(), kind="stable")
        at = past.column(ordinal).to_numpy()[order]
        rows = np.column_stack([past.column(n).to_numpy() for n in names])[order]
        chosen = pivots(rows, w, pivot_count) if len(rows) else rows
        distance = lambda x: np.abs(x[:, None, :] - chosen[None, :, :]) @ w
        from_pivots = distance(rows)
        out = []
        feature = np.column_stack([anchors.column(n).to_numpy() for n in names]) if anchors.num_rows else np.zeros((0, len(names)))
        to_pivots = distance(feature)
        for i, target in enumerate(anchors.column(ordinal).to_pylist()):
            until = int(np.searchsorted(at, target - horizon, "right"))
            hit, d = nearest_rows(feature[i], rows[:until], to_pivots[i], from_pivots[:until], w, k)
            out += [(target, int(at[h]), float(x), r + 1) for r, (h, x) in enumerate(zip(hit.tolist(), d.tolist(), strict=True))]
        columns = list(zip(*out, strict=True)) or [()] * 4
        values = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)]
        return pa.table([*[pa.array([v.as_py()] * len(out), v.type) for v in key[: len(keys)]], *values], names=[*keys, "target", ordinal, "distance", "rank"])

    kinds = ", ".join(f"{c} {history.schema[c].dataType.simpleString()}" for c in keys)
    grouped = dealt.groupBy(*keys, "_block").cogroup(own.groupBy(*keys, "_block"))
    return grouped.applyInArrow(search, f"{kinds}, target long, {ordinal} long, distance double, rank int")


def analogue_forecast(history: DataFrame, targets: DataFrame, weights: dict[str, float], k: int, by: Sequence[str] = ("symbol",), horizon: int = 13, threshold: float = 0.05, minimum: int = 1) -> DataFrame:
    """(by, target, step): spread, mean and class shares of the paths that followed the k nearest matured rows.

    history: by, ordinal, features, path. targets: by, ordinal, features. Targets with fewer than ``minimum`` analogues
    are not answered.
    """
    keys = list(by)
    near = nearest_history(history.where(F.col("path").isNotNull()), targets, weights, k, horizon, by)
    paths = near.join(history.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), "path"), [*keys, "ordinal"])
    long = paths.select(*keys, "target", F.posexplode("path").alias("_p", "ret"))
    g = long.groupBy(*keys, "target", (F.col("_p") + 1).alias("step")).agg(
        F.expr("percentile(ret, array(0.1, 0.5, 0.9))").alias("_q"), F.avg("ret").alias("expected"), F.avg((F.col("ret") > threshold).cast("double")).alias("p_up"),
        F.avg((F.col("ret") < -threshold).cast("double")).alias("p_down"), F.count("*").alias("analogues"),
    )
    g = g.where(F.col("analogues") >= minimum)
    return g.select(*keys, "target", "step", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "expected", "p_up", "p_down", "analogues")


def sliding_products(series: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Dot product of each window with every stretch of the series of its length, by one transform of the series."""
    n, width = len(series), windows.shape[1]
    size = 1 << (n + width - 1).bit_length()
    both = np.fft.rfft(series, size)[None, :] * np.fft.rfft(windows[:, ::-1], size, axis=1)
    return np.fft.irfft(both, size, axis=1)[:, width - 1 : n]


def similar_windows(df: DataFrame, window: int, horizon: int, k: int, by: Sequence[str] = ("symbol",), t: str = "trade_date", c: str = "close", block: int = 256) -> DataFrame:
    """(by, end_date, target, ordinal, match_date, distance, rank): for every window the past ones most like it in shape.

    Shapes are prices over their first value; the distance is the root mean square of their difference. Candidates end
    ``window + horizon`` rows before the target does, so they have a known outcome before its first row. All distances of a block of targets
    come from sliding products; those that may be among the k best within rounding are measured again term by term.
    """
    keys = list(by)
    from barloom.operators.panel import ordered

    series = df.select(*keys, F.col(t).alias("_t"), F.col(c).cast("double").alias("_c"), (F.row_number().over(ordered(by, t)) - 1).cast("long").alias("ordinal"))
    dealt, own = _blocks(series, series.select(*keys, "ordinal"), keys, "ordinal", block, 0)
    lag = window + horizon

    def search(key, past: pa.Table, anchors: pa.Table) -> pa.Table:
        past = past.sort_by("ordinal")
        x, dates = past.column("_c").to_numpy(), past.column("_t").combine_chunks()
        ends = np.sort(anchors.column("ordinal").to_numpy())
        ends = ends[ends >= window - 1 + lag]
        out: list[tuple[int, int, float, int]] = []
        if len(ends):
            stretch = np.lib.stride_tricks.sliding_window_view(x, window)
            usable = len(x) - window + 1 - lag
            shape = stretch / stretch[:, :1]
            square = (shape**2).sum(axis=1)
            starts = ends - window + 1
            products = sliding_products(x[: usable + window - 1], shape[starts]) / x[None, :usable]
            rough = square[starts][:, None] + square[None, :usable] - 2 * products
            slack = 1e-9 * (square[starts] + square[:usable].max())
            for i, s in enumerate(starts.tolist()):
                d = rough[i, : s - lag + 1]
                at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + slack[i]) if len(d) > k else np.arange(len(d))
                exact = np.round(np.sqrt(((shape[at] - shape[s]) ** 2).sum(axis=1) / window), DIGITS)
                for r, j in enumerate(np.lexsort((at, exact))[:k].tolist()):
                    out.append((s + window - 1, int(at[j]) + window - 1, float(exact[j]), r + 1))
        columns = list(zip(*out, strict=True)) or [()] * 4
        target, match, distance, rank = (pa.array(v, kind) for v, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True))
        return pa.table([*[pa.array([v.as_py()] * len(out), v.type) for v in key[: len(keys)]], dates.take(target), target, match, dates.take(match), distance, rank], names=[*keys, "end_date", "target", "ordinal", "match_date", "distance", "rank"])

    kind = df.schema[t].dataType.simpleString()
    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in keys)
    grouped = dealt.groupBy(*keys, "_block").cogroup(own.groupBy(*keys, "_block"))
    return grouped.applyInArrow(search, f"{kinds}, end_date {kind}, target long, ordinal long, match_date {kind}, distance double, rank int")


def similarity_forecast(df: DataFrame, matches: DataFrame, steps: Sequence[int], by: Sequence[str] = ("symbol",), t: str = "trade_date", c: str = "close") -> DataFrame:
    """(by, end_date, step): mean price after the matches, as a multiple of the target's last price, with a band of one population deviation."""
    from barloom.operators.panel import ordered

    keys = list(by)
    series = df.select(*keys, F.col(c).cast("double").alias("_c"), (F.row_number().over(ordered(by, t)) - 1).cast("long").alias("_o"))
    base = series.select(*keys, F.col("_o").alias("target"), F.col("_c").alias("base"))
    start = series.select(*keys, F.col("_o").alias("ordinal"), F.col("_c").alias("_from"))
    ahead = series.select(*keys, F.col("_o").alias("_at"), F.col("_c").alias("_to"))
    rows = matches.join(base, [*keys, "target"]).join(start, [*keys, "ordinal"]).withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    rows = rows.withColumn("_at", F.col("ordinal") + F.col("step")).join(ahead, [*keys, "_at"])
    ratio = F.col("_to") / F.col("_from")
    g = rows.groupBy(*keys, "end_date", "step").agg(F.max("base").alias("base"), F.avg(ratio).alias("_m"), F.stddev_pop(ratio).alias("_s"), F.count("*").alias("matches"))
    return g.select(
        *keys, "end_date", "step", (F.col("base") * F.col("_m")).alias("predicted"),
        (F.col("base") * F.greatest(F.col("_m") - F.col("_s"), F.lit(0.0))).alias("lower"), (F.col("base") * (F.col("_m") + F.col("_s"))).alias("upper"), "matches",
    )
