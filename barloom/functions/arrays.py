"""Column functions on paths: arrays of cumulative returns, probabilities, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from barloom.functions.scalar import as_col


def total(a) -> Column:
    return F.aggregate(as_col(a), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    n = F.size(as_col(a))
    return total(a) / F.when(n > 0, n)


def std_pop(a) -> Column:
    a = as_col(a)
    m = mean(a)
    n = F.size(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.when(n > 0, n))


def argmax(a) -> Column:
    """1-based first position of the largest element."""
    return F.array_position(as_col(a), F.array_max(as_col(a)))


def argmin(a) -> Column:
    return F.array_position(as_col(a), F.array_min(as_col(a)))


def increments(path) -> Column:
    """Differences of a cumulative path, the first one against 0."""
    p = as_col(path)
    return F.zip_with(p, F.concat(F.array(F.lit(0.0)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))), lambda x, y: x - y)


def cumulate(steps) -> Column:
    """Running sums of an array (its length is a horizon, so the fold stays small)."""
    empty = F.array().cast("array<double>")
    return F.aggregate(
        as_col(steps), empty, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))))
    )


def path_max_drawdown(path) -> Column:
    """Largest peak-to-trough loss of wealth 1 + r as a positive share; the start counts as a peak."""
    zero = F.struct(F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, r):
        peak = F.greatest(acc["peak"], 1.0 + r)
        return F.struct(peak.alias("peak"), F.greatest(acc["worst"], (peak - (1.0 + r)) / peak).alias("worst"))

    return F.aggregate(as_col(path), zero, step, lambda acc: acc["worst"])


def path_volatility(path, periods: int = 52) -> Column:
    """Annualised population deviation of the log returns along a cumulative path."""
    logs = F.transform(as_col(path), lambda r: F.log1p(r))
    return std_pop(increments(logs)) * float(periods) ** 0.5


def path_shape(path, threshold: Column | None = None) -> Column:
    """RANGE, V_SHAPE, INVERTED_V or a trend.

    Without a threshold the scale is the path's own deviation (at least 0.01);
    with one, reversals must exceed twice the threshold.
    """
    p = as_col(path)
    last, lo, hi = F.element_at(p, -1), F.array_min(p), F.array_max(p)
    half = F.floor(F.size(p) / 2)
    if threshold is None:
        flat = F.greatest(std_pop(p), F.lit(0.01))
        move = flat
    else:
        flat, move = threshold, 2.0 * threshold
    return (
        F.when((F.abs(last) <= flat) & (hi - lo <= 3.0 * flat), "RANGE")
        .when((argmin(p) <= half) & (last - lo > move), "V_SHAPE")
        .when((argmax(p) <= half) & (hi - last > move), "INVERTED_V")
        .when(last > 0, "TREND_UP")
        .otherwise("TREND_DOWN")
    )


# ---- probabilities ------------------------------------------------------------------

def softmax(logits) -> Column:
    a = as_col(logits)
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def logit(p, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), as_col(p)))
    return F.log(q / (1.0 - q))


def temperature_scale(probabilities, temperature, eps: float = 1e-9) -> Column:
    """Softmax of log probabilities over the temperature."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    return softmax(F.transform(as_col(probabilities), lambda p: F.log(F.greatest(p, F.lit(eps))) / t))


# ---- apportionment -------------------------------------------------------------------

def largest_remainder(amount, weights: Sequence[float], unit: int = 1) -> Column:
    """Integer shares of ``amount`` units by weight; leftover units go to the largest remainders, first position on ties."""
    total_w = float(sum(weights))
    n = len(weights)
    units = F.floor(as_col(amount) / unit)
    raw = F.transform(F.array(*[F.lit(w / total_w) for w in weights]), lambda w: w * units)
    base = F.transform(raw, lambda x: F.floor(x))
    left = units - F.aggregate(base, F.lit(0).cast("bigint"), lambda s, x: s + x)
    # Rank of each remainder: how many are larger, or equal and earlier.
    rem = F.transform(raw, lambda x, i: F.struct((F.round(F.floor(x) - x, 12)).alias("r"), i.alias("i")))
    ranked = F.transform(F.array_sort(rem), lambda s: s["i"])
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: (F.element_at(base, i + 1) + F.when(F.array_position(ranked, i) <= left, 1).otherwise(0)) * unit,
    )


def split_batches(amount, first_limit, limit, grid: int = 5, slots: int = 4) -> Column:
    """Split an amount on the grid into at most ``slots`` batches: the first and later
    limits bind, at least one grid step is kept back for every later slot, and the
    last batch takes what remains."""
    first_limit, limit = (x if isinstance(x, Column) else F.lit(x) for x in (first_limit, limit))
    empty = F.struct(F.array().cast("array<bigint>").alias("out"), as_col(amount).cast("bigint").alias("left"))

    def step(acc, k):
        left = acc["left"]
        cap = F.when(k == 0, first_limit).otherwise(limit)
        reserve = F.least(left, (slots - 1 - k) * grid)
        free = F.when(left > reserve, left - reserve).otherwise(left)
        value = F.greatest(F.lit(grid), F.floor(F.least(cap, free) / grid) * grid)
        value = F.when(k == slots - 1, F.greatest(value, left)).otherwise(value).cast("bigint")
        return F.when(left > 0, F.struct(F.concat(acc["out"], F.array(value)).alias("out"), (left - value).alias("left"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), empty, step, lambda acc: acc["out"])


def split_greedy(amount, weights: Sequence[float] = (4, 3, 2, 1), grid: int = 5, per_batch: int = 20) -> Column:
    """Front-loaded split: one batch per ``per_batch`` points, a grid step in each, and the
    other steps one at a time to the batch with the largest weight / (steps + 1)."""
    n = len(weights)
    amount = as_col(amount)
    count = F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(amount / float(per_batch)))).cast("int")
    table = F.array(*[F.lit(float(w)) for w in weights])
    start = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < count, 1).otherwise(0).cast("bigint"))

    def deal(acc, _):
        score = F.transform(acc, lambda k, i: F.when(i < count, F.element_at(table, i + 1) / (k + 1)).otherwise(-1.0))
        best = F.array_position(score, F.array_max(score))
        return F.transform(acc, lambda k, i: k + F.when(i + 1 == best, 1).otherwise(0).cast("bigint"))

    rest = (F.floor(amount / grid) - count).cast("int")
    dealt = F.when(rest > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(rest, F.lit(1))), start, deal)).otherwise(start)
    out = F.transform(F.filter(dealt, lambda k: k > 0), lambda k: k * grid)
    return F.when(amount > 0, out).otherwise(F.array().cast("array<bigint>"))
