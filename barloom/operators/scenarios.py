"""Scenario fans, resampling, analogues: random choices are hashes of their coordinates, so reruns and lost tasks repeat them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import arrays as A
from barloom.functions.scalar import as_col
from barloom.operators.panel import ordered, top_k

PATH = ("symbol", "anchor")


def draw(n, *parts) -> Column:
    """Integer in [0, n) from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


# ---- fan ----------------------------------------------------------------------------

def number_pool(pool: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Index 0.. and size of each key's pool (records are anchors: calendar-bounded)."""
    w = Window.partitionBy(*by)
    return pool.withColumns({"pool_idx": F.row_number().over(w.orderBy(*order)) - 1, "pool_size": F.count("*").over(w)})


def pool_weights(pool: DataFrame, by: Sequence[str], order: str, half_life: float | None = 50.0) -> DataFrame:
    """Weight of each record by its recency rank: uniform, or halved every ``half_life`` ranks; with its cumulative share."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    raw = F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), F.col("rank") / float(half_life))
    p = pool.withColumn("rank", F.row_number().over(w) - 1).withColumn("_raw", raw)
    p = p.withColumn("weight", F.col("_raw") / F.sum("_raw").over(Window.partitionBy(*by)))
    return p.withColumn("cum_weight", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def scenario_fan(forecasts: DataFrame, pool: DataFrame, n: int, seed: int, by: Sequence[str] = ("symbol",), anchor: str = "anchor") -> DataFrame:
    """n scenarios per forecast: log gross of the path plus a drawn standardised residual path times sigma.

    forecasts: by, anchor, path, sigma. pool: by, pool_idx, pool_size, residual.
    Every scenario meets its residual by an equi-join on (key, index).
    """
    sizes = pool.groupBy(*by).agg(F.max("pool_size").alias("_n"))
    d = forecasts.join(sizes, list(by)).withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = d.withColumn("pool_idx", draw(F.col("_n"), str(seed), *[F.col(b) for b in by], F.col(anchor).cast("string"), F.col("scenario").cast("string")))
    j = d.join(pool.select(*by, "pool_idx", "residual"), [*by, "pool_idx"])
    path = F.zip_with("path", "residual", lambda p, r: F.expm1(F.log1p(p) + r * F.col("sigma")))
    return j.select(*by, anchor, "scenario", "pool_idx", path.alias("scenario_path"))


def stratified_counts(n: int, weights: Sequence[float]) -> list[int]:
    """Draw counts per stratum by largest remainder; a handful of numbers fixed before the job."""
    total = sum(weights)
    raw = [w / total * n for w in weights]
    base = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: (base[i] - raw[i], i))[: n - sum(base)]:
        base[i] += 1
    return base


def stratified_fan(forecasts: DataFrame, pool: DataFrame, n: int, seed: int, weights: Sequence[float], by: Sequence[str] = ("symbol",), anchor: str = "anchor") -> DataFrame:
    """As :func:`scenario_fan`, with exact shares of the scenarios drawn from each ``stratum`` of the pool."""
    counts = stratified_counts(n, weights)
    keys = [*by, "stratum"]
    bounds = [sum(counts[: i + 1]) for i in range(len(counts))]
    s = F.lit(len(counts) - 1)
    for i in reversed(range(len(counts) - 1)):
        s = F.when(F.col("scenario") < bounds[i], i).otherwise(s)
    sizes = pool.groupBy(*keys).agg(F.max("pool_size").alias("_n"))
    d = forecasts.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("stratum", s).join(sizes, keys)
    d = d.withColumn("pool_idx", draw(F.col("_n"), str(seed), *[F.col(b) for b in by], F.col(anchor).cast("string"), F.col("scenario").cast("string")))
    j = d.join(pool.select(*keys, "pool_idx", "residual"), [*keys, "pool_idx"])
    return j.select(*by, anchor, "scenario", "stratum", F.zip_with("path", "residual", lambda p, r: F.expm1(F.log1p(p) + r * F.col("sigma"))).alias("scenario_path"))


def steps_of(fan: DataFrame, ids: Sequence[str], path: str = "scenario_path") -> DataFrame:
    return fan.select(*ids, F.posexplode(path).alias("_p", "ret")).withColumn("step", F.col("_p") + 1).drop("_p")


def fan_quantiles(fan: DataFrame, by: Sequence[str] = PATH) -> DataFrame:
    long = steps_of(fan, [*by, "scenario"])
    g = long.groupBy(*by, "step").agg(F.expr("percentile(ret, array(0.1, 0.5, 0.9))").alias("_q"), F.stddev_pop("ret").alias("deviation"))
    return g.select(*by, "step", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "deviation")


def representative(fan: DataFrame, quantiles: DataFrame, by: Sequence[str] = PATH) -> DataFrame:
    """Scenario closest to the median path, in deviations."""
    long = steps_of(fan, [*by, "scenario"]).join(quantiles, [*by, "step"])
    z = F.pow((F.col("ret") - F.col("p50")) / F.greatest("deviation", F.lit(1e-9)), 2)
    d = long.groupBy(*by, "scenario").agg(F.sum(z).alias("distance"))
    return d.groupBy(*by).agg(F.min_by("scenario", F.struct(F.round("distance", 9), F.col("scenario"))).alias("scenario"), F.min("distance").alias("distance"))


def horizon_probs(fan: DataFrame, horizons: Sequence[int], threshold: float, by: Sequence[str] = PATH) -> DataFrame:
    long = steps_of(fan, [*by, "scenario"]).where(F.col("step").isin(*horizons))
    r = F.col("ret")
    return long.groupBy(*by, F.col("step").alias("h")).agg(
        F.avg((r > threshold).cast("double")).alias("p_up"), F.avg(((r <= threshold) & (r >= -threshold)).cast("double")).alias("p_side"), F.avg((r < -threshold).cast("double")).alias("p_down")
    )


def normal_probs(expected, sigma, threshold) -> dict[str, Column]:
    """Class probabilities of a normal outcome around an expected return."""
    from barloom.functions.scalar import normal_cdf

    e, t = as_col(expected), as_col(threshold) if not isinstance(threshold, float) else F.lit(threshold)
    s = F.greatest(as_col(sigma), F.lit(0.005))
    up = 1 - normal_cdf((t - e) / s)
    down = F.least(normal_cdf((-t - e) / s), 1 - up)
    return {"p_up": up, "p_side": F.greatest(F.lit(0.0), 1 - up - down), "p_down": down}


def path_distribution(fan: DataFrame, threshold: float, by: Sequence[str] = PATH, mass: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """(share of each path shape, window of turn weeks that holds ``mass`` of the scenarios)."""
    shapes = fan.groupBy(*by, A.path_shape("scenario_path", F.lit(threshold)).alias("shape")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by)
    shapes = shapes.withColumn("share", F.col("n") / F.sum("n").over(total))
    weeks = fan.groupBy(*by, A.argmin("scenario_path").alias("week")).agg(F.count("*").alias("n"))
    order = total.orderBy(F.col("n").desc(), F.col("week").desc())
    weeks = weeks.withColumns({"_before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("n").over(total)})
    kept = weeks.where(F.col("_before") < F.ceil(F.col("_all") * mass))
    window = kept.groupBy(*by).agg(F.min("week").alias("start_week"), F.max("week").alias("end_week"), (F.sum("n") / F.max("_all")).alias("coverage"))
    return shapes, window


def scenario_bars(fan: DataFrame, base: DataFrame, history: DataFrame, seed: int, by: Sequence[str] = ("symbol",), anchor: str = "anchor") -> DataFrame:
    """Open, high, low, close and volume of every scenario step, with a legality flag.

    base: by, anchor, base_close, base_volume. history: by, gap, upper, lower,
    dvol as arrays of empirical bar shapes (one value per past bar). The shapes of a
    step are drawn independently of each other.
    """
    long = steps_of(fan, [*by, anchor, "scenario"]).join(base, [*by, anchor]).join(history, list(by))
    key = [F.col(b) for b in by] + [F.col(anchor).cast("string"), F.col("scenario").cast("string"), F.col("step").cast("string")]
    pick = lambda c: F.element_at(c, (draw(F.size(c), str(seed), c, *key) + 1).cast("int"))
    long = long.withColumns({f"_{c}": pick(c) for c in ("gap", "upper", "lower", "dvol")}).drop("gap", "upper", "lower", "dvol")
    long = long.withColumn("close", F.col("base_close") * (1 + F.col("ret")))
    w = Window.partitionBy(*by, anchor, "scenario").orderBy("step")
    prev = F.coalesce(F.lag("close").over(w), F.col("base_close"))
    long = long.withColumn("open", prev * F.exp("_gap"))
    out = long.withColumns(
        {
            "high": F.greatest("open", "close") * (1 + F.col("_upper")),
            "low": F.least("open", "close") * F.greatest(1 - F.col("_lower"), F.lit(1e-4)),
            "volume": F.col("base_volume") * F.exp(F.sum(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("_dvol")))).over(w.rowsBetween(Window.unboundedPreceding, 0))),
        }
    )
    legal = (F.col("low") > 0) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return out.withColumn("legal", legal).select(*by, anchor, "scenario", "step", "open", "high", "low", "close", "volume", "legal")


def bar_shapes(bars: DataFrame, by: Sequence[str] = ("symbol",), t: str = "trade_date") -> DataFrame:
    """Empirical gap, wick and volume-change arrays of each series (one value per bar: calendar-bounded)."""
    prev = F.lag("volume").over(ordered(by, t))
    b = bars.withColumns(
        {
            "_gap": F.log(F.greatest("open", F.lit(1e-9)) / F.greatest("close", F.lit(1e-9))),
            "_upper": F.greatest(F.col("high") - F.greatest("open", "close"), F.lit(0.0)) / F.greatest("close", F.lit(1e-9)),
            "_lower": F.greatest(F.least("open", "close") - F.col("low"), F.lit(0.0)) / F.greatest("close", F.lit(1e-9)),
            "_dvol": F.coalesce(F.log(F.greatest("volume", F.lit(1.0)) / F.greatest(prev, F.lit(1.0))), F.lit(0.0)),
        }
    )
    rows = F.array_sort(F.collect_list(F.struct(t, "_gap", "_upper", "_lower", "_dvol")))
    g = b.groupBy(*by).agg(rows.alias("_r"))
    get = lambda c: F.transform("_r", lambda r: r[f"_{c}"]).alias(c)
    return g.select(*by, *[get(c) for c in ("gap", "upper", "lower", "dvol")])


# ---- bootstrap ---------------------------------------------------------------------------

def block_bootstrap(diffs: DataFrame, block: int, draws: int, seed: int, by: Sequence[str], fold: str = "fold", order: str = "anchor", value: str = "diff") -> DataFrame:
    """5 % and 95 % quantile of the mean of paired differences under a block bootstrap.

    Blocks start inside one fold and never cross it; the last block of a draw is cut
    to the fold's length. Block sums are window sums, so a draw only adds one number
    per block; (draw, slot) pairs meet them by an equi-join.
    """
    keys = [*by, fold]
    w = Window.partitionBy(*keys).orderBy(order)
    d = diffs.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    d = d.withColumn("_rem", F.col("_n") - F.floor((F.col("_n") - 1) / block) * block)
    pre = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_p", F.coalesce(pre, F.lit(0.0))).withColumn("_full", F.sum(value).over(w.rowsBetween(0, block - 1)))
    # cut block: the rem values from here on, as a bounded array sum
    vals = F.collect_list(value).over(w.rowsBetween(0, block - 1))
    d = d.withColumn("_cut", A.total(F.slice(vals, F.lit(1), F.col("_rem").cast("int"))))
    starts = d.where(F.col("_i") + block <= F.col("_n")).select(*keys, F.col("_i").alias("_start"), "_full", "_cut")
    folds = d.groupBy(*keys).agg(F.max("_n").alias("_n"))
    slots = F.floor((F.col("_n") - 1) / block)
    r = folds.where(F.col("_n") >= block).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), slots)))
    r = r.withColumn("_start", draw(F.col("_n") - block + 1, str(seed), *[F.col(k).cast("string") for k in keys], F.col("draw").cast("string"), F.col("slot").cast("string")))
    j = r.join(starts, [*keys, "_start"])
    part = F.when(F.col("slot") == slots, F.col("_cut")).otherwise(F.col("_full"))
    sums = j.groupBy(*by, "draw").agg(F.sum(part).alias("_s"))
    size = folds.where(F.col("_n") >= block).groupBy(*by).agg(F.sum("_n").alias("_all"))
    means = sums.join(size, list(by)).withColumn("mean", F.col("_s") / F.col("_all"))
    return means.groupBy(*by).agg(F.expr("percentile(mean, 0.05)").alias("low"), F.expr("percentile(mean, 0.95)").alias("high"), F.avg("mean").alias("centre"), F.count("*").alias("draws"))


# ---- analogue quantiles and corrections -----------------------------------------------------------

def analogue_quantiles(base: DataFrame, residuals: DataFrame, by: Sequence[str] = ("symbol",), cap: float = 0.25, minimum: int = 8, scale: float = 320.0) -> DataFrame:
    """Expected path plus residual quantiles, partly replaced by those of the nearest analogues.

    base: by, step, expected, r10, r50, r90 (model residual quantiles). residuals: by,
    step, res, one row per analogue. The blend grows with their number up to ``cap``.
    """
    q = residuals.groupBy(*by, "step").agg(F.expr("percentile(res, array(0.1, 0.5, 0.9))").alias("_q"), F.count("*").alias("_n"))
    j = base.join(q, [*by, "step"], "left")
    blend = F.when(F.col("_n") >= minimum, F.least(F.lit(cap), F.col("_n") / scale)).otherwise(0.0)
    mixed = F.array(*[F.col("expected") + (1 - blend) * F.col(c) + blend * F.coalesce(F.col("_q")[i], F.lit(0.0)) for i, c in enumerate(("r10", "r50", "r90"))])
    j = j.withColumn("_s", F.array_sort(mixed))
    return j.select(*by, "step", *[F.col("_s")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def correct_path(df: DataFrame, path: str = "path", state: str = "market_state_code", gate: str = "OFF") -> DataFrame:
    """Bounded corrections of an expected path: market regime on weeks 1-4, five-day momentum on weeks 1-2.

    df: path, market_state_code, ret_26, d_ret_5. gate: OFF, FIXED or REGIME_GATED
    (momentum only in rising or volatile markets).
    """
    c = F.col
    signal = F.when(c(state) == 1.0, 1.0).when(c(state) == -1.0, -1.0).otherwise(0.0)
    strength = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("ret_26", F.lit(0.0)) / 0.08))
    regime = F.greatest(F.lit(-0.02), F.least(F.lit(0.02), 0.10 * signal * strength))
    momentum = F.coalesce(F.greatest(F.lit(-0.02), F.least(F.lit(0.02), c("d_ret_5") * 0.25)), F.lit(0.0))
    on = {"OFF": F.lit(False), "FIXED": F.lit(True), "REGIME_GATED": c(state).isin(1.0, 2.0)}[gate]
    out = df.withColumns({"regime_adjustment": regime, "momentum_adjustment": F.when(F.coalesce(on, F.lit(False)), momentum).otherwise(0.0)})
    return out.withColumn(
        "corrected", F.transform(path, lambda v, i: v + F.when(i < 4, c("regime_adjustment")).otherwise(0.0) + F.when(i < 2, c("momentum_adjustment")).otherwise(0.0))
    )
