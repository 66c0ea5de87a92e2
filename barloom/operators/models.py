"""Model fitting as table jobs: sums on executors, one small solve per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barloom.functions.scalar import as_col, clip
from barloom.operators.panel import exact_quantiles, ordered
from barloom.session import cut_lineage

DOUBLES = T.ArrayType(T.DoubleType())
DOUBLES2 = T.ArrayType(DOUBLES)


# ---- features in array form -------------------------------------------------------

def pack(df: DataFrame, names: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[_number(n) for n in names]))


def _number(name: str) -> Column:
    """A feature as double; NaN is missing like NULL."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def fit_scaler(df: DataFrame, names: Sequence[str], by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Medians, weighted means and scales of every feature per group, as arrays in feature order.

    Long form (group, feature): partial aggregates per feature, and exact medians.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    long = df.select(*by, w.alias("_w"), F.posexplode(F.array(*[_number(n) for n in names])).alias("_i", "_v"))
    med = exact_quantiles(long, [*by, "_i"], "_v", [0.5]).select(*by, "_i", F.col("quantiles")[0].alias("_med"))
    filled = long.join(med, [*by, "_i"], "left").withColumn("_med", F.coalesce("_med", F.lit(0.0))).withColumn("_x", F.coalesce("_v", "_med"))
    s = filled.groupBy(*by, "_i").agg(
        F.first("_med").alias("_med"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_x")).alias("_s1"),
        F.sum(F.col("_w") * F.pow(F.col("_x") - F.col("_med"), 2)).alias("_s2"),
    )
    mean = F.col("_s1") / F.col("_sw")
    var = F.greatest(F.col("_s2") / F.col("_sw") - F.pow(mean - F.col("_med"), 2), F.lit(0.0))
    s = s.select(*by, "_i", "_med", mean.alias("_mean"), F.when(F.sqrt(var) < 1e-9, 1.0).otherwise(F.sqrt(var)).alias("_scale"))
    rows = F.array_sort(F.collect_list(F.struct("_i", "_med", "_mean", "_scale")))
    g = s.groupBy(*by).agg(rows.alias("_r"))
    get = lambda f: F.transform("_r", lambda r: r[f])
    return g.select(*by, get("_med").alias("medians"), get("_mean").alias("means"), get("_scale").alias("scales"))


def transform(df: DataFrame, scaler: DataFrame, by: Sequence[str], x: str = "x", out: str = "z", bound: float = 8.0) -> DataFrame:
    """Impute by median, standardise, clip. The scaler has one row per group."""
    j = df.join(scaler, list(by))
    filled = F.zip_with(x, "medians", lambda v, m: F.coalesce(F.when(~F.isnan(v), v), m))
    stats = F.arrays_zip(F.col("means"), F.col("scales"))
    z = F.zip_with(filled, stats, lambda v, s: F.greatest(F.lit(-bound), F.least(F.lit(bound), (v - s["means"]) / s["scales"])))
    return j.withColumn(out, z).drop("medians", "means", "scales")


# ---- ridge ---------------------------------------------------------------------------

def _moments(keys: list[str], x: str, y: str, w: str):
    """Per partition: weighted sums of the vector (1, x, y) times (1, x) for every group, emitted once at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                xs = np.vstack(g[x].to_numpy())
                ys = np.vstack(g[y].to_numpy())
                ws = g[w].to_numpy(dtype=float)[:, None]
                one = np.ones((len(g), 1))
                left, right = np.hstack([one, xs]), np.hstack([one, xs, ys])
                m = (left * ws).T @ right
                old = acc.get(key)
                acc[key] = (m, len(g)) if old is None else (old[0] + m, old[1] + len(g))
        rows = []
        for key, (m, n) in acc.items():
            key = key if isinstance(key, tuple) else (key,)
            rows.append((*key, m.ravel().tolist(), float(n)))
        if rows:
            yield pd.DataFrame(rows, columns=[*keys, "_m", "_n"])

    return run


def cross_moments(df: DataFrame, by: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """(group, position, value) of the summed moment matrix.

    Rows are reduced to one matrix per (partition, group) before anything is
    shuffled, so a hot group costs no more than the others; the element-wise sums
    then combine map-side again.
    """
    keys = list(by)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_m", DOUBLES), T.StructField("_n", T.DoubleType())])
    parts = df.select(*keys, x, y, w).mapInPandas(_moments(keys, x, y, w), schema)
    parts = parts.withColumn("_m", F.concat("_m", F.array("_n")))
    return parts.select(*keys, F.posexplode("_m").alias("pos", "value")).groupBy(*keys, "pos").agg(F.sum("value").alias("value"))


def ridge_fit(df: DataFrame, by: Sequence[str], alpha: float, p: int, outputs: int, x: str = "z", y: str = "y", w: str = "weight", l1: float = 0.0) -> DataFrame:
    """Weighted multi-output ridge per group: intercepts and coefficient rows (one per output).

    Centering and weight normalisation follow from the moment sums. With alpha > 0
    the primal and the dual solution coincide, so p > n needs no other path. ``l1``
    soft-thresholds the coefficients.
    """
    keys = list(by)
    sums = cross_moments(df, keys, x, y, w)
    schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField("intercept", DOUBLES), T.StructField("coefficients", DOUBLES2), T.StructField("n", T.LongType()), T.StructField("norm", T.DoubleType())]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = pdf.sort_values("pos")["value"].to_numpy()
        m, n = flat[:-1].reshape(p + 1, 1 + p + outputs), flat[-1]
        sw = m[0, 0]
        xm, ym = m[0, 1 : p + 1] / sw, m[0, p + 1 :] / sw
        scale = n / sw
        gram = scale * (m[1:, 1 : p + 1] - sw * np.outer(xm, xm)) + alpha * np.eye(p)
        cross = scale * (m[1:, p + 1 :] - sw * np.outer(xm, ym))
        beta = np.linalg.solve(gram, cross) if alpha > 0 else np.linalg.pinv(gram) @ cross
        beta = np.sign(beta) * np.maximum(np.abs(beta) - l1, 0.0)
        first = pdf.iloc[0]
        row = {k: first[k] for k in keys}
        return pd.DataFrame([{**row, "intercept": (ym - xm @ beta).tolist(), "coefficients": beta.T.tolist(), "n": int(round(n)), "norm": float(np.linalg.norm(beta))}])

    return sums.groupBy(*keys).applyInPandas(solve, schema)


def predict(df: DataFrame, model: DataFrame, by: Sequence[str], x: str = "z", out: str = "expected", low: float = -0.75, high: float = 1.5) -> DataFrame:
    """intercept + coefficients . z for every output, clipped. The model has one row per group."""
    j = df.join(model.select(*by, "intercept", "coefficients"), list(by))
    dot = F.transform("coefficients", lambda row: F.aggregate(F.zip_with(row, F.col(x), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    value = F.zip_with(dot, "intercept", lambda d, i: F.greatest(F.lit(low), F.least(F.lit(high), d + i)))
    return j.withColumn(out, value).drop("intercept", "coefficients")


# Weekly fade and cap of the daily correction.
DECAY = (1.0, 0.75, 0.5, 0.25)
CAP = 0.03


def bounded_correction(raw) -> Column:
    """Clip a correction path to the cap and fade it out after four weeks."""
    decay = F.array(*[F.lit(d) for d in DECAY])
    return F.transform(as_col(raw), lambda v, i: F.greatest(F.lit(-CAP), F.least(F.lit(CAP), v)) * F.coalesce(F.try_element_at(decay, i + 1), F.lit(0.0)))


def two_stage_fit(df: DataFrame, by: Sequence[str], p_weekly: int, p_daily: int, outputs: int, alpha: float = 10.0) -> DataFrame:
    """Weekly ridge, then a daily ridge on its residuals, bounded and fading: expected = weekly + correction.

    df: by, zw (weekly features), zd (daily features), y, weight.
    """
    first = ridge_fit(df, by, alpha, p_weekly, outputs, "zw")
    base = predict(df, first, by, "zw", "weekly_path")
    base = base.withColumn("_res", F.zip_with("y", "weekly_path", lambda a, b: a - b))
    second = ridge_fit(base, by, alpha, p_daily, outputs, "zd", "_res")
    out = predict(base, second, by, "zd", "_corr", -10.0, 10.0).withColumn("daily_correction", bounded_correction("_corr"))
    return out.withColumn("expected", F.zip_with("weekly_path", "daily_correction", lambda a, b: a + b)).drop("_res", "_corr")


def late_fusion(weekly: DataFrame, daily: DataFrame, keys: Sequence[str], weights: Sequence[float], path: str = "path") -> DataFrame:
    """Blend two path forecasts: the daily one with a weight per step, the weekly one with the rest."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    j = weekly.select(*keys, F.col(path).alias("_w")).join(daily.select(*keys, F.col(path).alias("_d")), list(keys))
    share = lambda i: F.coalesce(F.try_element_at(w, i + 1), F.lit(0.0))
    pairs = F.arrays_zip(F.col("_w").alias("a"), F.col("_d").alias("b"))
    return j.select(*keys, F.transform(pairs, lambda x, i: x["a"] * (1 - share(i)) + x["b"] * share(i)).alias("fused"))


def fit_stumps(df: DataFrame, by: Sequence[str], features: int, outputs: int, rounds: int = 3, rate: float = 0.1, screen: int = 48) -> tuple[DataFrame, DataFrame]:
    """Median stumps boosted on residual paths: (stumps, rows with ``fitted``).

    Each round screens features by |sum(x * mean residual)|, tries the median split
    of the best ones and keeps the smallest squared error. The rounds are few and
    driven from here; every round's rows are checkpointed in the shared folder.
    df: by, id, z (array), residual (array).
    """
    keys = list(by)
    long0 = df.select(*keys, "id", F.posexplode("z").alias("feature", "xv"))
    thresholds = cut_lineage(exact_quantiles(long0, [*keys, "feature"], "xv", [0.5]).select(*keys, "feature", F.col("quantiles")[0].alias("threshold")))
    work = df.withColumn("fitted", F.array(*[F.lit(0.0)] * outputs))
    stumps = None
    for rnd in range(rounds):
        target = F.aggregate("residual", F.lit(0.0), lambda s, v: s + v) / outputs
        long = work.select(*keys, target.alias("_t"), "residual", F.posexplode("z").alias("feature", "xv"))
        long = long.join(thresholds, [*keys, "feature"])
        left = F.col("xv") <= F.col("threshold")
        g = long.groupBy(*keys, "feature", left.alias("left")).agg(
            F.sum(F.col("xv") * F.col("_t")).alias("_c"), F.count("*").alias("_n"),
            F.array(*[F.sum(F.col("residual")[i]) for i in range(outputs)]).alias("_s"), F.first("threshold").alias("threshold"),
        )
        gain = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v * v) / F.col("_n")
        g = g.withColumns({"_gain": gain, "_leaf": F.transform("_s", lambda v: v / F.col("_n") * rate)})
        f = g.groupBy(*keys, "feature").agg(
            F.abs(F.sum("_c")).alias("score"), F.sum("_gain").alias("gain"), F.min("_n").alias("_min"), F.count("*").alias("_sides"), F.first("threshold").alias("threshold"),
            F.max(F.when(F.col("left"), F.col("_leaf"))).alias("left_leaf"), F.max(F.when(~F.col("left"), F.col("_leaf"))).alias("right_leaf"),
        )
        w = Window.partitionBy(*keys)
        f = f.withColumn("_rank", F.row_number().over(w.orderBy(F.col("score").desc(), "feature"))).where(f"_rank <= {screen} and _sides = 2 and _min >= 2")
        best = f.withColumn("_b", F.row_number().over(w.orderBy(F.col("gain").desc(), "feature"))).where("_b = 1")
        best = best.select(*keys, F.lit(rnd).alias("round"), "feature", "threshold", "left_leaf", "right_leaf", "gain")
        best = cut_lineage(best)
        stumps = best if stumps is None else stumps.unionByName(best)
        j = work.join(best.drop("round", "gain"), keys, "left")
        leaf = F.when(F.element_at("z", F.col("feature") + 1) <= F.col("threshold"), F.col("left_leaf")).otherwise(F.col("right_leaf"))
        leaf = F.coalesce(leaf, F.array(*[F.lit(0.0)] * outputs))
        j = j.withColumn("_leaf", leaf).withColumns({"residual": F.zip_with("residual", "_leaf", lambda a, b: a - b), "fitted": F.zip_with("fitted", "_leaf", lambda a, b: a + b)})
        work = cut_lineage(j.select(*work.columns))
    return stumps, work


# ---- out of distribution --------------------------------------------------------------

def ood_fit(df: DataFrame, names: Sequence[str], by: Sequence[str], shrinkage: float = 0.20) -> DataFrame:
    """Quantile bounds, robust centre and scale, and the shrunk precision matrix of the features per group."""
    keys = list(by)
    long = df.select(*keys, F.posexplode(F.array(*[_number(n) for n in names])).alias("_i", "_v"))
    q = long.select(*keys, "_i").distinct().join(exact_quantiles(long, [*keys, "_i"], "_v", [0.01, 0.25, 0.5, 0.75, 0.99], "_q"), [*keys, "_i"], "left")
    stats = q.select(*keys, "_i", *[F.col("_q")[i].alias(n) for i, n in enumerate(("lo", "q1", "mid", "q3", "hi"))])
    rows = F.array_sort(F.collect_list(F.struct("_i", "lo", "mid", "hi", F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(1e-9)).alias("rs"))))
    st = stats.groupBy(*keys).agg(rows.alias("_r"))
    get = lambda f: F.transform("_r", lambda r: r[f])
    st = st.select(*keys, get("lo").alias("q_low"), get("hi").alias("q_high"), get("mid").alias("center"), get("rs").alias("rscale"))
    p = len(names)
    x = pack(df, names).join(st, keys)
    fill = F.zip_with("x", "center", lambda v, c: F.coalesce(v, c))
    pairs = F.arrays_zip(F.col("center"), F.col("rscale"))
    x = x.withColumn("_rz", F.zip_with(fill, pairs, lambda v, s: (v - s["center"]) / s["rscale"])).withColumns({"_y": F.array(F.lit(0.0)), "_w": F.lit(1.0)})
    sums = cross_moments(x, keys, "_rz", "_y", "_w")
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("precision", DOUBLES2)])

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = pdf.sort_values("pos")["value"].to_numpy()
        m, n = flat[:-1].reshape(p + 1, p + 2), flat[-1]
        mean = m[0, 1 : p + 1] / n
        cov = (m[1:, 1 : p + 1] - n * np.outer(mean, mean)) / max(n - 1, 1)
        prec = np.linalg.pinv((1 - shrinkage) * cov + shrinkage * np.eye(p), hermitian=True)
        first = pdf.iloc[0]
        return pd.DataFrame([{**{k: first[k] for k in keys}, "precision": prec.tolist()}])

    return st.join(sums.groupBy(*keys).applyInPandas(invert, schema), keys)


def ood_score(df: DataFrame, fit: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """0.45 outside share + 0.30 robust z maximum + 0.25 multivariate distance, each saturating at 1."""
    p = float(len(names))
    j = pack(df, names).join(fit, list(by))
    fill = F.zip_with("x", "center", lambda v, c: F.coalesce(v, c))
    j = j.withColumn("_f", fill)
    b = F.arrays_zip(F.col("q_low"), F.col("q_high"), F.col("center"), F.col("rscale"))
    out = F.aggregate(F.zip_with("_f", b, lambda v, s: ((v < s["q_low"]) | (v > s["q_high"])).cast("double")), F.lit(0.0), lambda a, v: a + v) / p
    j = j.withColumn("_rz", F.zip_with("_f", b, lambda v, s: (v - s["center"]) / s["rscale"]))
    zmax = F.array_max(F.transform("_rz", lambda v: F.least(F.abs(v), F.lit(100.0))))
    j = j.withColumns({"outside_share": out, "robust_z_max": zmax, "_c": F.transform("_rz", lambda v: F.greatest(F.lit(-12.0), F.least(F.lit(12.0), v)))})
    row = lambda r: F.aggregate(F.zip_with(r, F.col("_c"), lambda a, c: a * c), F.lit(0.0), lambda a, v: a + v)
    quad = F.aggregate(F.zip_with(F.transform("precision", row), "_c", lambda a, c: a * c), F.lit(0.0), lambda a, v: a + v)
    j = j.withColumn("distance", F.sqrt(F.greatest(quad, F.lit(0.0)) / p))
    score = 0.45 * F.least(F.lit(1.0), F.col("outside_share") / 0.20) + 0.30 * F.least(F.lit(1.0), F.col("robust_z_max") / 8.0) + 0.25 * F.least(F.lit(1.0), F.col("distance") / 4.0)
    return j.withColumn("ood_score", clip(score, 0.0, 1.0)).drop("x", "_f", "_rz", "_c", "q_low", "q_high", "center", "rscale", "precision")


# ---- folds and windows -------------------------------------------------------------------

def purged_folds(df: DataFrame, folds: int = 5, min_train: int = 104, by: Sequence[str] = ("symbol",), t: str = "anchor") -> DataFrame:
    """Validation fold of each row (NULL = training only), its start, in ordered equal blocks after the first third."""
    n = F.count("*").over(Window.partitionBy(*by))
    work = df.withColumns({"_rn": F.row_number().over(ordered(by, t)) - 1, "_n": n})
    first = F.greatest(F.lit(min_train // 2), F.floor(F.col("_n") / 3))
    work = work.withColumn("_val", (F.col("_rn") >= first) & (F.col("_n") >= min_train))
    fold = F.ntile(folds).over(Window.partitionBy(*by, "_val").orderBy(t))
    work = work.withColumn("fold", F.when(F.col("_val"), fold))
    return work.withColumn("fold_start", F.when(F.col("_val"), F.min(t).over(Window.partitionBy(*by, "fold")))).drop("_rn", "_n", "_val")


def training_rows(folded: DataFrame, by: Sequence[str] = ("symbol",), t: str = "anchor", end: str = "label_end") -> DataFrame:
    """(fold, row) for every row whose label ended before the fold began; a row serves ``folds`` folds at most."""
    starts = folded.where("fold is not null").select(*by, F.col("fold").alias("for_fold"), F.col("fold_start").alias("_fs")).distinct()
    table = starts.groupBy(*by).agg(F.collect_list(F.struct("for_fold", "_fs")).alias("_folds"))
    j = folded.join(table, list(by))
    ok = F.filter("_folds", lambda f: (F.col(t) < f["_fs"]) & (F.col(end) < f["_fs"]))
    return j.withColumn("_f", F.explode(ok)).withColumn("for_fold", F.col("_f.for_fold")).drop("_folds", "_f")


# Rolling training windows in weeks.
WINDOWS = {"ROLLING_5Y": 260, "ROLLING_10Y": 520, "EXPANDING": None}


def training_window(df: DataFrame, mode: str, cutoff: str, by: Sequence[str] = ("symbol",), t: str = "anchor") -> DataFrame:
    """Rows before a cutoff, limited to the latest weeks of the mode."""
    rows = df.where(F.col(t) < F.lit(cutoff).cast("date"))
    n = WINDOWS[mode]
    if n is None:
        return rows
    w = Window.partitionBy(*by).orderBy(F.col(t).desc())
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def next_free(nodes: DataFrame, by: Sequence[str], block: Column) -> DataFrame:
    """(by, end, next): of the intervals (start, end) that start at an end or later, the earliest end.

    Minima run backwards inside (key, block of time) and over the blocks, so a key's intervals are spread over tasks.
    """
    keys = list(by)
    probes = nodes.select(*keys, F.col("end").alias("_at"), F.lit(None).cast(nodes.schema["end"].dataType).alias("_e"))
    both = nodes.select(*keys, F.col("start").alias("_at"), F.col("end").alias("_e")).unionByName(probes).withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(F.desc("_at"), F.col("_e").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*keys, "_block").agg(F.min("_e").alias("_m")).withColumn("_later", F.min("_m").over(later)).drop("_m")
    own = both.withColumn("_own", F.min("_e").over(inside)).where(F.col("_e").isNull())
    return own.join(blocks, [*keys, "_block"]).select(*keys, F.col("_at").alias("end"), F.least("_own", "_later").alias("next"))


def independent_windows(df: DataFrame, by: Sequence[str], start: str = "anchor", end: str = "label_end") -> DataFrame:
    """Largest number of non-overlapping intervals per key: the chain of earliest finishes, its links ranked by doubling.

    Intervals that end on the same day compete only with their latest start. Every interval points to the one that may
    follow it; in each round the counts along the links are added and the links doubled, by joins on (key, end), so a
    chain of n links takes log n rounds and no key is gathered in one place.
    """
    keys = list(by)
    nodes = cut_lineage(df.groupBy(*keys, F.col(end).alias("end")).agg(F.max(start).alias("start")))
    links = cut_lineage(next_free(nodes, keys, F.year("_at")).withColumn("count", F.lit(1)))
    while not links.where("next is not null").isEmpty():
        ahead = links.select(*keys, F.col("end").alias("next"), F.col("count").alias("_more"), F.col("next").alias("_then"))
        j = links.join(ahead, [*keys, "next"], "left")
        links = cut_lineage(j.select(*keys, "end", F.col("_then").alias("next"), (F.col("count") + F.coalesce("_more", F.lit(0))).alias("count")))
    return links.groupBy(*keys).agg(F.min_by("count", "end").alias("independent"))
