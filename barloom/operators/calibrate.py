"""Probability calibration per group: temperature, Platt, isotonic, and the choice between them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import arrays as A
from barloom.functions.scalar import clip
from barloom.operators.panel import asof_join, last_n
from barloom.session import cut_lineage

CLASSES = ("UP", "SIDEWAYS", "DOWN")
GRID = 751  # temperatures 0.25 .. 4.0
METHODS = ("TEMPERATURE", "PLATT", "ISOTONIC")


def calibrate_temperature(df: DataFrame, by: Sequence[str], min_rows: int = 30) -> DataFrame:
    """Temperature on a fixed grid with the smallest mean log loss per group.

    df: by, p_up, p_side, p_down, actual_class. The grid is unnested per row and
    averaged map-side at once, so only (group, temperature) sums are shuffled.
    Rows whose class is NULL or unknown are neither scored nor counted.
    """
    logs = F.array(*[F.log(clip(c, 1e-9, 1.0)) for c in ("p_up", "p_side", "p_down")])
    pick = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("actual_class")).cast("int")
    rows = df.where(F.col("actual_class").isin(*CLASSES)).select(*by, logs.alias("_l"), pick.alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("step"))
    t = 0.25 + F.col("step") * (3.75 / (GRID - 1))
    top = F.array_max("_l")
    e = [F.exp((F.col("_l")[i] - top) / t) for i in range(3)]
    mine = F.exp((F.element_at("_l", F.col("_k")) - top) / t)
    loss = -F.log(F.greatest(mine / (e[0] + e[1] + e[2]), F.lit(1e-12)))
    g = rows.groupBy(*by, "step").agg(F.avg(loss).alias("_loss"), F.count("*").alias("n"))
    best = g.groupBy(*by).agg(F.min_by("step", F.struct(F.round("_loss", 12), F.col("step"))).alias("step"), F.min("_loss").alias("log_loss"), F.max("n").alias("n"))
    return best.where(F.col("n") >= min_rows).select(*by, (0.25 + F.col("step") * (3.75 / (GRID - 1))).alias("temperature"), "log_loss", "n")


def temperature_from_brier(brier, n) -> Column:
    """Mild temperature from a mean squared score; 1 below 30 samples."""
    raw = 1.0 + 0.5 * (1.0 - clip(F.col(brier) / 0.25, 0.0, 1.0))
    return F.when(F.col(n) < 30, 1.0).otherwise(clip(raw, 0.5, 2.0))


# ---- Platt and isotonic fits over all rows of a group ----------------------------------------

def outcome_counts(df: DataFrame, by: Sequence[str], p: str = "p_up", hit: Column | None = None) -> DataFrame:
    """(by, p, n, hits): rows and hits of each different probability; combined before the shuffle."""
    is_hit = F.col("actual_class") == CLASSES[0] if hit is None else hit
    known = df.where(F.col(p).isNotNull() & ~F.isnan(p) & is_hit.isNotNull())
    return known.groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.count("*").alias("n"), F.sum(is_hit.cast("long")).alias("hits"))


def platt_models(counts: DataFrame, by: Sequence[str], steps: int = 40, settled: float = 1e-11) -> DataFrame:
    """(by, a, b): logistic fit of the hits on the logit of p, all groups at once.

    A Newton step needs five sums per group, which are summed before the shuffle; the models of the groups go back to
    the rows by a join. Stops when no group moves by more than ``settled``.
    """
    keys = list(by)
    rows = cut_lineage(counts.select(*keys, A.logit("p").alias("_x"), "n", "hits"))
    models = cut_lineage(rows.select(*keys).distinct().withColumns({"a": F.lit(0.0), "b": F.lit(0.0)}))
    for _ in range(steps):
        mu = 1 / (1 + F.exp(-(F.col("a") * F.col("_x") + F.col("b"))))
        j = rows.join(models, keys).withColumns({"_e": F.col("hits") - F.col("n") * mu, "_w": F.col("n") * F.greatest(F.lit(1e-9), F.least(F.lit(1.0), mu * (1 - mu)))})
        x = F.col("_x")
        g = j.groupBy(*keys).agg(
            F.first("a").alias("a"), F.first("b").alias("b"), F.sum(F.col("_e") * x).alias("_gx"), F.sum("_e").alias("_g1"),
            (F.sum(F.col("_w") * x * x) + 1e-9).alias("_hxx"), F.sum(F.col("_w") * x).alias("_hx"), (F.sum("_w") + 1e-9).alias("_h1"),
        )
        det = F.col("_hxx") * F.col("_h1") - F.col("_hx") * F.col("_hx")
        moves = {"_da": (F.col("_gx") * F.col("_h1") - F.col("_g1") * F.col("_hx")) / det, "_db": (F.col("_g1") * F.col("_hxx") - F.col("_gx") * F.col("_hx")) / det}
        after = cut_lineage(g.withColumns(moves).select(*keys, (F.col("a") + F.col("_da")).alias("a"), (F.col("b") + F.col("_db")).alias("b"), F.greatest(F.abs("_da"), F.abs("_db")).alias("_move")))
        models = after.drop("_move")
        if not (after.agg(F.max("_move")).first()[0] or 0.0) > settled:
            break
    return models


def pooled(x: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pools of adjacent violators, given points or pools in order of x: right ends, sizes and hits.

    Runs of falling levels become one pool, again and again, until no level is below the one before it. Pooling the pools
    of stretches gives the pools of the whole, so stretches may be pooled apart. Levels are compared as fractions.
    """
    while len(x) > 1:
        falls = hits[:-1] * n[1:] > hits[1:] * n[:-1]
        if not falls.any():
            break
        starts = np.flatnonzero(np.concatenate([[True], ~falls]))
        ends = np.concatenate([starts[1:] - 1, [len(x) - 1]])
        x, n, hits = x[ends], np.add.reduceat(n, starts), np.add.reduceat(hits, starts)
    return x, n, hits


def isotonic_models(counts: DataFrame, by: Sequence[str], parts: int | None = None, fan: int = 8) -> DataFrame:
    """(by, x, level, n): the pools of the non-decreasing fit of hits on p, by their right ends.

    The different probabilities are range-sorted by (group, p) and every range is pooled by itself; then the pools of
    ``fan`` neighbouring ranges at a time are pooled together until one range is left. What a task holds are counts of
    different probabilities at first and pools later, never rows.
    """
    keys = list(by)
    spark = counts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    ddl = f"{kinds}, _part int, p double, n long, hits long"
    ranged = counts.select(*keys, "p", "n", "hits").repartitionByRange(parts, *keys, "p").withColumn("_part", F.spark_partition_id())

    def pool(key, table):
        table = table.sort_by("p")
        x, n, hits = pooled(*(table.column(c).to_numpy() for c in ("p", "n", "hits")))
        own = [pa.array([v.as_py()] * len(x), v.type) for v in key]
        return pa.table([*own[:-1], own[-1].cast(pa.int32()), pa.array(x), pa.array(n), pa.array(hits)], names=[*keys, "_part", "p", "n", "hits"])

    pools = cut_lineage(ranged)
    while True:
        pools = pools.groupBy(*keys, "_part").applyInArrow(pool, ddl)
        if parts <= 1:
            break
        pools = pools.withColumn("_part", F.floor(F.col("_part") / fan).cast("int"))
        parts = -(-parts // fan)
    return pools.select(*keys, F.col("p").alias("x"), (F.col("hits") / F.col("n")).alias("level"), "n")


def isotonic_value(df: DataFrame, models: DataFrame, by: Sequence[str], p: str = "p_up", out: str = "isotonic") -> DataFrame:
    """Adds the fitted value: linear between the right ends of the pools, flat beyond the outer ones."""
    keys = list(by)
    o = Window.partitionBy(*keys).orderBy("x")
    ends = models.select(*keys, "x", F.col("level").alias("_y"), F.lead("x").over(o).alias("_x1"), F.lead("level").over(o).alias("_y1"), (F.row_number().over(o) == 1).alias("_low"))
    lowest = ends.where("_low").select(*keys, F.col("_y").alias("_y0"))
    j = asof_join(df, ends, keys, p, "x", ["_y", "_x1", "_y1"]).join(lowest, keys, "left")
    inner = F.col("_y") + (F.col(p) - F.col("matched_x")) / F.greatest(F.col("_x1") - F.col("matched_x"), F.lit(1e-12)) * (F.col("_y1") - F.col("_y"))
    value = F.when(F.col("matched_x").isNull(), F.col("_y0")).when(F.col("_x1").isNull(), F.col("_y")).otherwise(inner)
    return j.withColumn(out, value).drop("matched_x", "_y", "_x1", "_y1", "_y0")


# ---- choice between them ----------------------------------------------------------------------

def _spread(up: Column) -> list[Column]:
    """Class probabilities with a new first one; the second keeps its share of the rest."""
    up = clip(up, 1e-6, 1 - 1e-6)
    mid = F.col("p_side") / F.greatest(F.col("p_side") + F.col("p_down"), F.lit(1e-9)) * (1 - up)
    return [up, mid, F.greatest(F.lit(0.0), 1 - up - mid)]


def _tempered() -> list[Column]:
    """Each class through its own sigmoid at temperature 1, renormalised."""
    q = [1 / (1 + F.exp(-A.logit(c))) for c in ("p_up", "p_side", "p_down")]
    return [x / (q[0] + q[1] + q[2]) for x in q]


def candidate_probabilities(df: DataFrame, platt: DataFrame, isotonic: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the arrays TEMPERATURE, PLATT and ISOTONIC of class probabilities."""
    keys = list(by)
    j = isotonic_value(df, isotonic, keys, out="_iso").join(platt, keys, "left")
    up = 1 / (1 + F.exp(-(F.col("a") * A.logit("p_up") + F.col("b"))))
    return j.withColumns({"TEMPERATURE": F.array(*_tempered()), "PLATT": F.array(*_spread(up)), "ISOTONIC": F.array(*_spread(F.col("_iso")))}).drop("_iso", "a", "b")


def selection_rows(df: DataFrame, by: Sequence[str], order: str = "anchor", selection: int = 30, train: int = 25) -> DataFrame:
    """The newest ``selection`` rows of each group; the first ``train`` of them have ``fits``."""
    recent = last_n(df.where(F.col("actual_class").isin(*CLASSES)), selection, list(by), order)
    return recent.withColumn("fits", F.row_number().over(Window.partitionBy(*by).orderBy(order)) <= train)


@dataclass(frozen=True)
class Selection:
    """Per group: the chosen method with its hold-out score, and the models of all groups."""

    methods: DataFrame
    platt: DataFrame
    isotonic: DataFrame


def select_calibrator(df: DataFrame, by: Sequence[str], order: str = "anchor", selection: int = 30, train: int = 25) -> Selection:
    """Best of temperature, Platt and isotonic on the newest ``selection`` rows per group.

    The first ``train`` of them fit, the rest decide by the half-squared score; the earlier method wins ties.
    """
    keys = list(by)
    rows = cut_lineage(selection_rows(df.select(*keys, order, "p_up", "p_side", "p_down", "actual_class"), keys, order, selection, train))
    counts = cut_lineage(outcome_counts(rows.where("fits"), keys))
    platt, isotonic = platt_models(counts, keys), cut_lineage(isotonic_models(counts, keys))
    scored = candidate_probabilities(rows.where("not fits"), platt, isotonic, keys)
    hit = [(F.col("actual_class") == c).cast("double") for c in CLASSES]
    loss = lambda m: F.avg(0.5 * sum((F.pow(F.col(m)[i] - h, 2) for i, h in enumerate(hit)), F.lit(0.0)))
    scores = scored.groupBy(*keys).agg(*[loss(m).alias(m) for m in METHODS])
    pick = F.array_min(F.array(*[F.struct(F.round(m, 12).alias("score"), F.lit(i).alias("place"), F.lit(m).alias("method")) for i, m in enumerate(METHODS)]))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    methods = sizes.join(scores.select(*keys, pick.alias("_p")), keys, "left").select(*keys, F.coalesce("_p.method", F.lit(METHODS[0])).alias("method"), F.col("_p.score").alias("holdout_score"), "n")
    return Selection(cut_lineage(methods), platt, isotonic)


def apply_calibrator(df: DataFrame, chosen: Selection, by: Sequence[str]) -> DataFrame:
    """Calibrated class probabilities of every row by its group's selected method."""
    keys = list(by)
    j = candidate_probabilities(df, chosen.platt, chosen.isotonic, keys).join(chosen.methods.select(*keys, "method"), keys, "left")
    use = F.when(F.col("method") == "PLATT", F.col("PLATT")).when(F.col("method") == "ISOTONIC", F.col("ISOTONIC")).otherwise(F.col("TEMPERATURE"))
    return j.withColumn("_c", use).withColumns({f"c_{n}": F.col("_c")[i] for i, n in enumerate(("up", "side", "down"))}).drop("_c", "method", *METHODS)


def fit_calibrators(df: DataFrame, by: Sequence[str], effective: DataFrame, formal: int = 50, preliminary: int = 30) -> DataFrame:
    """Temperature per group with a status by effective sample count; below ``preliminary`` it shrinks to 1.

    effective: by, independent. ``effective_from`` is the anchor after the last one used.
    """
    t = calibrate_temperature(df, by, 1)
    last = df.groupBy(*by).agg(F.max("available").alias("fitted_through"))
    j = t.join(effective, list(by)).join(last, list(by))
    n = F.col("independent")
    status = F.when(n >= formal, "FORMALLY_CALIBRATED").when(n >= preliminary, "PRELIMINARY").otherwise("SHRINKAGE_ONLY")
    weight = F.least(F.lit(1.0), n / float(preliminary))
    return j.select(
        *by, status.alias("status"), F.when(n < preliminary, 1.0 + weight * (F.col("temperature") - 1.0)).otherwise(F.col("temperature")).alias("temperature"),
        "n", "independent", F.date_add("fitted_through", 7).alias("effective_from"),
    )


def as_of_calibrator(forecasts: DataFrame, calibrators: DataFrame, by: Sequence[str], t: str = "anchor") -> DataFrame:
    """Calibrator in force at each forecast's anchor."""
    return asof_join(forecasts, calibrators, by, t, "effective_from", ["temperature", "status"])

