"""Turning points on price and oscillator paths, and windows of bars around anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators import indicators as I
from barloom.operators.panel import BY, ordered

PATH = ("symbol", "anchor")


def anchor_windows(df: DataFrame, every: int, back: int, ahead: int, by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Bars of complete windows around every ``every``-th bar: step -back+1 .. 0 is history, 1 .. ahead the path.

    A bar is fanned out to the anchors whose window holds it, at most
    (back + ahead) / every + 1 of them; no self join.
    """
    work = df.withColumns({"_o": F.row_number().over(ordered(by, t)), "_n": F.count("*").over(Window.partitionBy(*by))})
    lo = F.ceil((F.col("_o") - ahead) / every) * every
    hi = F.floor((F.col("_o") + back - 1) / every) * every
    work = work.where(lo <= hi).withColumn("anchor", F.explode(F.sequence(lo, hi, F.lit(every).cast("bigint"))))
    work = work.where((F.col("anchor") >= back) & (F.col("anchor") + ahead <= F.col("_n")))
    return work.withColumn("step", (F.col("_o") - F.col("anchor")).cast("int")).drop("_o", "_n")


def turn_thresholds(history: DataFrame, by: Sequence[str] = PATH) -> DataFrame:
    """Scales of a history of at most 60 bars per key: robust dif and return scale, epsilon, minimum prominence."""
    h = I.macd(history, by=by, t="step")
    w = ordered(by, "step")
    prev = F.lag("close").over(w)
    h = h.withColumns({"_d1": F.col("dif") - F.lag("dif").over(w), "_r": F.log(F.greatest("close", F.lit(1e-12)) / F.greatest(prev, F.lit(1e-12))), "_rank": F.row_number().over(Window.partitionBy(*by).orderBy(F.col("step").desc()))})
    first14 = (F.col("_rank") == 14) | prev.isNull()
    base = F.when(first14, F.col("close")).otherwise(prev)
    h = h.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - base), F.abs(F.col("low") - base)))
    recent = F.col("_rank") <= 52
    # Two exact medians over at most 52 values per key, folded from one bounded array.
    g = h.groupBy(*by).agg(
        F.max_by("close", "step").alias("anchor_close"),
        F.collect_list(F.when(recent, F.col("_d1"))).alias("_d"),
        F.collect_list(F.when(recent, F.col("_r"))).alias("_rs"),
        F.avg(F.when(F.col("_rank") <= 14, F.col("_tr"))).alias("_atr"),
    )

    def median(arr: Column) -> Column:
        s = F.array_sort(arr)
        n = F.size(s)
        lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return (F.try_element_at(s, lo + 1) + F.try_element_at(s, hi + 1)) / 2

    g = g.withColumns({"_dm": median(F.col("_d")), "_rm": median(F.col("_rs"))})
    g = g.withColumns(
        {
            "_dmad": median(F.transform("_d", lambda x: F.abs(x - F.col("_dm")))),
            "_rmad": median(F.transform("_rs", lambda x: F.abs(x - F.col("_rm")))),
        }
    )
    g = g.withColumns(
        {
            "dif_scale": F.greatest(1.4826 * F.col("_dmad"), 1e-10 * F.col("anchor_close")),
            "return_scale": F.greatest(1.4826 * F.col("_rmad"), F.lit(0.003)),
        }
    )
    return g.select(
        *by, "anchor_close", "dif_scale", (0.25 * F.col("dif_scale")).alias("dif_epsilon"), "return_scale",
        F.greatest(1.5 * F.col("return_scale"), 0.5 * F.col("_atr") / F.col("anchor_close")).alias("minimum_prominence"),
    )


def window_extrema(path: DataFrame, by: Sequence[str] = PATH) -> DataFrame:
    """First step of the lowest low and of the highest high."""
    return path.groupBy(*by).agg(
        F.min_by("step", F.struct("low", "step")).alias("low_step"), F.min("low").alias("lowest"),
        F.min_by("step", F.struct(-F.col("high"), F.col("step"))).alias("high_step"), F.max("high").alias("highest"),
    )


def _kinds() -> Column:
    return F.explode(F.array(F.lit("BOTTOM"), F.lit("TOP")))


def price_turns(path: DataFrame, thresholds: DataFrame, by: Sequence[str] = PATH) -> DataFrame:
    """Local extrema of path closes, judged by reversal, prominence, move and persistence.

    A top is a bottom of the negated log price, so both kinds share one set of
    conditions on s * log(close).
    """
    w = ordered(by, "step")
    lc = F.log("close")
    p = path.withColumns(
        {"_l": lc, "_prev": F.lag(lc).over(w), "_next": F.lead(lc).over(w), "_next2": F.lead(lc, 2).over(w)}
    ).where("_prev is not null and _next is not null")
    p = p.join(thresholds, list(by)).withColumn("turn_kind", _kinds())
    s = F.when(F.col("turn_kind") == "BOTTOM", 1.0).otherwise(-1.0)
    drop = s * (F.col("_prev") - F.col("_l"))
    rise = s * (F.col("_next") - F.col("_l"))
    sr = F.col("return_scale")
    p = p.withColumns({"_drop": drop, "_rise": rise, "_hold": s * (F.col("_next2") - F.col("_l")) >= 0.5 * sr})
    local = (F.col("_drop") > 0) & (F.col("_rise") > 0)
    reversal = (F.col("_drop") >= sr) & (F.col("_rise") >= sr)
    prominence = F.least("_drop", "_rise")
    qualifies = local & reversal & (prominence >= F.col("minimum_prominence")) & (F.abs("_drop") + F.abs("_rise") >= 2 * sr)
    held = F.coalesce(F.col("_hold"), F.lit(False))
    return p.where(local).select(
        *by, "step", "turn_kind",
        F.when(qualifies & held, "CONFIRMED").when(qualifies, "PENDING").otherwise("REJECTED").alias("status"),
        F.greatest(prominence, F.lit(0.0)).alias("prominence"),
    )


def dif_turns(path: DataFrame, thresholds: DataFrame, by: Sequence[str] = PATH) -> DataFrame:
    """Sign turns of the dif change beyond epsilon, confirmed by dea, histogram and dif of the next step.

    ``path`` carries dif, dea, hist, d1 (first change) and d2 (second change).
    """
    w = ordered(by, "step")
    nxt = lambda c: F.lead(c).over(w)
    p = path.withColumns({"_pd1": F.lag("d1").over(w), "_nd1": nxt("d1"), "_ndif": nxt("dif"), "_ndea": nxt("dea"), "_nhist": nxt("hist")})
    p = p.where("_pd1 is not null").join(thresholds, list(by)).withColumn("turn_kind", _kinds())
    s = F.when(F.col("turn_kind") == "BOTTOM", 1.0).otherwise(-1.0)
    eps = F.col("dif_epsilon")
    crossed = (s * F.col("_pd1") <= -eps) & (s * F.col("d1") >= eps) & (s * F.col("d2") > 0)
    confirmed = (
        (s * F.col("_nd1") >= 0.5 * eps)
        & (s * (F.col("_ndif") - F.col("dif")) > 0)
        & (s * (F.col("_ndea") - F.col("dea")) >= 0)
        & (s * (F.col("_nhist") - F.col("hist")) > 0)
    )
    return p.where(crossed).select(
        *by, "step", "turn_kind",
        F.when(F.col("_nd1").isNull(), "PENDING").when(confirmed, "CONFIRMED").otherwise("REJECTED").alias("status"),
        F.abs(F.col("d1") - F.col("_pd1")).alias("prominence"),
    )


def turn_consistency(keys: DataFrame, price: DataFrame, dif: DataFrame, max_gap: int = 2, by: Sequence[str] = PATH) -> DataFrame:
    """Do the confirmed price and dif turns of a path agree, and in which action window."""
    marked = price.withColumn("signal", F.lit("P")).unionByName(dif.withColumn("signal", F.lit("D")))
    ok = F.col("status") == "CONFIRMED"
    of = lambda sig: ok & (F.col("signal") == sig)
    strongest = lambda sig, c: F.max_by(F.when(of(sig), F.col(c)), F.when(of(sig), F.struct("prominence", -F.col("step"), "turn_kind")))
    g = marked.groupBy(*by).agg(
        F.count_if(of("P")).alias("_p"), F.count_if(of("D")).alias("_d"),
        F.count_if((F.col("signal") == "P") & (F.col("status") == "PENDING")).alias("_pp"),
        F.count_if((F.col("signal") == "D") & (F.col("status") == "PENDING")).alias("_dp"),
        F.min(F.when(of("P"), F.col("turn_kind"))).alias("_p1"), F.max(F.when(of("P"), F.col("turn_kind"))).alias("_p2"),
        F.min(F.when(of("D"), F.col("turn_kind"))).alias("_d1"), F.max(F.when(of("D"), F.col("turn_kind"))).alias("_d2"),
        strongest("P", "step").alias("price_step"), strongest("D", "step").alias("dif_step"),
    )
    g = keys.select(*by).distinct().join(g, list(by), "left").na.fill(0, ["_p", "_d", "_pp", "_dp"])
    state = (
        F.when((F.col("_p1") != F.col("_p2")) | (F.col("_d1") != F.col("_d2")), "AMBIGUOUS_TWO_SIDED")
        .when((F.col("_p") == 0) | (F.col("_d") == 0), "UNCONFIRMED")
        .when(F.col("_p1") != F.col("_d1"), "TYPE_CONFLICT")
        .when(F.abs(F.col("price_step") - F.col("dif_step")) <= max_gap, "TEMPORALLY_CONSISTENT")
        .otherwise("TIME_CONFLICT")
    )
    status = lambda n, pend: F.when(F.col(n) > 0, "CONFIRMED").when(F.col(pend) > 0, "PENDING").otherwise("NO_VALID_TURN")
    g = g.withColumn("consistency", state)
    agreed = F.col("consistency") == "TEMPORALLY_CONSISTENT"
    # Each turn's window is one step either side; act in the overlap, else until the later end.
    start = F.greatest("price_step", "dif_step") - 1
    overlap_end = F.least("price_step", "dif_step") + 1
    end = F.when(overlap_end < start, F.greatest("price_step", "dif_step") + 1).otherwise(overlap_end)
    return g.select(
        *by, "consistency", status("_p", "_pp").alias("price_status"), status("_d", "_dp").alias("dif_status"),
        F.when(agreed, F.col("_p1")).alias("action_kind"), F.when(agreed, start).alias("action_start"), F.when(agreed, end).alias("action_end"),
    )


def path_turns(paths: DataFrame, path: str = "path", by: Sequence[str] = PATH) -> DataFrame:
    """Sign-change points of the weekly increments of an expected cumulative path."""
    steps = paths.select(*by, F.posexplode(path).alias("pos", "value"))
    w = ordered(by, "pos")
    steps = steps.withColumn("inc", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)))
    prev, nxt = F.lag("inc").over(w), F.lead("inc").over(w)
    kind = F.when((F.col("inc") > 0) & (prev < 0) & (nxt < 0), "top").when((F.col("inc") < 0) & (prev > 0) & (nxt > 0), "bottom")
    return steps.withColumn("turn_kind", kind).where("turn_kind is not null").select(*by, (F.col("pos") + 1).alias("week"), "turn_kind")


def first_turn(df: DataFrame, value: str, by: Sequence[str] = PATH, step: str = "step") -> DataFrame:
    """First step at which the sign of a slope turns, and the kind; NULL slopes are skipped."""
    w = ordered(by, step)
    known = df.where(F.col(value).isNotNull())
    prev = F.lag(value).over(w)
    kind = F.when((prev < 0) & (F.col(value) >= 0), "bottom").when((prev > 0) & (F.col(value) <= 0), "top")
    turns = known.withColumn("turn_kind", kind)
    return turns.groupBy(*by).agg(
        F.min(F.when(F.col("turn_kind").isNotNull(), F.col(step))).alias("turn_step"),
        F.min_by("turn_kind", F.when(F.col("turn_kind").isNotNull(), F.col(step))).alias("turn_kind"),
    )


def trend_state(df: DataFrame, by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Label from the tails of dif, dea, histogram and close."""
    w = ordered(by, t)
    out = df.withColumn("_d1", F.col("dif") - F.lag("dif").over(w))
    d1, p1 = F.col("_d1"), F.lag("_d1").over(w)
    out = out.withColumn("_d2", d1 - p1)
    out = I.run_length(out, d1 > 0, "_run", by, t)
    back2 = lambda c: F.least(F.lag(c).over(w), F.lag(c, 2).over(w))
    rising = F.when(d1 > 0, F.col("_run")).otherwise(0)
    confirmed = (
        (F.col("dif") > back2("dif")) & (F.col("dea") > F.lag("dea").over(w)) & (F.col("hist") > F.lag("hist").over(w)) & (F.col("close") > back2("close"))
    )
    label = (
        F.when(d1.isNull(), "INSUFFICIENT")
        .when((d1 < 0) & (F.col("_d2") > 0), "POTENTIAL_BOTTOMING")
        .when((p1 < 0) & (d1 >= 0) & (F.col("_d2") > 0), "UPWARD_TURN")
        .when((rising >= 3) & confirmed, "UPTREND_CONFIRMED")
        .when(rising >= 3, "UPTREND_EARLY_CONFIRMED")
        .when(d1 > 0, "UPWARD_TURN_UNCONFIRMED")
        .otherwise("WEAK_OR_FALLING")
    )
    return out.withColumn("trend_state", label).drop("_d1", "_d2", "_run")


def observed_confirmation(df: DataFrame, epsilon: Column, min_rows: int = 30, by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Has the market itself confirmed a buy or a sell by its last three dif changes."""
    w = ordered(by, t)
    out = df.withColumns({"_d1": F.col("dif") - F.lag("dif").over(w), "_rn": F.row_number().over(w), "_eps": F.greatest(epsilon, F.lit(1e-12))})
    eps = F.col("_eps")

    def confirmed(s: float) -> Column:
        step = lambda c: s * (F.col(c) - F.lag(c).over(w))
        return F.coalesce(
            (F.col("_rn") >= min_rows)
            & (s * F.lag("_d1", 2).over(w) <= -eps) & (s * F.lag("_d1").over(w) >= eps) & (s * F.col("_d1") >= 0.5 * eps)
            & (step("dif") > 0) & (step("dea") >= 0) & (step("hist") > 0) & (step("close") >= 0),
            F.lit(False),
        )

    return out.withColumns({"buy_confirmed": confirmed(1.0), "sell_confirmed": confirmed(-1.0)}).drop("_d1", "_rn", "_eps")
