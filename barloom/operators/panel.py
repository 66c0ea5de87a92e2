"""Panel building blocks: frames, islands, as-of joins, two-level scans.

Two sizes of group occur in this library and are treated differently.

* A *bar series* has one row per key and session, so its length is bounded by
  the calendar (about 250 rows a year). Ordered windows per key are safe there.
* Raw rows (ticks, trades, events, revisions) have no such bound and one key may
  hold a third of them. They are pre-aggregated map-side, or scanned in two
  levels: inside (key, time block) first, then over the per-block totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.functions.scalar import as_col
from barloom.session import cut_lineage

BY = ("symbol",)
T = "trade_date"


def ordered(by: Sequence[str] = BY, t: str | Sequence[str] = T) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*([t] if isinstance(t, str) else t))


def trailing(n: int, by: Sequence[str] = BY, t: str | Sequence[str] = T) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return ordered(by, t).rowsBetween(-(n - 1), 0)


def running(by: Sequence[str] = BY, t: str | Sequence[str] = T) -> WindowSpec:
    return ordered(by, t).rowsBetween(Window.unboundedPreceding, 0)


def before(by: Sequence[str] = BY, t: str | Sequence[str] = T) -> WindowSpec:
    return ordered(by, t).rowsBetween(Window.unboundedPreceding, -1)



# ---- runs -------------------------------------------------------------------

def run_length(
    df: DataFrame, state: Column, out: str, by: Sequence[str] = BY, t: str | Sequence[str] = T
) -> DataFrame:
    """Length so far of the run of equal ``state`` the row belongs to (1 on a change).

    Same partitioning and ordering as every other bar window, so it adds no
    exchange and no sort.
    """
    w, upto = ordered(by, t), running(by, t)
    return (
        df.withColumns({"_rl_state": state, "_rl_row": F.row_number().over(w)})
        .withColumn("_rl_start", F.when((F.col("_rl_row") == 1) | ~F.col("_rl_state").eqNullSafe(F.lag("_rl_state").over(w)), F.col("_rl_row")))
        .withColumn(out, F.col("_rl_row") - F.last("_rl_start", ignorenulls=True).over(upto) + 1)
        .drop("_rl_state", "_rl_row", "_rl_start")
    )


def true_run(
    df: DataFrame, cond: Column, out: str, by: Sequence[str] = BY, t: str | Sequence[str] = T
) -> DataFrame:
    """Consecutive rows up to here for which cond holds, 0 where it does not."""
    return run_length(df, F.coalesce(cond, F.lit(False)), out, by, t).withColumn(
        out, F.when(F.coalesce(cond, F.lit(False)), F.col(out)).otherwise(0)
    )


# ---- latest / top-n ---------------------------------------------------------

def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by a total order; partial aggregation, so hot keys are combined map-side."""
    rest = [c for c in df.columns if c not in by]
    packed = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*by, "_row.*")


def last_n(df: DataFrame, n: int, by: Sequence[str] = BY, t: str | Sequence[str] = T) -> DataFrame:
    """Latest n rows per key. Spark turns the filter into a per-task group limit before the exchange."""
    keys = [t] if isinstance(t, str) else list(t)
    w = Window.partitionBy(*by).orderBy(*[F.col(k).desc() for k in keys])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def arg_extreme(df: DataFrame, by: Sequence[str], value: str, idx: str, kind: str = "min") -> DataFrame:
    """Index of the smallest/largest value; the first index wins ties."""
    signed = F.col(value) if kind == "min" else -F.col(value)
    return df.groupBy(*by).agg(F.min_by(F.col(idx), F.struct(signed, F.col(idx))).alias(idx))


# ---- as-of joins ------------------------------------------------------------

def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_t: str,
    right_t: str,
    cols: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Per left row, ``cols`` of the last right row at or before (strict: before) it.

    The match is resolved once per distinct (key, time) of the left side, then
    joined back on equality. The ordered window therefore only ever holds the
    distinct times of a key, however many left rows share them, and the join
    back is an equi-join that AQE can split when a key is hot. ``right`` must be
    unique per (key, time); reduce vintages first.
    """
    packed = F.struct(F.col(right_t).alias("_t"), *[F.col(c) for c in cols])
    probes = left.select(*by, F.col(left_t).alias("_at")).distinct().withColumn("_val", F.lit(None))
    events = right.select(*by, F.col(right_t).alias("_at"), packed.alias("_val"))
    side = F.when(F.col("_val").isNull(), 0 if strict else 1).otherwise(1 if strict else 0)
    both = probes.withColumn("_val", F.lit(None).cast(events.schema["_val"].dataType)).unionByName(events)
    both = both.withColumn("_side", side)
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        both.withColumn("_hit", F.last("_val", ignorenulls=True).over(w))
        .where(F.col("_val").isNull())
        .select(*by, F.col("_at").alias(left_t), F.col("_hit._t").alias(f"matched_{right_t}"), *[F.col(f"_hit.{c}") for c in cols])
    )
    return left.join(found, [*by, left_t], "left")


# ---- two-level scans for unbounded groups -----------------------------------

def block_scan(
    df: DataFrame,
    by: Sequence[str],
    block: Column,
    order: Sequence[str],
    sums: dict[str, Column],
    mins: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums (and running minima of running sums) over unbounded groups.

    Rows are scanned inside (key, block), the block totals are scanned per key
    (as many rows as there are time blocks), and both are added. ``block`` must
    be a non-decreasing function of ``order``, such as the day of a timestamp.
    ``mins`` names output -> name in ``sums`` whose running minimum is wanted.
    """
    mins = mins or {}
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_block", block)
    local = local.withColumns({f"_s_{k}": F.sum(v).over(upto) for k, v in sums.items()})
    totals = [F.sum(v).alias(f"_t_{k}") for k, v in sums.items()]
    if mins:
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        local = local.withColumns(
            {f"_m_{k}": F.min(f"_s_{src}").over(upto) for k, src in mins.items()}
            | {f"_q_{k}": F.min(f"_s_{src}").over(earlier) for k, src in mins.items()}
        )
        totals = local.groupBy(*by, "_block").agg(*totals, *[F.min(f"_s_{src}").alias(f"_l_{k}") for k, src in mins.items()])
    else:
        # no minima: totals come straight from the input, combined before the exchange
        totals = df.withColumn("_block", block).groupBy(*by, "_block").agg(*totals)
    prior = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_o_{k}": F.coalesce(F.sum(f"_t_{k}").over(prior), F.lit(0)) for k in sums})
    if mins:
        totals = totals.withColumns({f"_p_{k}": F.min(F.col(f"_l_{k}") + F.col(f"_o_{src}")).over(prior) for k, src in mins.items()})
    carry = totals.select(*by, "_block", *[f"_o_{k}" for k in sums], *[f"_p_{k}" for k in mins])
    joined = local.join(carry, [*by, "_block"])
    out = {k: F.col(f"_o_{k}") + F.col(f"_s_{k}") for k in sums}
    out |= {k: F.least(F.col(f"_p_{k}"), F.col(f"_o_{src}") + F.col(f"_m_{k}")) for k, src in mins.items()}
    out |= {f"{k}_before": F.least(F.col(f"_p_{k}"), F.col(f"_o_{src}") + F.col(f"_q_{k}")) for k, src in mins.items()}
    return joined.withColumns(out).select(*df.columns, *sums, *mins, *[f"{k}_before" for k in mins])


def _affine_local(df: DataFrame, keys: Sequence[str], order: Sequence[str], m: str, b: str) -> DataFrame:
    """The recursion inside each group of ``keys``: its value ``_x`` from 0 and the factor ``_f`` a carry would be multiplied by.

    ``_isl`` and ``_sub`` never fall along the order, so all windows but the first share one sort.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    work = df.withColumn("_ln", F.when(F.col(m) > 0, F.log(m)).otherwise(0.0))
    work = work.withColumns({"_isl": F.count_if(F.col(m) == 0).over(upto), "_L": F.sum("_ln").over(upto)})
    work = work.withColumn("_sub", F.floor(-F.col("_L") / 300.0))
    ws = Window.partitionBy(*keys, "_isl", "_sub").orderBy(*order)
    wi = Window.partitionBy(*keys, "_isl").orderBy("_sub", *order)
    # product within the sub-block: relative to the row before it, which is the first row's own factor undone
    work = work.withColumn("_Lr", F.col("_L") - F.first(F.col("_L") - F.col("_ln")).over(ws.rowsBetween(Window.unboundedPreceding, 0)))
    work = work.withColumn("_loc", F.exp("_Lr") * F.sum(F.col(b) * F.exp(-F.col("_Lr"))).over(ws.rowsBetween(Window.unboundedPreceding, 0)))
    work = work.withColumn("_end", F.when(F.lead("_sub").over(wi) != F.col("_sub"), F.col("_loc")))
    prev_end = F.last("_end", ignorenulls=True).over(wi.rowsBetween(Window.unboundedPreceding, -1))
    work = work.withColumn("_x", F.col("_loc") + F.coalesce(F.exp("_Lr") * prev_end, F.lit(0.0)))
    return work.withColumn("_f", F.when(F.col("_isl") > 0, 0.0).otherwise(F.exp("_L")))


def affine_whole(df: DataFrame, by: Sequence[str], order: Sequence[str], m: str, b: str, out: str) -> DataFrame:
    """:func:`affine_scan` for groups that one task may hold: no blocks, no carries, one shuffle."""
    work = _affine_local(df, by, order, m, b).withColumn(out, F.col("_x"))
    w = Window.partitionBy(*by).orderBy("_isl", "_sub", *order)
    return work.withColumn(f"{out}_before", F.coalesce(F.lag(out).over(w), F.lit(0.0))).select(*df.columns, out, f"{out}_before")


def busy_cells(df: DataFrame, by: Sequence[str], together: int, cells: int = 1 << 16) -> tuple[Column, list[int]]:
    """The cell a key hashes to, and the cells with more than ``together`` rows; keys of all others have at most as many.

    One count per cell and task crosses the network, however many keys there are.
    """
    cell = F.pmod(F.xxhash64(*by), F.lit(cells))
    counts = df.groupBy(cell.alias("cell")).count().where(F.col("count") > together)
    return cell, [r.cell for r in counts.select("cell").collect()]


def affine_scan(df: DataFrame, by: Sequence[str], block: Column, order: Sequence[str], m: str, b: str, out: str) -> DataFrame:
    """x = m * x_previous + b along each group, starting from 0, for 0 <= m <= 1.

    Affine steps compose, so the scan is split like :func:`block_scan`. Inside a
    (key, block) the recursion unrolls to P * sum(b / P) with P the product of
    the m since the last m = 0; where P would leave the range of a double, a new
    sub-block starts and takes over the last value, as for the moving averages.
    Per key, only one (factor, value) pair per time block is folded. Also returns
    the value before each step as ``<out>_before``.
    """
    keys = [*by, "_block"]
    w = Window.partitionBy(*keys).orderBy(*order)
    work = _affine_local(df.withColumn("_block", block), keys, order, m, b)
    tail = F.max_by(F.struct("_f", "_x"), F.struct(*order))
    blocks = work.groupBy(*keys).agg(tail.alias("_t"))
    per_key = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", F.col("_t._f").alias("f"), F.col("_t._x").alias("x")))).alias("_bs"))
    empty = F.array().cast("array<double>")
    # carry into block i: value at the end of block i-1
    carry = F.aggregate(
        "_bs", F.struct(empty.alias("ins"), F.lit(0.0).alias("x")),
        lambda acc, e: F.struct(F.concat(acc["ins"], F.array(acc["x"])).alias("ins"), (e["f"] * acc["x"] + e["x"]).alias("x")),
        lambda acc: acc["ins"],
    )
    ins = per_key.select(*by, F.inline(F.arrays_zip(F.transform("_bs", lambda e: e["_block"]).alias("_block"), carry.alias("_in"))))
    joined = work.join(ins, keys).withColumn(out, F.col("_x") + F.col("_f") * F.col("_in"))
    return joined.withColumn(f"{out}_before", F.coalesce(F.lag(out).over(w), F.col("_in"))).select(*df.columns, out, f"{out}_before")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def weighted_sum(terms: Sequence[tuple[float, Column]]) -> Column:
    total = F.lit(0.0)
    for weight, term in terms:
        total = total + weight * term
    return total


def block_lag(
    df: DataFrame, by: Sequence[str], block: Column, order: Sequence[str], cols: dict[str, str], seen: str | None = None
) -> DataFrame:
    """Previous row's values (``cols``: output -> column) over unbounded groups.

    The lag runs inside (key, block); the first row of a block takes the last
    row of the nearest earlier block. ``seen`` adds a flag for having a previous row.
    """
    rest = F.struct(*[F.col(c).alias(o) for o, c in cols.items()])
    work = df.withColumn("_block", block)
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    ends = work.groupBy(*by, "_block").agg(F.max_by(rest, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_prev_end", F.lag("_end").over(Window.partitionBy(*by).orderBy("_block"))).drop("_end")
    out = work.withColumn("_lag", F.lag(rest).over(inside)).join(ends, [*by, "_block"])
    prev = F.coalesce("_lag", "_prev_end")
    extra = [prev.isNotNull().alias(seen)] if seen else []
    return out.select(*df.columns, *[prev[o].alias(o) for o in cols], *extra)


def nearest_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_t: str, right_t: str, cols: Sequence[str]
) -> DataFrame:
    """Right row nearest in days (the earlier one on a tie), from a backward and a forward as-of join.

    No pairs are formed: each side of the date is resolved by an ordered window.
    """
    pack = F.struct(*[F.col(c) for c in cols])
    back = asof_join(left.select(*by, left_t).distinct(), right.withColumn("_b", pack), by, left_t, right_t, ["_b"])
    epoch = F.date_diff(F.lit("1970-01-01").cast("date"), F.col(left_t))
    repoch = F.date_diff(F.lit("1970-01-01").cast("date"), F.col(right_t))
    ahead = asof_join(
        left.select(*by, left_t).distinct().withColumn("_n", epoch),
        right.select(*by, repoch.alias("_rn"), F.col(right_t).alias("_rt"), pack.alias("_f")),
        by, "_n", "_rn", ["_rt", "_f"],
    )
    both = back.join(ahead, [*by, left_t])
    db = F.date_diff(F.col(left_t), F.col(f"matched_{right_t}"))
    df_ = F.date_diff(F.col("_rt"), F.col(left_t))
    use_back = F.col("_rt").isNull() | (db <= df_)
    picked = both.select(
        *by, left_t,
        F.when(use_back, F.col(f"matched_{right_t}")).otherwise(F.col("_rt")).alias(f"nearest_{right_t}"),
        F.when(use_back, F.col("_b")).otherwise(F.col("_f")).alias("_hit"),
    )
    found = picked.select(*by, left_t, f"nearest_{right_t}", *[F.col(f"_hit.{c}") for c in cols])
    return left.join(found, [*by, left_t], "left")


# ---- exact quantiles --------------------------------------------------------------------

#: A sketch's ranks are right to a share of 1 / ACCURACY of the rows; brackets reach MARGIN to both sides.
ACCURACY, MARGIN = 10_000, 0.001


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], out: str = "quantiles") -> DataFrame:
    """(by, out): interpolated quantiles of a column per group, as an array in the order of ``shares``, exact.

    Two passes. A sketch of bounded size brackets every quantile between two values. Then all rows are counted against
    the brackets: rows outside only as numbers, rows inside by their different values, which are a share of about
    2 * MARGIN of the group; the ranks among them pick the values. No task holds a group's values. NULL and NaN are left
    out, and groups without a value have no row.
    """
    keys = list(by)
    known = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    known = cut_lineage(known)  # read twice
    ends = [max(0.0, min(1.0, q + side)) for q in shares for side in (-MARGIN, MARGIN)]
    sketch = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi")) for i, q in enumerate(shares)])
    each = known.join(sketch.select(*keys, "_n", asked.alias("_a")), keys).select(*keys, "_v", "_n", F.inline("_a"))
    v = F.col("_v")
    inside = F.when((v >= F.col("lo")) & (v <= F.col("hi")), v)
    counts = each.groupBy(*keys, "i", inside.alias("_in")).agg(
        F.first("q").alias("_q"), F.first("_n").alias("_n"), F.count_if((v < F.col("lo")) | F.col("lo").isNull()).alias("_below"), F.count("*").alias("_c"),
        F.max(F.when(v < F.col("lo"), v)).alias("_under"), F.min(F.when(v > F.col("hi"), v)).alias("_over"),
    )
    upto = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("_in")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum(F.when(F.col("_in").isNull(), F.col("_below")).otherwise(F.col("_c"))).over(upto))
    place = F.col("_q") * (F.col("_n") - 1)
    counts = counts.withColumns({"_k": F.floor(place), "_part": place - F.floor(place)})

    def at(k):
        """Value of rank k (from 0): below the bracket, in it, or the next one above."""
        found = F.min(F.when(F.col("_in").isNotNull() & (F.col("_upto") > k), F.col("_in")))
        return F.when(F.max("_below") > F.max(k), F.max("_under")).otherwise(F.coalesce(found, F.min("_over")))

    picked = counts.groupBy(*keys, "i").agg(F.first("_part").alias("_part"), at(F.col("_k")).alias("_x"), at(F.col("_k") + 1).alias("_y"))
    quantile = F.when(F.col("_part") > 0, (1 - F.col("_part")) * F.col("_x") + F.col("_part") * F.col("_y")).otherwise(F.col("_x"))
    listed = picked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", quantile.alias("x")))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda e: e["x"]).alias(out))
