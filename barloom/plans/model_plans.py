"""Queries over model fitting, calibration, scenarios and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalar import cut
from barloom.operators import analogues as AN, bars as B, calibrate as C, features as FE, gates as G, indicators as I, labels as L, ledger as LG, models as M, panel as P, pit, scenarios as SC, turns as TU
from barloom.plans import views as V
from barloom.plans.feature_plans import AHEAD, BACK, EVERY, _WIN
from barloom.plans.label_plans import LP, _CLASS, _HALF, _WIS, scored
from barloom.plans.registry import REG
from barloom.plans.sqlviews import day, r, with_views

OW = "(partition by symbol order by trade_date)"
NAMES = ["r1", "r4", "r13", "v13", "m20", "vr"]

# The same small feature table on both sides: returns, volatility, mean distance, volume ratio.
FT = {
    "ft": f"""select *, close / lag(close) over {OW} - 1 as r1, close / lag(close, 4) over {OW} - 1 as r4, close / lag(close, 13) over {OW} - 1 as r13, close / avg(close) over (partition by symbol order by trade_date rows between 19 preceding and current row) - 1 as m20,
      volume / avg(volume) over (partition by symbol order by trade_date rows between 12 preceding and current row) as vr from wn""",
    "ftv": "select *, case when count(r1) over f = 13 then stddev_pop(r1) over f end as v13 from ft window f as (partition by symbol order by trade_date rows between 12 preceding and current row)",
}


def table(spark, sf):
    """Anchors with features, 13-step label path, label end, ordinal and overlap weight."""
    w = L.label_path(B.bar_context(V.bars_weekly(spark, sf)), 13)
    o = P.ordered()
    back = lambda n: F.col("close") / F.lag("close", n).over(o) - 1
    w = w.withColumns({"r1": back(1), "r4": back(4), "r13": back(13), "m20": F.col("close") / I.sma("close", 20) - 1, "vr": F.col("volume") / I.sma("volume", 13)})
    f = P.trailing(13)
    w = w.withColumn("v13", F.when(F.count("r1").over(f) == 13, F.stddev_pop("r1").over(f)))
    return w.select("symbol", F.col("trade_date").alias("anchor"), "ordinal", "close", *NAMES, "path", "label_end")


def _prepared(spark, sf):
    t = table(spark, sf)
    done = t.where("path is not null")
    scaler = M.fit_scaler(done, NAMES, ["symbol"])
    return M.transform(M.pack(t, NAMES), scaler, ["symbol"])


@REG.add(
    "feature_scaler",
    "M-01",
    with_views(
        "select s.symbol, "
        + ", ".join(f"{r(f'any_value(m.{n})')} as med_{n}, {r(f'avg(coalesce(t.{n}, m.{n}))')} as mean_{n}, {r(f'stddev_pop(coalesce(t.{n}, m.{n}))')} as scale_{n}" for n in NAMES)
        + " from (select distinct symbol from ftv) s join (select symbol, " + ", ".join(f"quantile_cont({n}, 0.5) as {n}" for n in NAMES) + " from mat group by symbol) m on m.symbol = s.symbol join mat t on t.symbol = s.symbol group by s.symbol",
        **FT, mat="select * from (select *, max(rn) over (partition by symbol) as n from ftv) where rn + 13 <= n",
    ),
)
def _(spark, sf):
    s = M.fit_scaler(table(spark, sf).where("path is not null"), NAMES, ["symbol"])
    cols = [F.col(a)[i].alias(f"{p}_{n}") for i, n in enumerate(NAMES) for a, p in (("medians", "med"), ("means", "mean"), ("scales", "scale"))]
    return s.select("symbol", *cols)


def _weighted(spark, sf):
    z = _prepared(spark, sf).where("path is not null")
    w = pit.overlap_weights(z.select("symbol", "anchor", "label_end"), ["symbol"]).select("symbol", "anchor", "weight")
    return z.join(w, ["symbol", "anchor"]).withColumnRenamed("path", "y")


@REG.add("ridge_models", "M-02 M-09")
def _(spark, sf):
    m = M.ridge_fit(_weighted(spark, sf), ["symbol"], 10.0, len(NAMES), 13)
    return m.select("symbol", "n", cut("norm", 6).alias("norm"), F.array_join(F.transform("intercept", lambda v: F.round(v, 6)), ",").alias("intercept"), F.array_join(F.transform(F.element_at("coefficients", 13), lambda v: F.round(v, 6)), ",").alias("last_coefficients"))


@REG.add("sparse_ridge_models", "M-03")
def _(spark, sf):
    m = M.ridge_fit(_weighted(spark, sf), ["symbol"], 10.0, len(NAMES), 13, l1=0.01)
    zeros = F.aggregate("coefficients", F.lit(0), lambda a, row: a + F.size(F.filter(row, lambda v: v == 0)))
    return m.select("symbol", "n", "norm", zeros.alias("zero_coefficients"))


@REG.add("ridge_forecasts", "M-07 M-02 L-07")
def _(spark, sf):
    z = _prepared(spark, sf)
    m = M.ridge_fit(_weighted(spark, sf), ["symbol"], 10.0, len(NAMES), 13)
    p = M.predict(z, m, ["symbol"])
    return L.explode_path(p, ["symbol", "anchor"], "expected", value="expected")


@REG.add("two_stage_forecasts", "M-04")
def _(spark, sf):
    t = _weighted(spark, sf)
    t = t.withColumns({"zw": F.slice("z", 1, 4), "zd": F.slice("z", 5, 2)})
    out = M.two_stage_fit(t, ["symbol"], 4, 2, 13)
    return out.select("symbol", "anchor", F.element_at("weekly_path", 1).alias("weekly_1"), F.element_at("daily_correction", 1).alias("correction_1"), F.element_at("expected", 13).alias("expected_13"))


@REG.add("boosted_stumps", "M-05 K-07")
def _(spark, sf):
    t = _prepared(spark, sf).where("path is not null").select("symbol", F.col("anchor").alias("id"), "z", F.col("path").alias("residual"))
    stumps, _rows = M.fit_stumps(t, ["symbol"], len(NAMES), 13, rounds=2)
    return stumps.select("symbol", "round", "feature", "threshold", "gain")


@REG.add(
    "screened_features",
    "K-07",
    with_views(
        "select symbol, feature, score, rk as \"rank\" from (select symbol, feature, " + r("abs(sum(x * y))") + " as score, row_number() over (partition by symbol order by abs(sum(x * y)) desc, feature) as rk from (unpivot (select symbol, trade_date, lead(close, 13) over " + OW + " / close - 1 as y, " + ", ".join(NAMES) + " from ftv) on " + ", ".join(NAMES) + " into name feature value x) where y is not null group by symbol, feature) where rk <= 3",
        **FT,
    ),
)
def _(spark, sf):
    from barloom.operators.sampling import top_features

    t = table(spark, sf).withColumn("y", F.element_at("path", 13)).where("y is not null")
    long = P.unpivot(t.select("symbol", "anchor", "y", *NAMES), ["symbol", "anchor", "y"], NAMES, "feature", "x").where("x is not null")
    return top_features(long, 3, ["symbol"])


@REG.add(
    "late_fusion",
    "M-06",
    with_views(
        f"""select a.symbol, {day('a.trade_date')} as anchor, a.step, {r('a.ret * (1 - case a.step when 1 then 0.6 when 2 then 0.4 when 3 then 0.2 else 0 end) + b.ret * case a.step when 1 then 0.6 when 2 then 0.4 when 3 then 0.2 else 0 end')} as fused
        from lp a join lp b on b.symbol = a.symbol and b.rn = a.rn - 13 and b.step = a.step""",
        **LP,
    ),
)
def _(spark, sf):
    t = table(spark, sf).where("path is not null")
    old = t.select("symbol", (F.col("ordinal") + 13).alias("ordinal"), "path")
    f = M.late_fusion(t.select("symbol", "ordinal", "path"), old, ["symbol", "ordinal"], [0.6, 0.4, 0.2])
    return L.explode_path(f.join(t.select("symbol", "ordinal", "anchor"), ["symbol", "ordinal"]), ["symbol", "anchor"], "fused", value="fused")


@REG.add("out_of_distribution_scores", "M-08")
def _(spark, sf):
    t = table(spark, sf).where("v13 is not null and r13 is not null")
    fit = M.ood_fit(t, NAMES, ["symbol"])
    return M.ood_score(t, fit, NAMES, ["symbol"]).select("symbol", "anchor", "outside_share", "robust_z_max", "distance", "ood_score")


@REG.add(
    "purged_folds",
    "M-10",
    with_views(
        f"""select symbol, fold, count(*) as n, min(trade_date)::varchar as fold_start, any_value(tr) as training_rows from (
          select f.symbol, f.fold, f.trade_date, (select count(*) from lb z where z.symbol = f.symbol and z.e < f.fs and z.trade_date < f.fs) as tr from (
            select *, min(trade_date) over (partition by symbol, fold) as fs from (select *, ntile(5) over (partition by symbol order by trade_date) as fold from lb where k - 1 >= greatest(52, floor(n / 3)))) f) group by symbol, fold""",
        lb=f"select *, row_number() over (partition by symbol order by trade_date) as k, count(*) over (partition by symbol) as n from (select symbol, trade_date, lead(trade_date, 13) over {OW} as e from w) where e is not null",
    ),
)
def _(spark, sf):
    t = table(spark, sf).where("label_end is not null").select("symbol", "anchor", "label_end")
    f = M.purged_folds(t)
    tr = M.training_rows(f).groupBy("symbol", F.col("for_fold").alias("fold")).agg(F.count("*").alias("training_rows"))
    v = f.where("fold is not null").groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("anchor").alias("fold_start"))
    return v.join(tr, ["symbol", "fold"])


@REG.add(
    "training_windows",
    "M-11",
    with_views(
        """select symbol, mode, count(*) as n, min(trade_date)::varchar as first_anchor from (
          select symbol, trade_date, mode, row_number() over (partition by symbol, mode order by trade_date desc) as k, lim from w, (values ('ROLLING_5Y', 260), ('ROLLING_10Y', 520), ('EXPANDING', 100000)) ms(mode, lim) where trade_date < date '2001-06-30') where k <= lim group by symbol, mode"""
    ),
)
def _(spark, sf):
    t = V.bars_weekly(spark, sf).select("symbol", F.col("trade_date").alias("anchor"))
    parts = [M.training_window(t, m, "2001-06-30").withColumn("mode", F.lit(m)) for m in M.WINDOWS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("symbol", "mode").agg(F.count("*").alias("n"), F.min("anchor").alias("first_anchor"))


@REG.add(
    "independent_windows",
    "A-21",
    with_views(
        """select symbol, max(c) as independent from gr group by symbol""",
        lb=f"select * from (select symbol, trade_date as s, lead(trade_date, 13) over {OW} as e from w) where e is not null",
        gr="""
  select symbol, min(e) as last, 1::bigint as c from lb group by symbol
  union all
  select g.symbol, (select min(z.e) from lb z where z.symbol = g.symbol and z.s >= g.last) as last, g.c + 1 from gr g where exists (select 1 from lb z where z.symbol = g.symbol and z.s >= g.last)""",
    ),
)
def _(spark, sf):
    t = table(spark, sf).where("label_end is not null")
    return M.independent_windows(t, ["symbol"])


# ---- calibration ----------------------------------------------------------------------

@REG.add(
    "temperature_calibration",
    "M-14",
    with_views(
        """select symbol, h, round(0.25 + 0.005 * arg_min(i, (round(loss, 12), i)), 6) as temperature, n from (
          select symbol, h, i, avg(-ln(greatest(exp((lk - m) / t) / (exp((lu - m) / t) + exp((ls - m) / t) + exp((ld - m) / t)), 1e-12))) as loss, count(*) as n from (
            select symbol, h, i, 0.25 + 0.005::double * i as t, lu, ls, ld, greatest(lu, ls, ld) as m, case when actual > 0.05 then lu when actual < -0.05 then ld else ls end as lk from (
              select *, ln(least(1, greatest(1e-9, p_up))) as lu, ln(least(1, greatest(1e-9, p_side))) as ls, ln(least(1, greatest(1e-9, p_down))) as ld from fc where actual is not null), range(0, 751) g(i)) group by symbol, h, i)
        group by symbol, h, n"""
    ),
)
def _(spark, sf):
    return C.calibrate_temperature(scored(spark, sf), ["symbol", "h"]).select("symbol", "h", "temperature", "n")


def _lg(p):
    return f"ln(greatest(1e-6, least(1 - 1e-6, {p})) / (1 - greatest(1e-6, least(1 - 1e-6, {p}))))"


def _fits_sql(tag: str, source: str) -> dict[str, str]:
    """Counts, Platt models and isotonic pools per (symbol, h) of rows (symbol, h, p_up, hit)."""
    sums = lambda e: f"list_sum([({e}) for j in range(1, len(xs) + 1)])"
    mu, w = "1 / (1 + exp(-(a * xs[j] + b)))", "ns[j] * greatest(1e-9, least(1, m[j] * (1 - m[j])))"
    return {
        f"{tag}c": f"select symbol, h, p_up as p, count(*) as n, sum(hit) as hits from {source} group by all",
        f"{tag}l": f"select symbol, h, list({_lg('p')} order by p) as xs, list(n order by p) as ns, list(hits order by p) as hs from {tag}c group by all",
        f"{tag}n": f"""
  select symbol, h, xs, ns, hs, 0.0::double as a, 0.0::double as b, 0 as i from {tag}l
  union all
  select symbol, h, xs, ns, hs, a + (gx * h1 - g1 * hx) / (hxx * h1 - hx * hx), b + (g1 * hxx - gx * hx) / (hxx * h1 - hx * hx), i + 1 from (
    select *, {sums('(hs[j] - ns[j] * m[j]) * xs[j]')} as gx, {sums('hs[j] - ns[j] * m[j]')} as g1, {sums(f'{w} * xs[j] * xs[j]')} + 1e-9 as hxx, {sums(f'{w} * xs[j]')} as hx, {sums(w)} + 1e-9 as h1
    from (select *, [{mu} for j in range(1, len(xs) + 1)] as m from {tag}n where i < 40))""",
        f"{tag}q": f"select symbol, h, p, sum(n) over o as tn, sum(hits) over o as ts from {tag}c window o as (partition by symbol, h order by p)",
        f"{tag}z": f"select symbol, h, p, tn, ts from {tag}q union all select distinct symbol, h, -1, 0, 0 from {tag}q",
        f"{tag}t": f"""select i.symbol, i.h, i.p, i.tn, i.ts from {tag}q i join {tag}z a on a.symbol = i.symbol and a.h = i.h and a.tn <> i.tn group by all
      having coalesce(max((i.ts - a.ts)::double / (i.tn - a.tn)) filter (a.tn < i.tn) <= min((a.ts - i.ts)::double / (a.tn - i.tn)) filter (a.tn > i.tn), true)""",
        f"{tag}i": f"select symbol, h, p as x, (ts - coalesce(lag(ts) over o, 0))::double / (tn - coalesce(lag(tn) over o, 0)) as level, tn - coalesce(lag(tn) over o, 0) as n from {tag}t window o as (partition by symbol, h order by p)",
    }


_HITS = {"fh": "select symbol, h, p_up, (actual > 0.05)::int as hit from fc where actual is not null"}


@REG.add(
    "platt_models",
    "M-13",
    with_views(f"select symbol, h, {r('a', 4)} as a, {r('b', 4)} as b from ptn where i = 40", **_HITS, **_fits_sql("pt", "fh")),
)
def _(spark, sf):
    m = C.platt_models(C.outcome_counts(scored(spark, sf), ["symbol", "h"]), ["symbol", "h"])
    return m.select("symbol", "h", cut("a", 4).alias("a"), cut("b", 4).alias("b"))


@REG.add(
    "isotonic_models",
    "M-12",
    with_views(f"select symbol, h, {r('x')} as x, {r('level')} as level, n::bigint as n from pti", **_HITS, **_fits_sql("pt", "fh")),
)
def _(spark, sf):
    return C.isotonic_models(C.outcome_counts(scored(spark, sf), ["symbol", "h"]), ["symbol", "h"])


_SELECTED = {
    "se": "select * from (select *, row_number() over (partition by symbol, h order by anchor desc) as k, count(*) over (partition by symbol, h) as m from fc where actual is not null) where k <= 30",
    "sf": "select symbol, h, p_up, (actual > 0.05)::int as hit from se where least(m, 30) - k + 1 <= 25",
    **_fits_sql("st", "sf"),
    "ie": "select *, lead(x) over o as x1, lead(level) over o as y1, first_value(level) over o as y0 from sti window o as (partition by symbol, h order by x)",
    "i0": "select distinct symbol, h, y0 from ie",
}


def _candidates_sql(rows: str) -> dict[str, str]:
    """Class probabilities of the three methods for rows of forecasts, with the models fitted on ``sf``."""
    q = [f"1 / (1 + exp(-{_lg(c)}))" for c in ("p_up", "p_side", "p_down")]
    spread = lambda up: f"[{up}, p_side / greatest(p_side + p_down, 1e-9) * (1 - {up}), greatest(0, 1 - {up} - p_side / greatest(p_side + p_down, 1e-9) * (1 - {up}))]"
    clipped = lambda e: f"greatest(1e-6, least(1 - 1e-6, {e}))"
    return {
        "cd": f"""select *, [{q[0]} / ({' + '.join(q)}), {q[1]} / ({' + '.join(q)}), {q[2]} / ({' + '.join(q)})] as c1, {spread('u2')} as c2, {spread('u3')} as c3 from (
      select v.*, {clipped(f"1 / (1 + exp(-(l.a * {_lg('v.p_up')} + l.b)))")} as u2, {clipped("case when e.x is null then i0.y0 when e.x1 is null then e.level else e.level + (v.p_up - e.x) / greatest(e.x1 - e.x, 1e-12) * (e.y1 - e.level) end")} as u3
      from {rows} v asof left join ie e on e.symbol = v.symbol and e.h = v.h and v.p_up >= e.x join i0 on i0.symbol = v.symbol and i0.h = v.h join (select * from stn where i = 40) l on l.symbol = v.symbol and l.h = v.h)""",
    }


_loss = lambda c: f"avg(0.5 * (pow({c}[1] - ({_CLASS} = 'UP')::int, 2) + pow({c}[2] - ({_CLASS} = 'SIDEWAYS')::int, 2) + pow({c}[3] - ({_CLASS} = 'DOWN')::int, 2)))"
_PICKED = {
    "va": "select * from se where least(m, 30) - k + 1 > 25",
    **_candidates_sql("va"),
    "sc": f"select symbol, h, list_min([{{'score': round({_loss('c1')}, 12), 'place': 0, 'method': 'TEMPERATURE'}}, {{'score': round({_loss('c2')}, 12), 'place': 1, 'method': 'PLATT'}}, {{'score': round({_loss('c3')}, 12), 'place': 2, 'method': 'ISOTONIC'}}]) as b from cd group by all",
}


@REG.add(
    "selected_calibrators",
    "M-12 M-13 M-15",
    with_views(f"select g.symbol, g.h, coalesce(b.method, 'TEMPERATURE') as method, {r('b.score')} as holdout_score, g.n from (select symbol, h, count(*) as n from se group by all) g left join sc on sc.symbol = g.symbol and sc.h = g.h", **_SELECTED, **_PICKED),
)
def _(spark, sf):
    return C.select_calibrator(scored(spark, sf), ["symbol", "h"]).methods


_ALL_ROWS = _candidates_sql("fcn")["cd"]


@REG.add(
    "calibrated_probabilities",
    "M-15 F-06",
    with_views(
        f"""select x.symbol, {day('x.anchor')} as anchor, x.h, {r('c[1]')} as c_up, {r('c[2]')} as c_side, {r('c[3]')} as c_down from (
          select al.*, case coalesce(b.method, 'TEMPERATURE') when 'PLATT' then c2 when 'ISOTONIC' then c3 else c1 end as c from al left join sc on sc.symbol = al.symbol and sc.h = al.h) x""",
        **_SELECTED, **_PICKED, fcn="select * from fc where actual is not null", al=_ALL_ROWS,
    ),
)
def _(spark, sf):
    s = scored(spark, sf)
    return C.apply_calibrator(s, C.select_calibrator(s, ["symbol", "h"]), ["symbol", "h"]).select("symbol", "anchor", "h", "c_up", "c_side", "c_down")


@REG.add(
    "brier_temperatures",
    "M-14 F-06",
    with_views(f"select symbol, h, {r('case when n < 30 then 1 else greatest(0.5, least(2, 1 + 0.5 * (1 - least(1, greatest(0, b / 0.25))))) end')} as temperature from (select symbol, h, avg({_HALF}) as b, count(*) as n from fc where actual is not null group by symbol, h)"),
)
def _(spark, sf):
    g = scored(spark, sf).groupBy("symbol", "h").agg(F.avg(L.brier("p_up", "p_side", "p_down", "actual_class")).alias("b"), F.count("*").alias("n"))
    return g.select("symbol", "h", C.temperature_from_brier("b", "n").alias("temperature"))


@REG.add("calibrator_table", "M-38 A-21")
def _(spark, sf):
    s = scored(spark, sf).withColumn("available", F.date_add("anchor", 7 * F.col("h")))
    eff = M.independent_windows(s.select("symbol", "h", "anchor", F.col("available").alias("label_end")), ["symbol", "h"])
    c = C.fit_calibrators(s, ["symbol", "h"], eff)
    return c.select("symbol", "h", "status", "temperature", "n", "independent", "effective_from")


@REG.add(
    "temperature_scaled",
    "F-06",
    with_views(
        f"""select symbol, {day('anchor')} as anchor, h, {r('u / (u + s + d)')} as q_up, {r('d / (u + s + d)')} as q_down from (
          select symbol, anchor, h, pow(greatest(p_up, 1e-9), 0.5) as u, pow(greatest(p_side, 1e-9), 0.5) as s, pow(greatest(p_down, 1e-9), 0.5) as d from fc)"""
    ),
)
def _(spark, sf):
    from barloom.functions import arrays as A

    f = V.forecasts(V.bars_weekly(spark, sf)).withColumn("q", A.temperature_scale(F.array("p_up", "p_side", "p_down"), 2.0))
    return f.select("symbol", "anchor", "h", F.col("q")[0].alias("q_up"), F.col("q")[2].alias("q_down"))


# ---- scenarios --------------------------------------------------------------------------

NS, SEED = 60, 341


def _fan_inputs(spark, sf):
    """Forecast = the previous 13-week path, residuals = its later log errors, at every anchor."""
    t = table(spark, sf).where("path is not null").select("symbol", "ordinal", "path")
    old = t.select("symbol", (F.col("ordinal") + 13).alias("ordinal"), F.col("path").alias("predicted"))
    e = L.residual_records(t.join(old, ["symbol", "ordinal"]).withColumn("sigma", F.lit(0.5)), "predicted", "path", "sigma")
    pool = SC.number_pool(e.select("symbol", "ordinal", F.col("standardised").alias("residual")), ["symbol"], ["ordinal"])
    fc = t.select("symbol", F.col("ordinal").alias("anchor"), "path", F.lit(0.1).alias("sigma"))
    return fc, pool


FAN = {
    "pool": """select a.symbol, a.rn, a.step, (ln(1 + a.ret) - ln(1 + b.ret)) / 0.5 as res, dense_rank() over (partition by a.symbol order by a.rn) - 1 as idx from lp a join lp b on b.symbol = a.symbol and b.rn = a.rn - 13 and b.step = a.step""",
    "fan": f"""select f.symbol, f.rn as anchor, f.sc as scenario, f.idx as pool_idx, p.step, exp(ln(1 + p.ret) + q.res * 0.1) - 1 as ret from (
      select d.symbol, d.rn, i as sc, ('0x' || md5('{SEED}:' || d.symbol || ':' || d.rn || ':' || i)[1:8])::bigint % n.n as idx from (select distinct symbol, rn from lp) d, range(0, {NS}) g(i), (select symbol, max(idx) + 1 as n from pool group by symbol) n where n.symbol = d.symbol) f
      join lp p on p.symbol = f.symbol and p.rn = f.rn join pool q on q.symbol = f.symbol and q.idx = f.idx and q.step = p.step""",
    "fq": "select symbol, anchor, step, quantile_cont(ret, 0.1) as p10, quantile_cont(ret, 0.5) as p50, quantile_cont(ret, 0.9) as p90, stddev_pop(ret) as dev from fan group by all",
}


@REG.add("scenario_fan", "M-16", with_views(f"select symbol, anchor, scenario, pool_idx, {r('ret')} as terminal from fan where step = 13", **LP, **FAN))
def _(spark, sf):
    fan = SC.scenario_fan(*_fan_inputs(spark, sf), NS, SEED)
    return fan.select("symbol", "anchor", "scenario", "pool_idx", F.element_at("scenario_path", 13).alias("terminal"))


@REG.add("fan_quantiles", "M-16", with_views(f"select symbol, anchor, step, {r('p10')} as p10, {r('p50')} as p50, {r('p90')} as p90, {r('dev')} as deviation from fq", **LP, **FAN))
def _(spark, sf):
    return SC.fan_quantiles(SC.scenario_fan(*_fan_inputs(spark, sf), NS, SEED))


@REG.add("stratified_fan", "M-16 F-14")
def _(spark, sf):
    fc, pool = _fan_inputs(spark, sf)
    pool = pool.withColumn("stratum", F.when(F.col("pool_idx") % 3 == 0, 1).otherwise(0)).drop("pool_idx", "pool_size")
    pool = SC.number_pool(pool, ["symbol", "stratum"], ["ordinal"])
    fan = SC.stratified_fan(fc, pool, NS, SEED, [0.7, 0.3])
    return fan.groupBy("symbol", "anchor", "stratum").agg(F.count("*").alias("draws"), F.avg(F.element_at("scenario_path", 13)).alias("mean_terminal"))


@REG.add(
    "representative_scenarios",
    "M-18",
    with_views(
        f"""select symbol, anchor, arg_min(scenario, (round(d, 9), scenario)) as scenario, {r('min(d)')} as distance from (
          select f.symbol, f.anchor, f.scenario, sum(pow((f.ret - q.p50) / greatest(q.dev, 1e-9), 2)) as d from fan f join fq q on q.symbol = f.symbol and q.anchor = f.anchor and q.step = f.step group by all) group by symbol, anchor""",
        **LP, **FAN,
    ),
)
def _(spark, sf):
    fan = SC.scenario_fan(*_fan_inputs(spark, sf), NS, SEED)
    return SC.representative(fan, SC.fan_quantiles(fan))


@REG.add(
    "horizon_probabilities",
    "M-19",
    with_views(f"select symbol, anchor, step as h, {r('avg((ret > 0.05)::int)')} as p_up, {r('avg((ret between -0.05 and 0.05)::int)')} as p_side, {r('avg((ret < -0.05)::int)')} as p_down from fan where step in (4, 8, 13) group by all", **LP, **FAN),
)
def _(spark, sf):
    return SC.horizon_probs(SC.scenario_fan(*_fan_inputs(spark, sf), NS, SEED), (4, 8, 13), 0.05)


@REG.add("normal_probabilities", "M-19 F-05")
def _(spark, sf):
    f = V.forecasts(V.bars_weekly(spark, sf))
    p = SC.normal_probs("p50", F.col("p90") - F.col("p10"), 0.05)
    return f.select("symbol", "anchor", "h", *[v.alias(f"n{k[1:]}") for k, v in p.items()])


_SHAPE = "case when abs(t) <= 0.2 and hi - lo <= 0.6 then 'RANGE' when li <= 6 and t - lo > 0.4 then 'V_SHAPE' when hj <= 6 and hi - t > 0.4 then 'INVERTED_V' when t > 0 then 'TREND_UP' else 'TREND_DOWN' end"
_FS = {"fs": "select symbol, anchor, scenario, arg_max(ret, step) as t, min(ret) as lo, max(ret) as hi, arg_min(step, (ret, step)) as li, arg_min(step, (-ret, step)) as hj from fan group by all"}


@REG.add(
    "path_shape_distribution",
    "M-20 F-10",
    with_views(f"select symbol, anchor, shape, n, {r('n / sum(n) over (partition by symbol, anchor)')} as share from (select symbol, anchor, {_SHAPE} as shape, count(*) as n from fs group by all)", **LP, **FAN, **_FS),
)
def _(spark, sf):
    return SC.path_distribution(SC.scenario_fan(*_fan_inputs(spark, sf), NS, SEED), 0.2)[0]


@REG.add(
    "turn_week_windows",
    "M-20",
    with_views(
        f"""select symbol, anchor, min(week) as start_week, max(week) as end_week, {r('sum(n) / any_value(a)')} as coverage from (
          select *, coalesce(sum(n) over (partition by symbol, anchor order by n desc, week desc rows between unbounded preceding and 1 preceding), 0) as b, sum(n) over (partition by symbol, anchor) as a from (select symbol, anchor, li as week, count(*) as n from fs group by all)) where b < ceil(a * 0.6) group by symbol, anchor""",
        **LP, **FAN, **_FS,
    ),
)
def _(spark, sf):
    return SC.path_distribution(SC.scenario_fan(*_fan_inputs(spark, sf), NS, SEED), 0.2)[1]


@REG.add("scenario_bars", "M-17")
def _(spark, sf):
    fc, pool = _fan_inputs(spark, sf)
    w = B.bar_context(V.bars_weekly(spark, sf))
    base = w.select("symbol", F.col("ordinal").alias("anchor"), F.col("close").alias("base_close"), F.col("volume").alias("base_volume"))
    bars = SC.scenario_bars(SC.scenario_fan(fc, pool, NS, SEED), base, SC.bar_shapes(w), SEED)
    return bars.groupBy("symbol", "anchor", "step").agg(F.count("*").alias("n"), F.count_if("legal").alias("legal"), F.avg("close").alias("close"), F.avg(F.log("volume")).alias("log_volume"))


@REG.add(
    "macd_continuation",
    "M-21 W-04",
    with_views(
        f"select symbol, anchor, step, {r('dif')} as dif, {r('dea0')} as dea, {r('2 * (dif - dea0)')} as hist from wa where step > 0", **{k: _WIN[k] for k in ("win", "we", "wd", "wa")}
    ),
)
def _(spark, sf):
    win = TU.anchor_windows(V.bars_weekly(spark, sf), EVERY, BACK, AHEAD).select("symbol", "anchor", "step", "close")
    return I.macd(win, signal_seed="zero", by=TU.PATH, t="step").where("step > 0").select("symbol", "anchor", "step", "dif", "dea", "hist")


DRAWS = 200
_BOOT = {
    "df0": f"""select x.symbol, x.anchor, x.h, {_WIS.replace('actual', 'x.actual').replace('p50', 'y.p50').replace('p10', 'y.p10').replace('p90', 'y.p90')} - {_WIS.replace('actual', 'x.actual').replace('p50', 'x.p50').replace('p10', 'x.p10').replace('p90', 'x.p90')} as v from fc x join fc26 y on y.symbol = x.symbol and y.anchor = x.anchor and y.h = x.h where x.h = 13 and x.actual is not null""",
    "dv": "select *, year(anchor) as fold, row_number() over (partition by symbol, year(anchor) order by anchor) - 1 as i, count(*) over (partition by symbol, year(anchor)) as n from df0",
    "pk": f"""select f.symbol, f.fold, d, s, n, ('0x' || md5('7:' || f.symbol || ':' || f.fold || ':' || d || ':' || s)[1:8])::bigint % (n - 7) as st, case when s = floor((n - 1) / 8) then n - s * 8 else 8 end as len from (select distinct symbol, fold, n from dv where n >= 8) f, range(0, {DRAWS}) a(d), range(0, 20) b(s) where s <= floor((n - 1) / 8)""",
    "bm": "select p.symbol, p.d, sum(v.v) / any_value(z.a) as mean from pk p join dv v on v.symbol = p.symbol and v.fold = p.fold and v.i >= p.st and v.i < p.st + p.len join (select symbol, sum(n) as a from (select distinct symbol, fold, n from dv where n >= 8) group by symbol) z on z.symbol = p.symbol group by p.symbol, p.d",
}


def _paired(spark, sf):
    w = V.bars_weekly(spark, sf)
    a, b = V.forecasts(w, 52), V.forecasts(w, 26)
    cols = ["p10", "p50", "p90", "p_up", "p_side", "p_down", "actual"]
    j = pit.pair_models(a, b, ["symbol", "anchor", "h"], cols).where("champion_actual is not null")
    loss = lambda s: L.weighted_interval(f"{s}_p10", f"{s}_p50", f"{s}_p90", "champion_actual")
    inside = lambda s: F.col("champion_actual").between(F.col(f"{s}_p10"), F.col(f"{s}_p90"))
    return j.withColumns({"champion_loss": loss("champion"), "candidate_loss": loss("candidate"), "champion_inside": inside("champion"), "candidate_inside": inside("candidate")})


def _interval(spark, sf):
    d = _paired(spark, sf).where("h = 13").select("symbol", "anchor", F.year("anchor").alias("fold"), (F.col("candidate_loss") - F.col("champion_loss")).alias("diff"))
    return SC.block_bootstrap(d, 8, DRAWS, 7, ["symbol"])


@REG.add(
    "block_bootstrap",
    "M-22 J-12",
    with_views(f"select symbol, {r('quantile_cont(mean, 0.05)')} as low, {r('quantile_cont(mean, 0.95)')} as high, {r('avg(mean)')} as centre, count(*) as draws from bm group by symbol", **_BOOT),
)
def _(spark, sf):
    return _interval(spark, sf)


@REG.add(
    "paired_model_losses",
    "J-12 L-11",
    with_views(f"select symbol, h, count(*) as n, {r('avg(a)')} as champion_loss, {r('avg(b)')} as candidate_loss, {r('avg((b < a)::int)')} as win_rate from pl group by symbol, h",
        pl=f"""select x.symbol, x.h, {_WIS.replace('actual', 'x.actual').replace('p50', 'x.p50').replace('p10', 'x.p10').replace('p90', 'x.p90')} as a, {_WIS.replace('actual', 'x.actual').replace('p50', 'y.p50').replace('p10', 'y.p10').replace('p90', 'y.p90')} as b from fc x join fc26 y on y.symbol = x.symbol and y.anchor = x.anchor and y.h = x.h where x.actual is not null"""),
)
def _(spark, sf):
    return _paired(spark, sf).groupBy("symbol", "h").agg(
        F.count("*").alias("n"), F.avg("champion_loss").alias("champion_loss"), F.avg("candidate_loss").alias("candidate_loss"), F.avg((F.col("candidate_loss") < F.col("champion_loss")).cast("double")).alias("win_rate")
    )


@REG.add("promotion_gates", "M-23")
def _(spark, sf):
    p = _paired(spark, sf).where("h = 13")
    up = lambda s: (F.col(f"{s}_p50") > 0) == (F.col("champion_actual") > 0)
    p = p.withColumns({"champion_shape_hit": up("champion"), "candidate_shape_hit": up("candidate"), "norm_ratio": F.lit(1.0)})
    g = G.promotion_gate(p, _interval(spark, sf), ["symbol"])
    return g.select("symbol", "improvement", "worst_degradation", "improved_share", "candidate_coverage", "bootstrap_high", F.array_join("failed", ",").alias("failed"), "promoted")


# ---- windows, behaviour, health ----------------------------------------------------------------

_WINDOWS = """select symbol, ws as window_start, max(trade_date) as window_end, product(1 + pa * x) - 1 as ra, product(1 + pb * x) - 1 as rb, avg(pa) * 100 as posa, avg(pb) * 100 as posb, max(pa) < 0.1 as noa, max(pb) < 0.1 as nob,
    min(least(0, pa * x)) as da, min(least(0, pb * x)) as db from (select a.symbol, a.rn as ws, b.trade_date, b.x, b.pa, b.pb from sg a join sg b on b.symbol = a.symbol and b.rn between a.rn and a.rn + 7 join (select symbol, max(rn) as n from sg group by symbol) z on z.symbol = a.symbol where a.rn + 7 <= z.n) group by symbol, ws"""
_SG = f"""select *, case when pc > pm then 0.8::double else 0.2::double end as pa, case when pc > pm20 then 0.6::double else 0.05::double end as pb from (
  select symbol, trade_date, row_number() over {OW} as rn, close / pc - 1 as x, pc, pm, pm20 from (select *, lag(close) over {OW} as pc, lag(ma10) over {OW} as pm, lag(ma20) over {OW} as pm20 from (
    select *, avg(close) over (partition by symbol order by trade_date rows between 9 preceding and current row) as ma10, avg(close) over (partition by symbol order by trade_date rows between 19 preceding and current row) as ma20 from w)) where pc is not null)"""


def _two_accounts(spark, sf):
    """Two rule accounts over the same weeks and their matched 8-week windows."""
    o = P.ordered()
    w = V.bars_weekly(spark, sf).withColumns({"_m10": I.sma("close", 10), "_m20": I.sma("close", 20)})
    pc = F.lag("close").over(o)
    w = w.withColumns({"x": F.col("close") / pc - 1, "pa": F.when(pc > F.lag("_m10").over(o), 0.8).otherwise(0.2), "pb": F.when(pc > F.lag("_m20").over(o), 0.6).otherwise(0.05)}).where("x is not null")
    p = LG.window_panel(w.select("symbol", "trade_date", "x", "pa", "pb"), 8)
    side = lambda s, c: {
        f"{s}_return": F.product(1 + F.col(c) * F.col("x")) - 1, f"{s}_drawdown": -F.min(F.least(F.lit(0.0), F.col(c) * F.col("x"))), f"{s}_position": F.avg(c) * 100, f"{s}_no_action": F.max(c) < 0.1,
    }
    cols = {**side("champion", "pa"), **side("candidate", "pb")}
    g = p.groupBy("symbol", "window_start").agg(F.min("trade_date").alias("anchor"), F.max("trade_date").alias("window_end"), *[v.alias(k) for k, v in cols.items()])
    return g.withColumns({"champion_profit": F.col("champion_return") * 1000, "candidate_profit": F.col("candidate_return") * 1000})


@REG.add(
    "window_comparison",
    "M-40 J-12",
    with_views(
        f"""select symbol, count(*) as windows, {r('avg(rb - ra)')} as mean_excess, {r('quantile_cont(rb * 1000, 0.5) - quantile_cont(ra * 1000, 0.5)')} as median_profit_excess, {r('avg((rb > ra)::int)')} as win_rate, {r('max(-db + da)')} as drawdown_degradation,
          {r('avg(posb) / 100')} as participation, {r('avg(posa) / 100')} as champion_participation, {r('avg(nob::int)')} as no_action_ratio from wp group by symbol""",
        sg=_SG, wp=_WINDOWS,
    ),
)
def _(spark, sf):
    return G.compare_windows(_two_accounts(spark, sf), ["symbol"])


@REG.add("promotion_channels", "M-24 M-40 A-21")
def _(spark, sf):
    w = _two_accounts(spark, sf)
    eff = M.independent_windows(w.select("symbol", "anchor", F.col("window_end").alias("label_end")), ["symbol"]).withColumnRenamed("independent", "effective_windows")
    c = G.compare_windows(w, ["symbol"]).join(eff, "symbol").withColumns({"trade_ratio": F.lit(0.2), "quality_ok": ~F.col("symbol").startswith("R")})
    return G.promotion_channel(c).select("symbol", "channel", "effective_windows", F.array_join("reason_codes", ",").alias("reason_codes"), "excess_gap", "win_rate_gap", "drawdown_gap")


@REG.add(
    "external_weight_gate",
    "M-34",
    with_views(
        f"""select symbol, matched, {r('ex')} as excess, {r('pd')} as participation_diff, (matched > 0 and (neg >= 4 or pd <= -0.05))::bigint as degraded,
          case when matched > 0 and (neg >= 4 or pd <= -0.05) then 10 else 40 end::bigint as weight_cap from (
          select symbol, count(*) as matched, avg(rb - ra) as ex, avg(posb - posa) as pd, count(*) filter (k <= 4 and rb < ra) as neg from (select *, row_number() over (partition by symbol order by window_end desc) as k from wp) group by symbol)""",
        sg=_SG, wp=_WINDOWS,
    ),
)
def _(spark, sf):
    w = _two_accounts(spark, sf)
    scores = scored(spark, sf).where("h = 8").groupBy("symbol").agg(
        F.avg(L.brier("p_up", "p_side", "p_down", "actual_class")).alias("external_brier"), F.lit(0.3).alias("local_brier"), F.avg(F.abs(F.col("p50") - F.col("actual"))).alias("external_mae"), F.lit(0.5).alias("local_mae"), F.count("*").alias("matured")
    )
    return G.weight_gate(w, scores, ["symbol"]).select("symbol", "matched", "excess", "participation_diff", "degraded", "weight_cap")


@REG.add(
    "behavior_differences",
    "M-25 J-12",
    with_views(
        f"""select symbol, {r('fr')} as forecast_ratio, {r('sr')} as score_ratio, {r('br')} as base_ratio, {r('tr')} as target_ratio, {r('gr')} as signal_ratio, {r('dr')} as trade_ratio, {r('er')} as equity_ratio, n as anchors,
          (tr = 0 and gr = 0 and dr = 0 and er = 0 and worst < 0.01)::bigint as identical, (fr >= 0.1 or sr >= 0.1 or br >= 0.1 or tr >= 0.05 or dr >= 0.03)::bigint as passes_prefilter from (
          select symbol, count(*) as n, avg((abs(ca - cb) > 1e-4)::int) as fr, avg((abs(ra - rb) > 1e-4)::int) as sr, avg((round(posa, -1) <> round(posb, -1))::int) as br, avg((round(posa / 5) <> round(posb / 5))::int) as tr,
            avg((sign(ra) <> sign(rb))::int) as gr, avg((round(posa) <> round(posb))::int) as dr, avg((abs(ra - rb) / greatest(abs(1 + ra), abs(1 + rb), 1e-9) > 1e-9)::int) / 2 as er, max(abs(ra - rb)) as worst
          from (select wi.symbol, wi.ra, wi.rb, wi.posa, wi.posb, x.p50 as ca, y.p50 as cb from wi join sg s on s.symbol = wi.symbol and s.rn = wi.window_start
            join fc x on x.symbol = wi.symbol and x.anchor = s.trade_date and x.h = 8 join fc26 y on y.symbol = wi.symbol and y.anchor = s.trade_date and y.h = 8 where x.actual is not null) group by symbol)""",
        sg=_SG, wi=_WINDOWS,
    ),
)
def _(spark, sf):
    w = _two_accounts(spark, sf)
    f = _paired(spark, sf).where("h = 8").select("symbol", "anchor", "champion_p50", "candidate_p50")
    j = w.join(f, ["symbol", "anchor"])
    arr = lambda *c: F.array(*[F.col(x) for x in c])
    pairs = j.select("symbol", "anchor", *[
        c for s in ("champion", "candidate") for c in (
            arr(f"{s}_p50").alias(f"{s}_path"), F.col(f"{s}_return").alias(f"{s}_score"), F.round(f"{s}_position", -1).alias(f"{s}_base"), F.round(F.col(f"{s}_position") / 5).alias(f"{s}_target"),
            F.signum(f"{s}_return").alias(f"{s}_signal"), F.array(F.round(f"{s}_position")).alias(f"{s}_trades"), F.array(F.lit(1.0), 1 + F.col(f"{s}_return")).alias(f"{s}_equity"))
    ])
    return G.behavior_diff(pairs, ["symbol"])


def _health_rows(spark, sf):
    s = scored(spark, sf).where("h = 13").select("symbol", "anchor", "p_up", "p_down", "actual", "p10", "p90")
    return s.withColumns({"ood_score": F.col("p_up"), "degraded": ~F.col("actual").between(F.col("p10"), F.col("p90"))})


@REG.add(
    "health_states",
    "M-27",
    with_views(
        f"select symbol, {day('anchor')} as anchor, health from hs",
        hi="""select *, row_number() over (partition by symbol order by anchor) as k from (select symbol, anchor, p_up as o, not (actual between p10 and p90) as dg from fc where h = 13 and actual is not null)""",
        hs="""
  select symbol, anchor, k, (o >= 0.5)::int as a, (o <= 0.35)::int as b, dg::int as c, (not dg)::int as e, 'MODEL_NORMAL' as health from hi where k = 1
  union all
  select symbol, anchor, k, a, b, c, e, case when a >= 2 then 'MODEL_OUT_OF_DISTRIBUTION' when prev = 'MODEL_OUT_OF_DISTRIBUTION' and b < 3 then prev when c >= 3 then 'MODEL_DEGRADED' when prev = 'MODEL_DEGRADED' and e < 3 then prev else 'MODEL_NORMAL' end from (
    select n.symbol, n.anchor, n.k, p.health as prev, case when n.o >= 0.5 then p.a + 1 else 0 end as a, case when n.o <= 0.35 then p.b + 1 else 0 end as b, case when n.dg then p.c + 1 else 0 end as c, case when not n.dg then p.e + 1 else 0 end as e
    from hs p join hi n on n.symbol = p.symbol and n.k = p.k + 1)""",
    ),
)
def _(spark, sf):
    return G.health_states(_health_rows(spark, sf)).select("symbol", "anchor", "health")


_PS = f"""select symbol, anchor, row_number() over o as raw_count, avg({_HALF}) over f as rb, avg({_WIS}) over f as rw, avg((actual between p10 and p90)::int) over f as rc, greatest(0, least(1, 1 - avg(abs(p50 - actual) / greatest(p90 - p10, 0.01)) over f)) as rs
  from fc where h = 13 and actual is not null window o as (partition by symbol order by anchor), f as (partition by symbol order by anchor rows between 51 preceding and current row)"""


def _pool(spark, sf):
    s = scored(spark, sf).where("h = 13").withColumns(
        {
            "brier": L.brier("p_up", "p_side", "p_down", "actual_class"), "wis": L.weighted_interval("p10", "p50", "p90", "actual"), "inside": F.col("actual").between(F.col("p10"), F.col("p90")).cast("double"),
            "normalised_error": F.abs(F.col("p50") - F.col("actual")) / F.greatest(F.col("p90") - F.col("p10"), F.lit(0.01)),
        }
    )
    return G.pool_stats(s.withColumnRenamed("anchor", "available"))


@REG.add("residual_pool_stats", "M-37", with_views(f"select symbol, {day('anchor')} as available, raw_count, {r('rb')} as recent_brier, {r('rw')} as recent_wis, {r('rc')} as recent_coverage, {r('rs')} as recent_score from ps", ps=_PS))
def _(spark, sf):
    return _pool(spark, sf).select("symbol", "available", "raw_count", "recent_brier", "recent_wis", "recent_coverage", "recent_score")


@REG.add(
    "reliability_scores",
    "M-28",
    with_views(
        f"""select symbol, {day('anchor')} as available, round(greatest(0, least(100, least(raw, 45, case when raw_count < 30 then 40 else 100 end))), 1) as reliability from (
          select *, 100 * (0.2 * greatest(0, least(1, raw_count / 50.0)) + 0.2 * greatest(0, least(1, 1 - rb / (2.0::double / 3))) + 0.2 * greatest(0, least(1, 0.5 * (1 - least(rw, 2) / 2) + 0.5 * (1 - abs(rc - 0.8) / 0.8))) + 0.15 * rs + 0.15 * 0.9 + 0.1)::double as raw from ps)""",
        ps=_PS,
    ),
)
def _(spark, sf):
    p = _pool(spark, sf).select(
        "symbol", "available", F.col("raw_count").alias("effective_samples"), F.lit("PRELIMINARY").alias("calibration_status"), F.col("recent_brier").alias("brier"), F.col("recent_wis").alias("wis"),
        F.col("recent_coverage").alias("coverage"), "recent_score", F.lit(0.1).alias("ood_score"), F.lit(True).alias("consistent"), F.lit("MODEL_NORMAL").alias("health"),
    )
    return G.reliability(p).select("symbol", "available", "reliability")


@REG.add(
    "indicator_votes",
    "M-29",
    with_views(
        f"""select symbol, {day('trade_date')} as anchor, {r('case when n > 0 then s / n else 0 end')} as vote_balance, n::bigint as vote_count, (fd = 0 or n < 3 or fd * s / nullif(n, 0) >= -0.2)::bigint as consistent from (
          select *, case when r13 > 0.01 then 1 when r13 < -0.01 then -1 else 0 end as fd, coalesce(sign(r1), 0) + coalesce(sign(r4), 0) + coalesce(sign(m20), 0) as s, coalesce((r1 <> 0)::int, 0) + coalesce((r4 <> 0)::int, 0) + coalesce((m20 <> 0)::int, 0) as n from ftv)""",
        **FT,
    ),
)
def _(spark, sf):
    return G.vote_consistency(table(spark, sf), ["r1", "r4", "m20"], "r13").select("symbol", "anchor", "vote_balance", "vote_count", "consistent")


@REG.add(
    "turn_lags",
    "M-36 L-06 W-46",
    with_views(
        """select p.symbol, t.k as kind, quantile_cont(p.ps - t.ts, 0.5) as lag, count(*) as n from (
          select symbol, rn, case when arg_max(ret, step) >= 0 then arg_min(step, (-ret, step)) else arg_min(step, (ret, step)) end as ps, case when arg_max(ret, step) >= 0 then 'top' else 'bottom' end as pk from lp group by symbol, rn) p
        join (select symbol, anchor, min(step) filter (k is not null) as ts, arg_min(k, step) filter (k is not null) as k from (select symbol, anchor, step, case when p < 0 and d1 >= 0 then 'bottom' when p > 0 and d1 <= 0 then 'top' end as k from (select *, lag(d1) over (partition by symbol, anchor order by step) as p from hx where step >= 0)) group by symbol, anchor) t
          on t.symbol = p.symbol and t.anchor = p.rn and t.k = p.pk group by p.symbol, t.k""",
        **LP, **{k: _WIN[k] for k in ("win", "we", "wd", "wa", "hx")},
    ),
)
def _(spark, sf):
    t = table(spark, sf).where("path is not null")
    price = L.label_turns(L.explode_path(t, ["symbol", "ordinal"]), ["symbol", "ordinal"]).withColumnRenamed("ordinal", "anchor")
    win = TU.anchor_windows(V.bars_weekly(spark, sf), EVERY, BACK, AHEAD).select("symbol", "anchor", "step", "close")
    m = I.macd(win, by=TU.PATH, t="step")
    m = m.withColumn("d1", I.diff("dif", 1, TU.PATH, "step"))
    dif = TU.first_turn(m.where("step >= 0"), "d1").select("symbol", "anchor", F.col("turn_step").alias("dif_turn_step"), F.col("turn_kind").alias("dif_turn_kind"))
    return G.turn_lag(price.join(dif, ["symbol", "anchor"]), ["symbol"])


@REG.add(
    "alpha_candidates",
    "M-26",
    "select r_name, k - 1 as candidate, alpha from (select r_name, alpha, row_number() over (partition by r_name order by pos) as k from (select r_name, alpha, min(pos) as pos from (select r_name, pos, round(least(100.0, greatest(0.1, a * m)), 12)::double as alpha from (select r_name, (count(*) % 200 + 1)::double as a from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name), (values (0, 0.5::double), (1, 0.75), (2, 1.0), (3, 1.25), (4, 1.5)) ms(pos, m)) group by r_name, alpha))",
)
def _(spark, sf):
    c, n, rg = (V.table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(rg, n.n_regionkey == rg.r_regionkey)
    m = j.groupBy("r_name").agg((F.count("*") % 200 + 1).cast("double").alias("alpha"))
    return G.alpha_candidates(m, ["r_name"])


@REG.add(
    "weight_transfers",
    "M-26 J-15",
    """select o_custkey, d as donor, rcv as receiver, p as points from (select o_custkey, unnest(['a', 'b', 'c']) as d, unnest([count(*), count(*) filter (o_orderstatus = 'F'), count(*) filter (o_orderstatus = 'O')]) as have from orders group by o_custkey), (values ('a'), ('b'), ('c')) rs(rcv), (values (1), (2)) ps(p)
    where d <> rcv and have - p >= 0 and not (d = 'a' and rcv = 'b' and p = 1 and o_custkey % 2 = 0)""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    w = o.groupBy("o_custkey").agg(F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"), F.count_if(F.col("o_orderstatus") == "O").alias("c"))
    rej = w.where("o_custkey % 2 = 0").select("o_custkey", F.lit("a").alias("donor"), F.lit("b").alias("receiver"), F.lit(1).alias("points"))
    return G.weight_transfers(w, rej, ["o_custkey"], ["a", "b", "c"])


# ---- analogues and corrections --------------------------------------------------------------

_SW = {
    "win": "select symbol, trade_date, rn, close, list_transform(l, lambda x: x / l[1]) as shape from (select *, list(close) over (partition by symbol order by rn rows between 59 preceding and current row) as l from dn) where rn >= 60",
    "sw": """select *, row_number() over (partition by symbol, target order by d, rn) as rk from (
      select t.symbol, t.trade_date as end_date, t.rn as target, t.close as base, e.rn, e.trade_date as match_date, e.close as was, round(list_distance(e.shape, t.shape) / sqrt(60::double), 12) as d from win t join win e on e.symbol = t.symbol and e.rn <= t.rn - 125)""",
}


@REG.add(
    "similar_windows",
    "M-30 J-16 K-02",
    with_views(f"select symbol, {day('end_date')} as end_date, {day('match_date')} as match_date, {r('d')} as distance, rk as \"rank\" from sw where rk <= 5", **_SW),
)
def _(spark, sf):
    return AN.similar_windows(V.bars_daily(spark, sf), 60, 65, 5).select("symbol", "end_date", "match_date", "distance", "rank")


@REG.add(
    "similarity_forecasts",
    "M-30",
    with_views(
        f"""select symbol, {day('end_date')} as end_date, step, {r('base * m')} as predicted, {r('base * greatest(m - s, 0)')} as lower, {r('base * (m + s)')} as upper, n as matches from (
          select sw.symbol, sw.end_date, k.step, max(base) as base, avg(a.close / sw.was) as m, stddev_pop(a.close / sw.was) as s, count(*) as n
          from sw join (select unnest([13, 26, 39, 52, 65]) as step) k on true join dn a on a.symbol = sw.symbol and a.rn = sw.rn + k.step where rk <= 5 group by all)""",
        **_SW,
    ),
)
def _(spark, sf):
    d = V.bars_daily(spark, sf)
    return AN.similarity_forecast(d, AN.similar_windows(d, 60, 65, 5), (13, 26, 39, 52, 65))


AW = {"r4": 4.0, "r13": 2.0, "v13": 1.0, "m20": 3.0}
_HAVE = " and ".join(f"{c} is not null" for c in AW)
_AN = {
    "an": f"""select *, row_number() over (partition by symbol, target order by round(d, 12), rn) as rk from (
      select h.symbol, t.rn as target, t.trade_date, h.rn, {' + '.join(f'{w} * abs(h.{c} - t.{c})' for c, w in AW.items())} as d from (select * from ftv where {_HAVE}) h join (select * from ftv where {_HAVE}) t on t.symbol = h.symbol where h.rn + 13 <= t.rn)""",
}


@REG.add(
    "analogue_forecasts",
    "M-31 J-16 K-02",
    with_views(
        f"""select a.symbol, a.target, p.step, {r('quantile_cont(p.ret, 0.1)')} as p10, {r('quantile_cont(p.ret, 0.5)')} as p50, {r('quantile_cont(p.ret, 0.9)')} as p90, {r('avg(p.ret)')} as expected, {r('avg((p.ret > 0.05)::int)')} as p_up, {r('avg((p.ret < -0.05)::int)')} as p_down, count(*) as analogues
        from an a join lp p on p.symbol = a.symbol and p.rn = a.rn where a.rk <= 40 group by a.symbol, a.target, p.step""",
        **FT, **LP, **_AN,
    ),
)
def _(spark, sf):
    t = table(spark, sf)
    return AN.analogue_forecast(t, t, AW, 40)


_BLEND = "case when n >= 8 then least(0.25, n / 320.0::double) else 0 end"


@REG.add(
    "analogue_quantiles",
    "M-32",
    with_views(
        f"""select symbol, target, step, {r('s[1]')} as p10, {r('s[2]')} as p50, {r('s[3]')} as p90 from (
          select symbol, target, step, list_sort([expected + (1 - b) * (q1 - expected) + b * coalesce(a1, 0), expected + (1 - b) * (q2 - expected) + b * coalesce(a2, 0), expected + (1 - b) * (q3 - expected) + b * coalesce(a3, 0)]) as s from (
            select t.symbol, t.rn as target, m.step, m.expected, m.q1, m.q2, m.q3, z.a1, z.a2, z.a3, {_BLEND} as b from (select * from ftv where {_HAVE}) t join mq m on m.symbol = t.symbol
            left join (select a.symbol, a.target, p.step, quantile_cont(p.ret - m.expected, 0.1) as a1, quantile_cont(p.ret - m.expected, 0.5) as a2, quantile_cont(p.ret - m.expected, 0.9) as a3, count(*) as n
              from an a join lp p on p.symbol = a.symbol and p.rn = a.rn join mq m on m.symbol = a.symbol and m.step = p.step where a.rk <= 40 group by all) z on z.symbol = t.symbol and z.target = t.rn and z.step = m.step))""",
        mq=f"select p.symbol, p.step, avg(ret) as expected, quantile_cont(ret, 0.1) as q1, quantile_cont(ret, 0.5) as q2, quantile_cont(ret, 0.9) as q3 from lp p join (select * from ftv where {_HAVE}) f on f.symbol = p.symbol and f.rn = p.rn group by all",
        **FT, **LP, **_AN,
    ),
)
def _(spark, sf):
    """For every anchor: the symbol's mean path and spread, blended with the residuals of its 40 nearest analogues."""
    t = table(spark, sf).where(" and ".join(f"{c} is not null" for c in AW))
    done = t.where("path is not null")
    paths = L.explode_path(done, ["symbol", "ordinal"])
    mean = paths.groupBy("symbol", "step").agg(F.avg("ret").alias("expected"), F.expr("percentile(ret, array(0.1, 0.5, 0.9))").alias("q"))
    base = mean.select("symbol", "step", "expected", *[(F.col("q")[i] - F.col("expected")).alias(n) for i, n in enumerate(("r10", "r50", "r90"))])
    near = AN.nearest_history(done, t, AW, 40, 13).select("symbol", "target", "ordinal")
    res = near.join(paths.withColumn("ordinal", F.col("ordinal").cast("long")), ["symbol", "ordinal"]).join(base.select("symbol", "step", "expected"), ["symbol", "step"]).select("symbol", "target", "step", (F.col("ret") - F.col("expected")).alias("res"))
    targets = t.select("symbol", F.col("ordinal").cast("long").alias("target"))
    return SC.analogue_quantiles(targets.join(base, "symbol"), res, ("symbol", "target"))


@REG.add(
    "residual_pool_weights",
    "M-33",
    with_views(f"select symbol, {day('trade_date')} as anchor, rk as \"rank\", {r('wt')} as weight, {r('sum(wt) over (partition by symbol order by rk)')} as cum_weight from (select *, pow(0.5, rk / 50.0::double) / sum(pow(0.5, rk / 50.0::double)) over (partition by symbol) as wt from (select *, row_number() over (partition by symbol order by trade_date desc) - 1 as rk from w))"),
)
def _(spark, sf):
    t = V.bars_weekly(spark, sf).select("symbol", F.col("trade_date").alias("anchor"))
    return SC.pool_weights(t, ["symbol"], "anchor")


@REG.add(
    "corrected_paths",
    "M-39",
    with_views(
        f"""select l.symbol, {day('l.trade_date')} as anchor, l.step, {r('l.ret + case when l.step <= 4 then rg else 0 end + case when l.step <= 2 then mo else 0 end')} as corrected from lp l join (
          select symbol, rn, greatest(-0.02, least(0.02, 0.1 * case when m20 > 0.05 then 1 when m20 < -0.05 then -1 else 0 end * greatest(-1, least(1, r13 / 0.08)))) as rg, case when m20 > 0.05 then greatest(-0.02, least(0.02, r1 * 0.25)) else 0 end as mo from ftv where r13 is not null) x on x.symbol = l.symbol and x.rn = l.rn""",
        **FT, **LP,
    ),
)
def _(spark, sf):
    t = table(spark, sf).where("path is not null and r13 is not null")
    t = t.withColumns({"market_state_code": F.when(F.col("m20") > 0.05, 1.0).when(F.col("m20") < -0.05, -1.0).otherwise(0.0), "ret_26": F.col("r13"), "d_ret_5": F.col("r1")})
    return L.explode_path(SC.correct_path(t, gate="REGIME_GATED"), ["symbol", "anchor"], "corrected", value="corrected")
