"""More queries whose SQL needs the expressions of several other plan modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scalar as S
from barloom.operators import bars as B, models as M, scenarios as SC
from barloom.plans import views as V
from barloom.plans.feature_plans import OW, _base_sql, _curv, _weekly_sql
from barloom.plans.indicator_plans import SLOPE
from barloom.plans.label_plans import LP, _WIS
from barloom.plans.model_plans import _BOOT, FAN, FT, NAMES, NS, SEED, _fan_inputs, _SG, _WINDOWS, table
from barloom.plans.registry import REG
from barloom.plans.rule_plans import _CAP, _CONF, _POL, _POL_FN, _POL_T3, _QUAD
from barloom.plans.sqlviews import day, r, with_views

KEY = f"symbol, {day('trade_date')} as trade_date"


@REG.add("indicator_payload_lookup", "F-09", with_views(f"select {KEY}, {r('close')} as close, {r('volume')} as volume, null::double as rsi from w"))
def _(spark, sf):
    w = V.bars_weekly(spark, sf).select("symbol", "trade_date", F.to_json(F.struct("close", "volume")).alias("payload"))
    return w.select("symbol", "trade_date", *[S.indicator_value("payload", k).alias(k) for k in ("close", "volume", "rsi")])


# ---- ridge with one feature: closed form ------------------------------------------------

RIDGE = {
    **FT, **LP,
    "mat": "select * from (select *, max(rn) over (partition by symbol) as n from ftv) where rn + 13 <= n",
    "md": "select symbol, quantile_cont(r4, 0.5) as a, quantile_cont(m20, 0.5) as b from mat group by symbol",
    "zs": "select t.symbol, avg(coalesce(t.r4, md.a)) as am, stddev_pop(coalesce(t.r4, md.a)) as asd, avg(coalesce(t.m20, md.b)) as bm, stddev_pop(coalesce(t.m20, md.b)) as bsd from mat t join md on md.symbol = t.symbol group by t.symbol",
    "rx": """select t.symbol, t.trade_date, t.rn, greatest(-8, least(8, (coalesce(t.r4, md.a) - am) / asd)) as z1, greatest(-8, least(8, (coalesce(t.m20, md.b) - bm) / bsd)) as z2 from mat t join md on md.symbol = t.symbol join zs on zs.symbol = t.symbol""",
    "r1": "select symbol, step, b, ym - zm * b as i, sign(b) * greatest(abs(b) - 0.01, 0) as bs, ym - zm * sign(b) * greatest(abs(b) - 0.01, 0) as is_ from (select x.symbol, l.step, avg(z1) as zm, avg(ret) as ym, covar_pop(z1, ret) * count(*) / (var_pop(z1) * count(*) + 10) as b from rx x join lp l on l.symbol = x.symbol and l.rn = x.rn group by x.symbol, l.step)",
    "p1": "select x.symbol, x.trade_date, x.rn, l.step, l.ret, x.z2, greatest(-0.75, least(1.5, r1.i + r1.b * x.z1)) as wk from rx x join lp l on l.symbol = x.symbol and l.rn = x.rn join r1 on r1.symbol = x.symbol and r1.step = l.step",
    "r2": "select symbol, step, b, ym - zm * b as i from (select symbol, step, avg(z2) as zm, avg(ret - wk) as ym, covar_pop(z2, ret - wk) * count(*) / (var_pop(z2) * count(*) + 10) as b from p1 group by symbol, step)",
    "p2": "select p1.*, greatest(-0.03, least(0.03, r2.i + r2.b * z2)) * case p1.step when 1 then 1 when 2 then 0.75 when 3 then 0.5 when 4 then 0.25 else 0 end as cr from p1 join r2 on r2.symbol = p1.symbol and r2.step = p1.step",
}
TWO = ["r4", "m20"]


def _ridge_rows(spark, sf):
    t = table(spark, sf).where("path is not null")
    z = M.transform(M.pack(t, TWO), M.fit_scaler(t, TWO, ["symbol"]), ["symbol"])
    return z.withColumns({"zw": F.slice("z", 1, 1), "zd": F.slice("z", 2, 1), "weight": F.lit(1.0)}).withColumnRenamed("path", "y")


@REG.add(
    "single_feature_ridge",
    "M-02 M-03 M-01",
    with_views(f"select symbol, step, {r('i')} as intercept, {r('b')} as coefficient, {r('bs')} as sparse_coefficient from r1", **RIDGE),
)
def _(spark, sf):
    t = _ridge_rows(spark, sf)
    full, sparse = (M.ridge_fit(t, ["symbol"], 10.0, 1, 13, "zw", l1=l1) for l1 in (0.0, 0.01))
    a = full.select("symbol", F.posexplode(F.arrays_zip(F.col("intercept").alias("i"), F.transform("coefficients", lambda c: c[0]).alias("b"))).alias("p", "v"))
    b = sparse.select("symbol", F.posexplode(F.transform("coefficients", lambda c: c[0])).alias("p", "s"))
    return a.join(b, ["symbol", "p"]).select("symbol", (F.col("p") + 1).alias("step"), F.col("v.i").alias("intercept"), F.col("v.b").alias("coefficient"), F.col("s").alias("sparse_coefficient"))


@REG.add(
    "two_stage_paths",
    "M-04 M-07",
    with_views(f"select {KEY}, step, {r('wk')} as weekly, {r('cr')} as correction, {r('wk + cr')} as expected from p2", **RIDGE),
)
def _(spark, sf):
    o = M.two_stage_fit(_ridge_rows(spark, sf), ["symbol"], 1, 1, 13)
    z = F.arrays_zip(F.col("weekly_path").alias("w"), F.col("daily_correction").alias("c"), F.col("expected").alias("e"))
    return o.select("symbol", F.col("anchor").alias("trade_date"), F.posexplode(z).alias("p", "v")).select(
        "symbol", "trade_date", (F.col("p") + 1).alias("step"), F.col("v.w").alias("weekly"), F.col("v.c").alias("correction"), F.col("v.e").alias("expected")
    )


@REG.add(
    "first_stump",
    "M-05",
    with_views(
        f"""select symbol, feature, {r('th')} as threshold, {r('gain')} as gain from (select *, row_number() over (partition by symbol order by gain desc, feature) as k from (
          select symbol, feature, any_value(th) as th, sum(g) as gain from (select symbol, feature, lf, any_value(th) as th, sum(s * s) / any_value(n) as g from (
            select symbol, feature, lf, step, any_value(th) as th, sum(ret) as s, count(*) as n from (select f.symbol, f.feature, f.x <= t.th as lf, t.th, l.step, l.ret from fx f join (select symbol, feature, quantile_cont(x, 0.5) as th from fx group by all) t on t.symbol = f.symbol and t.feature = f.feature join lp l on l.symbol = f.symbol and l.rn = f.rn) group by symbol, feature, lf, step)
            group by symbol, feature, lf) group by symbol, feature having count(*) = 2)) where k = 1""",
        **FT, **LP,
        fx="select symbol, rn, unnest([0, 1, 2]) as feature, unnest([coalesce(r1, 0), coalesce(r4, 0), coalesce(m20, 0)]) as x from (select *, max(rn) over (partition by symbol) as n from ftv) where rn + 13 <= n",
    ),
)
def _(spark, sf):
    t = table(spark, sf).where("path is not null")
    z = F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("r1", "r4", "m20")])
    stumps, _rows = M.fit_stumps(t.select("symbol", F.col("anchor").alias("id"), z.alias("z"), F.col("path").alias("residual")), ["symbol"], 3, 13, rounds=1)
    return stumps.select("symbol", "feature", "threshold", "gain")


_Q = {q: f"quantile_cont({{c}}, {q})" for q in (0.01, 0.25, 0.5, 0.75, 0.99)}


@REG.add(
    "out_of_distribution_components",
    "M-08",
    with_views(
        f"""select symbol, {day('trade_date')} as anchor, {r(' + '.join(f'(x.{n} < q.{n}_1 or x.{n} > q.{n}_5)::int' for n in NAMES).join(['(', ') / 6.0::double']))} as outside_share,
          {r('greatest(' + ', '.join(f'least(100, abs(x.{n} - q.{n}_3) / greatest((q.{n}_4 - q.{n}_2) / 1.349, 1e-9))' for n in NAMES) + ')')} as robust_z_max
        from (select * from ftv where v13 is not null and r13 is not null) x join qs q using (symbol)""",
        **FT,
        qs="select symbol, " + ", ".join(f"{e.format(c=n)} as {n}_{i}" for n in NAMES for i, e in enumerate(_Q.values(), 1)) + " from ftv where v13 is not null and r13 is not null group by symbol",
    ),
)
def _(spark, sf):
    t = table(spark, sf).where("v13 is not null and r13 is not null")
    return M.ood_score(t, M.ood_fit(t, NAMES, ["symbol"]), NAMES, ["symbol"]).select("symbol", "anchor", "outside_share", "robust_z_max")


@REG.add(
    "scenario_bar_closes",
    "M-17 M-16",
    with_views(f"select f.symbol, f.anchor, f.step, count(*) as n, count(*) as legal, {r('avg(b.close * (1 + f.ret))')} as close from fan f join wn b on b.symbol = f.symbol and b.rn = f.anchor group by all", **LP, **FAN),
)
def _(spark, sf):
    w = B.bar_context(V.bars_weekly(spark, sf))
    base = w.select("symbol", F.col("ordinal").alias("anchor"), F.col("close").alias("base_close"), F.col("volume").alias("base_volume"))
    bars = SC.scenario_bars(SC.scenario_fan(*_fan_inputs(spark, sf), NS, SEED), base, SC.bar_shapes(w), SEED)
    return bars.groupBy("symbol", "anchor", "step").agg(F.count("*").alias("n"), F.count_if("legal").alias("legal"), F.avg("close").alias("close"))


# ---- SQL for queries registered elsewhere without one ----------------------------------------

def _fit(n: int) -> dict[str, str]:
    m = (n - 1) / 2
    a = f"({_curv('dif', n)} / 2 / close)"
    lin = f"({SLOPE('dif', n)} / close)"
    mean = f"(avg(dif) over (partition by symbol order by trade_date rows between {n - 1} preceding and current row) / close)"
    return {f"a{n}": a, f"b{n}": f"{lin} + 2 * {m} * {a}", f"c{n}": f"{mean} - {a} * {(n * n - 1) / 12} + {lin} * {m} + {a} * {m * m}"}


_FITS = ", ".join(f"{v} as {k}" for n in (5, 9, 13) for k, v in _fit(n).items())

REG.sql["turn_consensus"] = with_views(
    f"""select symbol, {day('trade_date')} as trade_date, coalesce(n > 0 and k1 = k2 and (n < 2 or sd <= 5), false)::bigint as turn_stable, case when n > 0 and k1 = k2 and (n < 2 or sd <= 5) then k1 else 'unstable' end as turn_kind,
      case when n > 0 and k1 = k2 and (n < 2 or sd <= 5) then {r('av', 3)} end as turn_days_ahead, case when n >= 2 then {r('sd', 3)} end as turn_dispersion
    from (select f.symbol, f.trade_date, count(v) as n, avg(v) as av, stddev_pop(v) as sd, min(k) filter (v is not null) as k1, max(k) filter (v is not null) as k2 from (
      select symbol, trade_date, case when abs(a) >= 1e-10 and -b / (2 * a) between 0 and 100 then -b / (2 * a) end as v, case when a > 0 then 'bottom' else 'top' end as k from (
        select symbol, trade_date, unnest([a5, a9, a13]) as a, unnest([b5, b9, b13]) as b from fits)) f group by f.symbol, f.trade_date)""",
    fits=f"select symbol, trade_date, {_FITS} from macd_w",
)

_ERF = "(1 - ({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))) * exp(-{x} * {x}))"


def _phi(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911::double * {x}))"
    return f"(0.5::double * (1 + sign({z}) * {_ERF.format(t=t, x=x)}))"


REG.sql["normal_probabilities"] = with_views(
    f"""select symbol, {day('anchor')} as anchor, h, {r('u')} as n_up, {r('greatest(0, 1 - u - d)')} as n_side, {r('d')} as n_down from (select symbol, anchor, h, u, least(d0, 1 - u) as d from (
      select symbol, anchor, h, 1 - {_phi('z1')} as u, {_phi('z2')} as d0 from (select *, (0.05 - p50) / greatest(p90 - p10, 0.005) as z1, (-0.05 - p50) / greatest(p90 - p10, 0.005) as z2 from fc)))"""
)

_W = _weekly_sql()
_NAMES = sorted([*_W, "weekly_drawdown_60"])
REG.sql["feature_manifest"] = with_views(
    f"""select 'price' as grp, 1::bigint as features, count(*) as filled, sha256('price_close') as names_hash from fbase
    union all select 'weekly', {len(_NAMES)}::bigint, sum(cnt)::bigint, sha256('{','.join(_NAMES)}') from (
      select {' + '.join(f'(v_{i} is not null)::int' for i in range(len(_W)))} + (rn >= 60)::int as cnt from (select rn, {', '.join(f'{v} as v_{i}' for i, v in enumerate(_W.values()))} from fbase))""",
    fbase=_base_sql("macd_w", "w"),
)

_MIX = lambda s, t: _WIS.replace("actual", "x.actual").replace("p50", f"{t}.p50").replace("p10", f"{t}.p10").replace("p90", f"{t}.p90")
REG.sql["promotion_gates"] = with_views(
    f"""select symbol, {r('imp')} as improvement, {r('worst')} as worst_degradation, {r('share')} as improved_share, {r('cb')} as candidate_coverage, {r('hi')} as bootstrap_high,
      concat_ws(',', case when imp < 0.01 then 'IMPROVEMENT' end, case when worst > 0.005 then 'WORST_ANCHOR' end, case when share <= 0.5 then 'MAJORITY' end, case when not coalesce(hi < 0, false) then 'BOOTSTRAP' end,
        case when abs(cb - 0.8) > abs(ca - 0.8) + 0.03 then 'COVERAGE' end, case when not (cb between 0.5 and 0.98) then 'COVERAGE_RANGE' end, case when sb + 0.05 < sa then 'SHAPE' end) as failed,
      (imp >= 0.01 and worst <= 0.005 and share > 0.5 and coalesce(hi < 0, false) and abs(cb - 0.8) <= abs(ca - 0.8) + 0.03 and cb between 0.5 and 0.98 and sb + 0.05 >= sa)::bigint as promoted
    from (select p.symbol, (avg(a) - avg(b)) / greatest(avg(a), 1e-9) as imp, max((b - a) / greatest(abs(a), 1e-9)) as worst, avg((b < a)::int) as share, avg(ia::int) as ca, avg(ib::int) as cb, avg(sa::int) as sa, avg(sb::int) as sb, any_value(hi) as hi
      from pg p left join (select symbol, quantile_cont(mean, 0.95) as hi from bm group by symbol) z on z.symbol = p.symbol group by p.symbol)""",
    **_BOOT,
    pg=f"""select x.symbol, {_MIX('x', 'x')} as a, {_MIX('x', 'y')} as b, x.actual between x.p10 and x.p90 as ia, x.actual between y.p10 and y.p90 as ib, (x.p50 > 0) = (x.actual > 0) as sa, (y.p50 > 0) = (x.actual > 0) as sb
      from fc x join fc26 y on y.symbol = x.symbol and y.anchor = x.anchor and y.h = x.h where x.h = 13 and x.actual is not null""",
)

REG.sql["promotion_channels"] = with_views(
    f"""select symbol, channel, ind as effective_windows, case when channel is not null then '' when cs = '' then 'EXCESS_RETURN_BELOW_0_30' else cs end as reason_codes, case when channel is null and me < 0.003 then {r('case when me < 0.0015 then 0.0015 - me else 0.003 - me end')} end as excess_gap,
      case when channel is null and wr < 0.55 then {r('0.55 - wr')} end as win_rate_gap, case when channel is null and dd > 0.02 then {r('dd - 0.02')} end as drawdown_gap
    from (select *, case when ok and n >= 8 and me >= 0.003 and mp > 0 and wr >= 0.55 and dd <= 0.02 and pt >= 0.1 and na <= 0.6 then 'STRONG' when ok and n >= 16 and ind >= 8 and me >= 0.0015 and me < 0.003 and mp > 0 and wr >= 0.58 and dd <= 0.005 and pt >= cp - 0.05 and na <= 0.6 then 'STABLE_SMALL_EDGE' end as channel,
        concat_ws(',', case when not ok then 'PREDICTION_QUALITY_GATE_FAILED' end, case when n < 8 then 'INSUFFICIENT_EFFECTIVE_WINDOWS' end, case when me < 0.0015 then 'EXCESS_RETURN_BELOW_0_15' end, case when me >= 0.0015 and me < 0.003 then 'EXCESS_RETURN_BELOW_0_30' end,
          case when mp <= 0 then 'MEDIAN_PROFIT_GATE_FAILED' end, case when wr < 0.55 then 'WIN_RATE_BELOW_THRESHOLD' end, case when dd > 0.02 then 'DRAWDOWN_GATE_FAILED' end, case when pt < 0.1 or na > 0.6 then 'NO_ACTION_DEPENDENCY' end) as cs
      from (select p.symbol, p.symbol not like 'R%' as ok, count(*) as n, avg(rb - ra) as me, quantile_cont(rb * 1000, 0.5) - quantile_cont(ra * 1000, 0.5) as mp, avg((rb > ra)::int) as wr, max(-db + da) as dd, avg(posb) / 100 as pt, avg(posa) / 100 as cp, avg(nob::int) as na, any_value(g.ind) as ind
        from wp p join (select symbol, max(c) as ind from gr group by symbol) g on g.symbol = p.symbol group by p.symbol))""",
    sg=_SG, wp=_WINDOWS,
    iv="select w.symbol, s.trade_date as s, w.window_end as e from wp w join sg s on s.symbol = w.symbol and s.rn = w.window_start",
    gr="""
  select symbol, min(e) as last, 1::bigint as c from iv group by symbol
  union all
  select g.symbol, (select min(z.e) from iv z where z.symbol = g.symbol and z.s >= g.last) as last, g.c + 1 from gr g where exists (select 1 from iv z where z.symbol = g.symbol and z.s >= g.last)""",
)


# ---- batches -------------------------------------------------------------------------------------

def _batches(total: str, first: str, src: str) -> str:
    """Four nested selects, one per batch."""
    sql = f"select *, {total} as left0 from {src}"
    for k in range(4):
        cap = first if k == 0 else "20"
        reserve = f"least(left{k}, {(3 - k) * 5})"
        free = f"case when left{k} > {reserve} then left{k} - {reserve} else left{k} end"
        value = f"greatest(5, floor(least({cap}, {free}) / 5.0::double) * 5)::bigint"
        if k == 3:
            value = f"greatest({value}, left{k})"
        sql = f"select *, left{k} - coalesce(v{k}, 0) as left{k + 1} from (select *, case when left{k} > 0 then {value} end as v{k} from ({sql}))"
    return sql


_TGT = "case when abs(t3 - cur) > fl + 60 then cur + sign(t3 - cur) * (fl + 60) else t3 end::bigint"
REG.sql["policy_batches"] = with_views(
    f"""select event_id, (v0 is not null)::bigint + (v1 is not null)::int + (v2 is not null)::int + (v3 is not null)::int as batches, abs(t - cur) as total, concat_ws('+', v0, v1, v2, v3) as split from ({_batches('abs(t - cur)', 'fl', f'(select *, {_TGT} as t from p3)')})""",
    pol=_POL, pf=_POL_FN, p3=_POL_T3,
)

_SCORES = [f"case when n >= {i} then {w}.0::double / (a{i} + 1) else -1 end" for i, w in ((1, 4), (2, 3), (3, 2), (4, 1))]
REG.sql["greedy_batches"] = with_views(
    """select event_id, amount, case when amount = 0 then '' else concat_ws('+', nullif(a1, 0) * 5, nullif(a2, 0) * 5, nullif(a3, 0) * 5, nullif(a4, 0) * 5) end as greedy, shares from (select event_id, (event_id % 21) * 5 as amt from events) e join dn2 on dn2.amount = e.amt
    join (select t, string_agg((b + case when rk <= left_over then 1 else 0 end)::bigint::varchar, '+' order by i) as shares from (select *, t - sum(b) over (partition by t) as left_over, row_number() over (partition by t order by round(x - b, 12) desc, i) as rk from (
      select i, t, t * w as x, floor(t * w) as b from (select range * 5 as t from range(0, 21)), (values (0, 0.4::double), (1, 0.3::double), (2, 0.2::double), (3, 0.1::double)) ws(i, w))) group by t) s on s.t = e.amt""",
    gd=f"""
  select range * 5 as amount, greatest(1, least(4, ceil(range * 5 / 20.0::double)))::int as n, 1 as a1, (greatest(1, least(4, ceil(range * 5 / 20.0::double))) >= 2)::int as a2, (greatest(1, least(4, ceil(range * 5 / 20.0::double))) >= 3)::int as a3, (greatest(1, least(4, ceil(range * 5 / 20.0::double))) >= 4)::int as a4,
    (range - greatest(1, least(4, ceil(range * 5 / 20.0::double))))::int as rest from range(0, 21)
  union all
  select amount, n, a1 + (p = 1)::int, a2 + (p = 2)::int, a3 + (p = 3)::int, a4 + (p = 4)::int, rest - 1 from (select *, case when s1 >= greatest(s2, s3, s4) then 1 when s2 >= greatest(s3, s4) then 2 when s3 >= s4 then 3 else 4 end as p from (
    select *, {', '.join(f'{s} as s{i}' for i, s in enumerate(_SCORES, 1))} from gd)) where rest > 0""",
    dn2="select * from gd where rest <= 0",
)

REG.sql["binding_statistics"] = with_views(
    f"""select symbol, confirmation, count(*) as n, count(*) filter (ft = cap and cap < bt) as cap_binds, count(*) filter (v0 in (5, 10, 15)) as probe_first, count(*) filter (greatest(coalesce(v0, 0), coalesce(v1, 0), coalesce(v2, 0), coalesce(v3, 0)) >= 15) as large_batches
    from ({_batches('ft', '10', '(select * from tg qualify row_number() over (partition by symbol order by trade_date desc) <= 12)')}) group by symbol, confirmation""",
    qd=_QUAD, cn=_CONF,
    tg=f"""select *, (round_even(least(bt, cap) / 5.0::double, 0) * 5)::bigint as ft from (select *, cs as confirmation, ({_CAP}) as cap, case when sc <= -0.6 then 0 when sc <= -0.35 then 10 when sc <= -0.15 then 20 when sc <= 0.1 then 30 when sc <= 0.3 then 45 when sc <= 0.55 then 60 else 80 end as bt from (
      select *, greatest(-1, least(1, 0.35 * greatest(-1, least(1, (x4 + x8) / 2 / 0.08)) + 0.3 * greatest(-1, least(1, (e4 + e8) / 2))
        + 0.2 * greatest(-1, least(1, 0.4 * case when d > 0 then 1 else -1 end + 0.3 * case when f1 > 0 then 1 else -1 end + 0.3 * greatest(-1, least(1, coalesce(sl, 0) / 0.01))))
        + 0.15 * greatest(-1, least(1, -p10 / 0.15 - greatest(-dd / 0.25, 0) * 0.5)))) as sc from cn))""",
)

REG.sql["calibrator_table"] = with_views(
    f"""select t.symbol, t.h, case when ind >= 50 then 'FORMALLY_CALIBRATED' when ind >= 30 then 'PRELIMINARY' else 'SHRINKAGE_ONLY' end as status, {r('case when ind < 30 then 1 + least(1, ind / 30.0::double) * (temp - 1) else temp end')} as temperature, n, ind as independent, (last + 7)::varchar as effective_from
    from tmp t join (select symbol, h, max(c) as ind from gr group by symbol, h) g on g.symbol = t.symbol and g.h = t.h join (select symbol, h, max(anchor + 7 * h) as last from fc where actual is not null group by symbol, h) l on l.symbol = t.symbol and l.h = t.h""",
    tmp="""select symbol, h, 0.25 + 0.005 * arg_min(i, (round(loss, 12), i))::double as temp, n from (
          select symbol, h, i, avg(-ln(greatest(exp((lk - m) / t) / (exp((lu - m) / t) + exp((ls - m) / t) + exp((ld - m) / t)), 1e-12))) as loss, count(*) as n from (
            select symbol, h, i, 0.25 + 0.005::double * i as t, lu, ls, ld, greatest(lu, ls, ld) as m, case when actual > 0.05 then lu when actual < -0.05 then ld else ls end as lk from (
              select *, ln(least(1, greatest(1e-9, p_up))) as lu, ln(least(1, greatest(1e-9, p_side))) as ls, ln(least(1, greatest(1e-9, p_down))) as ld from fc where actual is not null), range(0, 751) g(i)) group by symbol, h, i) group by symbol, h, n""",
    iv="select symbol, h, anchor as s, anchor + 7 * h as e from fc where actual is not null",
    gr="""
  select symbol, h, min(e) as last, 1::bigint as c from iv group by symbol, h
  union all
  select g.symbol, g.h, (select min(z.e) from iv z where z.symbol = g.symbol and z.h = g.h and z.s >= g.last) as last, g.c + 1 from gr g where exists (select 1 from iv z where z.symbol = g.symbol and z.h = g.h and z.s >= g.last)""",
)


REG.sql["stratified_fan"] = with_views(
    f"""select f.symbol, f.rn as anchor, f.st as stratum, count(*) as draws, {r('avg(exp(ln(1 + p.ret) + q.res * 0.1) - 1)')} as mean_terminal from (
      select d.symbol, d.rn, i, n.st, ('0x' || md5('{SEED}:' || d.symbol || ':' || d.rn || ':' || i)[1:8])::bigint % n.n as idx from (select distinct symbol, rn from lp) d, range(0, {NS}) g(i), (select symbol, st, max(j) + 1 as n from ps2 group by all) n
      where n.symbol = d.symbol and n.st = case when i < 42 then 0 else 1 end) f
    join lp p on p.symbol = f.symbol and p.rn = f.rn and p.step = 13 join ps2 q on q.symbol = f.symbol and q.st = f.st and q.j = f.idx group by f.symbol, f.rn, f.st""",
    **LP, pool=FAN["pool"],
    ps2="select symbol, st, res, row_number() over (partition by symbol, st order by rn) - 1 as j from (select symbol, rn, res, case when idx % 3 = 0 then 1 else 0 end as st from pool where step = 13)",
)

_DDW = """(select min(z.close / (select max(y.close) from wn y where y.symbol = z.symbol and y.rn between x.rn - 59 and z.rn) - 1) from wn z where z.symbol = x.symbol and z.rn between x.rn - 59 and x.rn)"""
_SIG = {
    "sx": f"""select x.*, y.vp from (select *, lag(hist) over {OW} as ph, 0.5 * (close / lag(close, 4) over {OW} - 1) + 0.3 * (close / lag(close, 8) over {OW} - 1) + 0.2 * (close / lag(close, 13) over {OW} - 1) as mom,
        case when rn >= 20 then avg(close) over (partition by symbol order by trade_date rows between 19 preceding and current row) end as m20, case when rn >= 60 then avg(close) over (partition by symbol order by trade_date rows between 59 preceding and current row) end as m60
      from macd_w) x join (select symbol, trade_date, case when count(x) over f = 13 then stddev_pop(x) over f * sqrt(52) end as v13, case when rn >= 20 then 100 * (close - min(close) over g) / nullif(max(close) over g - min(close) over g, 0) end as vp
        from (select *, close / lag(close) over {OW} - 1 as x from wn) window f as (partition by symbol order by trade_date rows between 12 preceding and current row), g as (partition by symbol order by trade_date rows between 19 preceding and current row)) y using (symbol, trade_date)""",
}
_SIG["sx"] = _SIG["sx"].replace("select x.*, y.vp", "select x.*, y.vp, y.v13, greatest(y.v13 / sqrt(52), 0.01) as sc")
_SIG["ss"] = f"""select *, greatest(-1, least(1, 0.25 * greatest(-1, least(1, mom / (sc * 3))) + 0.25 * greatest(-1, least(1, ((close / m20 - 1) * 0.65 + (close / m60 - 1) * 0.35) / greatest(sc * 2, 0.02))) + 0.2 * greatest(-1, least(1, (dif - dea) / close / greatest(sc / 4, 0.002)))
    + 0.15 * coalesce(greatest(-1, least(1, (50 - vp) / 50)), 0) + 0.15 * greatest(-1, least(1, 1 + {_DDW} / greatest(v13, 0.08))))) as s from sx x where rn >= 60"""

_SIGNAL = f"""{r('s')} as signal_score, case when s >= 0.08 then 'up' when s <= -0.08 then 'down' else 'sideways' end as signal_direction,
          case when s >= 0.7 then 'VERY_STRONG_BULL' when s >= 0.45 then 'STRONG_BULL' when s >= 0.2 then 'BULL' when s >= 0.05 then 'MILD_BULL' when s > -0.05 then 'NEUTRAL' when s > -0.2 then 'MILD_BEAR' when s > -0.45 then 'BEAR' else 'STRONG_BEAR' end as signal_state,
          case when vp >= 90 and s > 0.2 then case when hist >= ph then 'EXPENSIVE_STRONG' else 'EXPENSIVE_FADING' end when vp <= 15 and s < -0.08 then case when hist > ph then 'CHEAP_STABILISING' else 'CHEAP_WEAK' end when s < -0.45 then 'FALL_ACCELERATING' when s > 0.2 then 'FAIR_RISING' else 'FAIR_RANGING' end as signal_market_state,
          {r('case when s >= 0.7 then 95 when s >= 0.45 then 80 when s >= 0.2 then 70 when s >= 0.05 then 60 when s > -0.05 then 50 when s > -0.2 then 40 when s > -0.45 then 30 else 15 end')} as base_target,
          {r('greatest(35, least(90, 56 + abs(s) * 30))')} as signal_confidence"""

REG.add(
    "weekly_signal_states",
    "S-05",
    with_views(
        f"""select {KEY}, {_SIGNAL} from ss""",
        **_SIG,
    ),
)(lambda spark, sf: REG.queries["weekly_signals"](spark, sf).where("signal_score is not null"))

# All weeks: those before the first score have no signal.
REG.sql["weekly_signals"] = with_views(
    f"""select w.symbol, {day('w.trade_date')} as trade_date, signal_score, signal_direction, signal_state, signal_market_state, base_target, signal_confidence
    from w left join (select symbol, trade_date, {_SIGNAL} from ss where s is not null) z on z.symbol = w.symbol and z.trade_date = w.trade_date""",
    **_SIG,
)
