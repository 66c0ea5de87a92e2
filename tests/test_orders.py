"""Counts, sticky states and interval chains against plain loops, with a key that holds most of the rows."""

import datetime as dt
import random


from barloom.operators import gates as G, models as M, pit


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def test_expanding_percentiles_equal_counts_of_the_past(spark):
    rng = random.Random(5)
    rows = [("hot", day(i), rng.choice([1.0, 2.0, rng.random() * 3])) for i in range(700)] + [("one", day(0), 4.0)] + [("gaps", day(i), rng.choice([None, float("nan"), 1.0, 2.0])) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, pe double").repartition(4)
    for kind, least in (("le", 1), ("mid", 3)):
        got = {(r.symbol, r.trade_date): r.pe_percentile for r in pit.expanding_percentile(df, "pe", kind, min_obs=least).collect()}
        assert len(got) == len(rows)
        for s, d, v in rows:
            past = [x for z, e, x in rows if z == s and e <= d and x is not None and x == x]
            below, equal = sum(x < v for x in past) if v is not None else 0, sum(x == v for x in past)
            want = None if v is None or v != v or len(past) < least else 100.0 * (below + equal if kind == "le" else below + 0.5 * equal) / len(past)
            assert got[s, d] == want or abs(got[s, d] - want) < 1e-12, (s, d)
    assert pit.expanding_percentile(df.where("false"), "pe").count() == 0


def test_health_states_equal_the_fold(spark):
    rng = random.Random(6)
    rows = [(k, day(7 * i), rng.choice([0.1, 0.2, 0.4, 0.6, 0.9]) if i % 40 > 9 else 0.9 * (i % 2), rng.random() < 0.6) for k, n in (("hot", 900), ("few", 3)) for i in range(n)]
    got = {(r.symbol, r.anchor): r.health for r in G.health_states(spark.createDataFrame(rows, "symbol string, anchor date, ood_score double, degraded boolean")).collect()}
    seen = set()
    for key in ("hot", "few"):
        state, high, low, bad, good = "MODEL_NORMAL", 0, 0, 0, 0
        for k, d, score, worse in rows:
            if k != key:
                continue
            high, low = (high + 1 if score >= 0.5 else 0), (low + 1 if score <= 0.35 else 0)
            bad, good = (bad + 1, 0) if worse else (0, good + 1)
            if high >= 2:
                state = "MODEL_OUT_OF_DISTRIBUTION"
            elif state == "MODEL_OUT_OF_DISTRIBUTION" and low < 3:
                pass
            elif bad >= 3:
                state = "MODEL_DEGRADED"
            elif not (state == "MODEL_DEGRADED" and good < 3):
                state = "MODEL_NORMAL"
            seen.add(state)
            assert got[key, d] == state, (key, d)
    assert len(seen) == 3


def test_independent_windows_equal_the_greedy_choice(spark):
    rng = random.Random(7)
    rows = []
    for key, n, span in (("hot", 1500, 6000), ("few", 4, 50), ("one", 1, 5), ("same", 30, 0)):
        for _ in range(n):
            a = rng.randint(0, span)
            rows.append((key, day(a), day(a + (rng.randint(1, 90) if key != "same" else 5))))
    df = spark.createDataFrame(rows, "g string, anchor date, label_end date").repartition(5)
    got = {r.g: r.independent for r in M.independent_windows(df, ["g"]).collect()}
    for key in ("hot", "few", "one", "same"):
        count, last = 0, None
        for a, e in sorted({(a, e) for k, a, e in rows if k == key}, key=lambda x: (x[1], -x[0].toordinal())):
            if last is None or a >= last:
                count, last = count + 1, e
        assert got[key] == count, key
    assert M.independent_windows(df.where("false"), ["g"]).count() == 0


def test_exact_quantiles_of_a_hot_group_ties_and_gaps(spark):
    import numpy as np

    from barloom.operators import panel as P

    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=40_000), "ties": rng.integers(0, 3, 5_000).astype(float), "six": rng.random(6), "two": np.array([3.0, -1.0]), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("none", float("nan")), ("six", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.g: r.quantiles for r in P.exact_quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g], np.quantile(values, shares), rtol=0, atol=1e-12), g
