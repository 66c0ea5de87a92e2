"""Analogues of every anchor against plain loops over all earlier rows."""

import datetime as dt
import random

import numpy as np

from barloom.operators import analogues as AN


def test_nearest_history_equals_a_plain_search_with_ties_and_gaps(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.choice([0.0, 0.1, rng.random()]), rng.choice([None, 0.5, rng.random(), float("nan")]) if i % 9 == 0 else rng.choice([0.0, 1.0, rng.random()])) for s in "ab" for i in range(180 if s == "a" else 7)]
    df = spark.createDataFrame(rows, "symbol string, ordinal int, x double, y double")
    got = {}
    for r in AN.nearest_history(df.where("ordinal % 5 <> 2"), df, {"x": 2.0, "y": 0.5}, 6, 4, block=16, pivot_count=3).collect():
        got.setdefault((r.symbol, r.target), []).append((r["rank"], r.ordinal, r.distance))
    known = [r for r in rows if r[3] is not None and r[3] == r[3]]
    for s, t, x, y in known:
        past = sorted((round(0.0 + 2.0 * abs(a - x) + 0.5 * abs(b - y), 12), o) for z, o, a, b in known if z == s and o + 4 <= t and o % 5 != 2)[:6]
        assert sorted(got.get((s, t), [])) == [(i + 1, o, d) for i, (d, o) in enumerate(past)], (s, t)
    assert AN.nearest_history(df.where("false"), df, {"x": 1.0}, 3, 1).count() == 0


def test_analogue_forecast_spreads_the_paths_of_the_nearest(spark):
    rng = random.Random(7)
    rows = [("a", i, rng.random(), [rng.uniform(-0.2, 0.2) for _ in range(3)] if i < 50 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ordinal int, x double, path array<double>")
    got = {(r.target, r.step): r for r in AN.analogue_forecast(df, df, {"x": 1.0}, 8, horizon=5, minimum=4).collect()}
    assert {t for t, _ in got} == set(range(8, 60))
    for (t, step), r in got.items():
        near = sorted((round(abs(x - rows[t][2]), 12), o) for _, o, x, p in rows if p and o + 5 <= t)[:8]
        values = np.array([rows[o][3][step - 1] for _, o in near])
        assert np.allclose((r.p10, r.p50, r.p90, r.expected, r.p_up), (*np.quantile(values, [0.1, 0.5, 0.9]), values.mean(), (values > 0.05).mean()))
        assert r.analogues == len(near)


def test_similar_windows_equal_a_plain_search_at_every_anchor(spark):
    rng = random.Random(2)
    closes = [100.0]
    for i in range(239):
        closes.append(closes[-1] if 80 < i < 130 else closes[-1] * (1 + rng.uniform(-0.03, 0.03)))
    day = lambda n: dt.date(2001, 1, 1) + dt.timedelta(days=n)
    df = spark.createDataFrame([("a", day(i), c) for i, c in enumerate(closes)] + [("b", day(i), 5.0) for i in range(9)], "symbol string, trade_date date, close double")
    window, horizon, k = 10, 6, 4
    got = {}
    for r in AN.similar_windows(df, window, horizon, k, block=32).collect():
        assert r.end_date == day(r.target) and r.match_date == day(r.ordinal)
        got.setdefault(r.target, []).append((r["rank"], r.ordinal, r.distance))
    x = np.array(closes)
    shape = {e: x[e - window + 1 : e + 1] / x[e - window + 1] for e in range(window - 1, len(x))}
    want = {}
    for t in shape:
        past = sorted((float(np.round(np.sqrt(((shape[e] - shape[t]) ** 2).sum() / window), 12)), e) for e in shape if e <= t - window - horizon)[:k]
        if past:
            want[t] = [(i + 1, e, d) for i, (d, e) in enumerate(past)]
    assert {t: sorted(v) for t, v in got.items()} == want


def test_sliding_products_equal_dot_products():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    windows = np.lib.stride_tricks.sliding_window_view(x, 17)
    assert np.allclose(AN.sliding_products(x, windows[[3, 90, 283]]), windows[[3, 90, 283]] @ windows.T, atol=1e-10)
