"""Recursions, scans and joins against plain Python."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import indicators as I, ingest as G, ledger as LG, panel as P, pit


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def test_ema_matches_recursion_over_several_blocks(spark):
    rng = random.Random(1)
    xs = [100 + rng.random() * 50 for _ in range(5000)]
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(xs)], "symbol string, trade_date date, close double")
    for n in (2, 9, 26):
        got = [r.e for r in I.ema(df, "close", n, "e").orderBy("trade_date").select("e").collect()]
        want, a = [xs[0]], 2 / (n + 1)
        for x in xs[1:]:
            want.append(want[-1] + a * (x - want[-1]))
        assert np.max(np.abs(np.array(got) / np.array(want) - 1)) < 1e-12


def test_zero_seed_and_single_row(spark):
    df = spark.createDataFrame([("a", day(0), 10.0)], "symbol string, trade_date date, close double")
    assert abs(I.ema(df, "close", 9, "e", seed="zero").first().e - 2.0) < 1e-12
    assert I.rsi(df, 14).first().rsi == 50.0


def _trades(n, keys, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(keys)
        rows.append((key, "s", day(i // 7), i, "BUY" if rng.random() < 0.5 else "SELL", float(rng.randint(1, 40)), 5 + rng.random() * 5, 1.0))
    return rows


def test_ledger_equals_sequential_fold_with_a_hot_account(spark):
    rows = _trades(4000, ["a", "b", "c"], 3)
    df = spark.createDataFrame(rows, "account_id string, symbol string, trade_date date, k long, side string, quantity double, price double, fee double")
    out = LG.ledger_fold(df, ["trade_date", "k"], F.trunc("trade_date", "month"))
    got = {r.k: r for r in out.collect()}
    state = {}
    for acc, _s, _d, k, side, q, price, fee in rows:
        h, c = state.get(acc, (0.0, 0.0))
        real = 0.0
        if side == "BUY":
            h, c = h + q, c + q * price + fee
        elif h > 0:
            sold = min(q, h)
            released = c if sold == h else c / h * sold
            real = sold * price - fee - released
            h, c = h - sold, (0.0 if sold == h else c - released)
        state[acc] = (h, c)
        r = got[k]
        assert abs(r.holding - h) < 1e-9 and abs(r.total_cost - c) < 1e-6 * max(1, c) and abs(r.realized_pnl - real) < 1e-6 * max(1, abs(real)), (k, r, h, c, real)


def test_affine_scan_survives_tiny_factors(spark):
    rng = random.Random(5)
    rows = [("a", i // 50, i, rng.choice([1.0, 1e-9, 0.5, 0.0 if i % 997 == 0 else 0.9]), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, blk int, i int, m double, b double")
    got = {r.i: (r.x, r.x_before) for r in P.affine_scan(df, ["k"], F.col("blk"), ["i"], "m", "b", "x").collect()}
    x = 0.0
    for _k, _blk, i, m, b in rows:
        before, x = x, m * x + b
        assert abs(got[i][0] - x) < 1e-9 * max(1, abs(x)) and abs(got[i][1] - before) < 1e-9 * max(1, abs(before))


def test_block_scan_and_lag_do_not_depend_on_blocks(spark):
    rng = random.Random(2)
    rows = [("k" if rng.random() < 0.8 else "z", i, rng.randint(-5, 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    one = P.block_scan(df, ["k"], F.lit(0), ["i"], {"s": F.col("v")}, {"m": "s"})
    many = P.block_scan(df, ["k"], F.floor(F.col("i") / 17), ["i"], {"s": F.col("v")}, {"m": "s"})
    pick = lambda d: sorted((r.i, r.s, r.m, r.m_before) for r in d.collect())
    assert pick(one) == pick(many)
    lag = P.block_lag(df, ["k"], F.floor(F.col("i") / 17), ["i"], {"p": "v"})
    prev = {}
    want = {}
    for k, i, v in rows:
        want[i] = prev.get(k)
        prev[k] = v
    assert {r.i: r.p for r in lag.collect()} == want


def test_asof_strict_and_hot_left_rows(spark):
    left = spark.createDataFrame([("a", day(d % 20), i) for i, d in enumerate(range(400))], "k string, t date, i int")
    right = spark.createDataFrame([("a", day(d), float(d)) for d in range(0, 20, 3)], "k string, rt date, v double")
    for strict in (False, True):
        for r in P.asof_join(left, right, ["k"], "t", "rt", ["v"], strict=strict).collect():
            n = (r.t - day(0)).days
            want = max((d for d in range(0, 20, 3) if (d < n if strict else d <= n)), default=None)
            assert r.v == want


def test_nearest_and_overlap_against_brute_force(spark):
    rng = random.Random(9)
    l = sorted(rng.sample(range(300), 60))
    rr = sorted(rng.sample(range(300), 12))
    left = spark.createDataFrame([("a", day(x)) for x in l], "k string, t date")
    right = spark.createDataFrame([("a", day(x), x) for x in rr], "k string, rt date, v int")
    for row in P.nearest_join(left, right, ["k"], "t", "rt", ["v"]).collect():
        n = (row.t - day(0)).days
        assert row.v == min(rr, key=lambda x: (abs(x - n), x))
    spans = [(x, x + rng.randint(3, 30)) for x in l]
    labels = spark.createDataFrame([("a", day(s), day(e)) for s, e in spans], "k string, anchor date, label_end date")
    got = {(r.anchor, r.label_end): r.concurrent for r in pit.overlap_weights(labels, ["k"]).collect()}
    for s, e in spans:
        assert got[day(s), day(e)] == sum(1 for a, b in spans if a < e and s < b)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    new = spark.createDataFrame([(2, None), (3, 4.0), (4, 5.0)], "k int, v double")
    merged, audit = G.upsert(old, new, ["k"], ["v"])
    assert {r.k: r.outcome for r in audit.collect()} == {1: "kept", 2: "skipped", 3: "updated", 4: "added"}
    _, again = G.upsert(merged, new, ["k"], ["v"])
    assert {r.outcome for r in again.collect()} == {"kept", "skipped"}


def test_indicators_do_not_look_ahead_and_keys_are_independent(spark):
    rng = random.Random(4)
    rows = [(s, day(i), 50 + rng.random() * 20, float(rng.randint(1, 9))) for s in ("a", "b") for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume double")
    full = {(r.symbol, r.trade_date): r for r in I.indicator_set(df, "daily").collect()}
    part = I.indicator_set(df.where("symbol = 'a'").where(F.col("trade_date") <= day(80)), "daily").collect()
    assert len(part) == 81
    for r in part:
        other = full[r.symbol, r.trade_date]
        for c in ("dif", "dea", "rsi_6", "ma_20", "volatility_20", "running_drawdown"):
            assert abs(r[c] - other[c]) < 1e-9


def test_money_weighted_return(spark):
    flows = spark.createDataFrame([("a", day(0), 100.0), ("a", day(365), 100.0), ("b", day(0), 50.0)], "account_id string, flow_date date, amount double")
    ends = spark.createDataFrame([("a", day(730), 231.0), ("b", day(10), 60.0), ("c", day(10), 1.0)], "account_id string, valuation_date date, ending_value double")
    got = {r.account_id: r.money_weighted_return for r in LG.mwr(flows, ends).collect()}
    assert abs(got["a"] - 0.1) < 1e-9 and got["b"] is None and got["c"] is None


def test_order_sizes_fit_and_are_maximal(spark):
    rng = random.Random(8)
    rows = [(float(rng.randint(1, 5000)), rng.random() * 9 + 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, p double").withColumn("q", LG.size_orders("a", "p", 100))
    fee = lambda g: max(g * 0.00025, 5.0)
    for r in df.collect():
        assert r.q == 0 or r.q * r.p + fee(r.q * r.p) <= r.a + 1e-9
        g = (r.q + 100) * r.p
        assert g + fee(g) > r.a - 1e-9


def test_account_marks_equal_a_daily_loop(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        rows.append((rng.choice("ab"), rng.choice("xyz"), day(rng.randint(3, 200)), i, "BUY" if rng.random() < 0.6 else "SELL", float(rng.randint(1, 40)), 5 + rng.random() * 5, 1.0))
    closes = {(s, d): 5 + rng.random() * 5 for s, first in (("x", 0), ("y", 40), ("z", 190)) for d in range(first, 260) if rng.random() < 0.6}
    trades = spark.createDataFrame(rows, "account_id string, symbol string, trade_date date, k long, side string, quantity double, price double, fee double")
    prices = spark.createDataFrame([(s, day(d), c) for (s, d), c in closes.items()], "symbol string, trade_date date, close double")
    order = ["trade_date", "k"]
    got = {(r.account_id, r.snapshot_date): r for r in LG.mark_accounts(LG.ledger_fold(trades, order, F.trunc("trade_date", "month")), prices, order).collect()}
    want = {}
    for account in "ab":
        own = sorted((r for r in rows if r[0] == account), key=lambda r: (r[2], r[3]))
        symbols, first = {r[1] for r in own}, own[0][2]
        days = {r[2] for r in own} | {day(d) for s, d in closes if s in symbols and day(d) >= first}
        h, c, cash, paid = {s: 0.0 for s in symbols}, {s: 0.0 for s in symbols}, 0.0, 0.0
        for d in sorted(days):
            flow = 0.0
            for _, s, _, _, side, q, price, fee in (r for r in own if r[2] == d):
                if side == "BUY":
                    h[s], c[s], flow = h[s] + q, c[s] + q * price + fee, flow + q * price + fee
                elif h[s] > 0:
                    sold = min(q, h[s])
                    c[s] -= c[s] / h[s] * sold
                    h[s], cash = h[s] - sold, cash + sold * price - fee
            paid += flow
            last = {s: max(((e, closes[s, e]) for (z, e) in closes if z == s and day(e) <= d), default=(0, 0.0))[1] for s in symbols}
            want[account, d] = (cash, sum(h[s] * last[s] for s in symbols), paid, flow, sum(c.values()), sum(h.values()))
    assert got.keys() == want.keys()
    for key, w in want.items():
        r = got[key]
        assert np.allclose((r.cash_balance, r.market_value, r.total_contribution, r.external_cash_flow, r.total_cost, r.holding), w, atol=1e-6), key
