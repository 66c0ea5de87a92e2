"""Vector operators and sharding against brute force, and the pipeline against its stages' plain versions."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hnsw, onebit, sharding
from barloom.llm.common import components

ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 8, 1), (9004, [1.0] * 7 + [float("nan")], 1), (9005, [1.0] * 7 + [float("inf")], 1), (9006, [1.0] * 7 + [None], 1), (9008, [1.0, 2.0], 1)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("block", "width", "rank", "root", "n")})


def cloud(n=400, d=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, d))
    x = (centres[r.integers(0, 12, n)] + 0.12 * r.standard_normal((n, d))).astype(np.float32)
    x[50:80] = x[50]
    return x, r.integers(0, 3, n)


def test_nearest_equal_brute_force(spark):
    x, label = cloud()
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))] + ODD + [(9020, None, None)]
    got = onebit.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=7, block_rows=90, query_rows=6).collect()
    by = {}
    for q in got:
        by.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    x = x.astype(float)
    assert set(by) == set(range(0, 400, 20))
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:7]
        assert [v for _, v, _ in sorted(found)] == order.tolist() and np.allclose([z for *_, z in sorted(found)], s[order])
    assert onebit.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = onebit.search(vectors(spark, rows[:3]), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2]


def test_bounds_hold():
    r = np.random.default_rng(7)
    x, q = r.standard_normal((3000, 64)), r.standard_normal((20, 64))
    bits, length, along, mean = onebit.encode(x, 17)
    estimate, half = onebit.bounds(q, bits, length, along, mean, 17, 4.0)
    assert bits.shape == (3000, 8) and (np.abs(estimate - q @ x.T) <= half).mean() > 0.9995


def test_near_duplicates_equal_brute_force(spark):
    x, label = cloud(500)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))] + ODD + [(9030, x[0].tolist(), None), (9031, None, None), (None, x[0].tolist(), 0), (3, x[3].tolist(), int(label[3]))]
    got = hnsw.near_duplicates(vectors(spark, rows), 0.97, shard_rows=100, query_rows=40).collect()
    assert len(got) == len(rows)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.97) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(500)
    for _ in range(500):
        new = np.minimum(root, np.where(link, root[None, :], 500).min(1))
        if (new == root).all():
            break
        root = new
    twice = lambda i: int(i != 3 and link[i, 3])
    for r in got:
        if r.vec_id is None or r.vec_id >= 9000:
            assert (r.n_links, r.component_id) == (0, r.vec_id) and r.kept
        else:
            assert (r.n_links, r.component_id, r.kept) == (int(link[r.vec_id].sum()) + (1 if r.vec_id == 3 else twice(r.vec_id)), int(root[r.vec_id]), bool(root[r.vec_id] == r.vec_id))
    assert hnsw.near_duplicates(vectors(spark, [])).count() == 0


def test_graph_finds_neighbours():
    r = np.random.default_rng(11)
    x = r.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x, 1)
    found = graph.near(x[:200].astype(np.float32), 64)[:, :10]
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), true.tolist())]) > 0.9


def test_lookup_table_is_fair_and_stable(spark):
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    share = np.bincount(table, minlength=10)
    assert share.max() - share.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert ((table != fewer) & (table != 9)).mean() < 0.12
    heavy = np.bincount(sharding.lookup_table(names[:2], 1009, [3, 1]))
    assert abs(heavy[0] / heavy[1] - 3) < 0.05
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_lookup_table_equals_a_plain_version():
    names, size = ["a", "b", "c"], 101
    orders = []
    for s in names:
        offset, skip = sharding._number(f"offset:{s}") % size, sharding._number(f"skip:{s}") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    want, turn = [None] * size, 0
    while None in want:
        want[next(slot for slot in orders[turn % 3] if want[slot] is None)] = turn % 3
        turn += 1
    assert sharding.lookup_table(names, size).tolist() == want


def test_placement_of_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "doc_id long, shard string").withColumn("slot", F.lit("x"))
    got = sharding.place(df, ["doc_id"], ["p", "q"], 101).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1 and all(r.shard in "pq" for r in got)
    assert sharding.place(df.where("false"), ["doc_id"], ["p", "q"], 101).count() == 0
    named = sharding.place(df.withColumn("shard_no", F.lit(7)).withColumn("a.b", F.lit(1)), ["shard", "slot"], ["p", "q"], 101)
    assert named.columns == ["doc_id", "shard_no", "a.b", "slot", "shard"] and {r.shard_no for r in named.collect()} == {7}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (5, 5), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
