"""Near-duplicate vectors of equal label by navigable small-world graphs, one for every shard of a label.

Equal vectors of a label are one node with a weight. Each shard builds a layered graph: a node has random top level, and
on each of its layers links to near and mutually diverse nodes. Nodes enter in batches that are searched together, and a
batch's members also see each other. Every node queries every shard of its label. A beam that ends full of links is
doubled until it holds others too, and a sample of queries is checked against all vectors of the shard: while too few of
the true links are found, all beams are doubled. Links are pairs whose cosine, in double precision, reaches the
threshold. A task returns per node how many rows it links with, and a spanning forest of its links, which is all that
the components need.

Rules: vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label, link with
nothing; vectors of different width are not compared; repeated rows are linked; rows with a null id are returned with no
component; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import components, stored
from barloom.llm.vectors import complete, matrix

#: Links of a node on upper layers and on the lowest, nodes searched at once, beam while building.
LINKS, LOWEST, TOGETHER, BUILD = 12, 24, 256, 48


def select(x: np.ndarray, of: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """Of candidates ``near`` (rows x c, -1 for none) the m to link with: nearest first, each nearer to ``of`` than to those taken, then the nearest left over."""
    some = near >= 0
    v = x[np.maximum(near, 0)]
    sims = np.where(some, np.einsum("bcd,bd->bc", v, x[of]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    between = v @ v.transpose(0, 2, 1)
    rows, c = near.shape
    taken = np.zeros((rows, c), bool)
    for j in range(c):
        crowd = np.where(taken, between[:, j, :], -np.inf).max(1)
        taken[:, j] = (sims[:, j] > crowd) & np.isfinite(sims[:, j]) & (taken.sum(1) < m)
    rank = np.argsort(np.where(np.isfinite(sims), np.where(taken, 0, 1), 2), axis=1, kind="stable")[:, :m]
    out = np.where(np.isfinite(np.take_along_axis(sims, rank, 1)), np.take_along_axis(near, rank, 1), -1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, together: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The beams' nodes and similarities, nearest first; -1 where a beam is not full."""
    b = len(q)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, len(x) + 1), bool)
    ids = np.full((b, ef), -1)
    sims = np.full((b, ef), -np.inf, np.float32)
    w = min(ef, entry.shape[1])
    ids[:, :w] = entry[:, :w]
    sims[:, :w] = np.where(ids[:, :w] >= 0, np.einsum("bkd,bd->bk", x[ids[:, :w]], q), -np.inf)
    seen[rows, ids[:, :w]] = True
    spread = ids < 0
    live = np.arange(b)
    while len(live):
        open_ = np.where(spread[live], -np.inf, sims[live])
        width = min(together, ef)
        pick = np.argpartition(-open_, width - 1, axis=1)[:, :width]
        valid = np.take_along_axis(open_, pick, 1) > -np.inf
        on = valid.any(1)
        live, pick, valid = live[on], pick[on], valid[on]
        if not len(live):
            break
        spread[live[:, None], pick] = True
        new = np.where(valid[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        got = np.where(new >= 0, np.einsum("bkd,bd->bk", x[new], q[live]), -np.inf)
        all_ids, all_sims = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], got], 1)
        done = np.concatenate([spread[live], new < 0], 1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[live], sims[live], spread[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, done))
        ids[live] = np.where(sims[live] > -np.inf, ids[live], -1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    def __init__(self, x: np.ndarray, seed: int) -> None:
        n = len(x)
        self.x = np.ascontiguousarray(x, np.float32)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")[:1]
        self.top = int(level.max(initial=0))
        self.start = int(order[0]) if n else 0
        self.layers = [np.full((n, LINKS if i else LOWEST), -1, np.int32) for i in range(self.top + 1)]
        line = np.concatenate([[self.start], np.setdiff1d(np.arange(n), [self.start])]) if n else np.zeros(0, int)
        at = 1
        while at < n:
            batch = line[at : at + min(TOGETHER, at)]
            self._enter(batch, level)
            at += len(batch)

    def _enter(self, batch: np.ndarray, level: np.ndarray) -> None:
        q = self.x[batch]
        entry = np.full((len(batch), 1), self.start)
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        for i in range(self.top, -1, -1):
            on = level[batch] >= i
            links = self.layers[i]
            found, _ = beam_search(self.x, links, q, entry, BUILD if on.any() else 1)
            entry = found[:, : 1 if i else BUILD]
            if not on.any():
                continue
            mates = np.where(on[None, :], inner[on], -np.inf)
            nearest = np.argsort(-mates, axis=1)[:, : LINKS]
            mate_ids = np.where(np.isfinite(np.take_along_axis(mates, nearest, 1)), batch[nearest], -1)
            m = links.shape[1]
            mine = batch[on]
            chosen = select(self.x, mine, np.concatenate([found[on], mate_ids], 1), m if i else m // 2)
            links[mine, : chosen.shape[1]] = chosen
            self._back(links, mine)

    def _back(self, links: np.ndarray, mine: np.ndarray) -> None:
        """Adds the new nodes to their neighbours' links; a neighbour with too many selects anew."""
        source = np.repeat(mine, links.shape[1])
        target = links[mine].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = int(count.max(initial=0))
        more = np.full((len(nodes), wide), -1)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate([links[nodes], more], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        for s in range(0, len(nodes), 512):
            links[nodes[s : s + 512]] = select(self.x, nodes[s : s + 512], both[s : s + 512], links.shape[1])

    def near(self, q: np.ndarray, ef: int) -> np.ndarray:
        entry = np.full((len(q), 1), self.start)
        for i in range(self.top, 0, -1):
            entry = beam_search(self.x, self.layers[i], q, entry, 1)[0]
        return beam_search(self.x, self.layers[0], q, entry, ef)[0]

    def linked(self, q: np.ndarray, threshold: float, ef: int) -> list[np.ndarray]:
        """Per query the nodes whose cosine in double precision reaches the threshold, as far as the beams find them."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(q)
        left = np.arange(len(q))
        while len(left):
            again = []
            for s in range(0, len(left), TOGETHER):
                part = left[s : s + TOGETHER]
                if ef >= len(self.x):
                    found = np.broadcast_to(np.arange(len(self.x)), (len(part), len(self.x)))
                else:
                    found = self.near(q[part].astype(np.float32), ef)
                for i, ids in zip(part.tolist(), found, strict=True):
                    ids = ids[ids >= 0]
                    out[i] = ids[self.exact[ids] @ q[i] >= threshold]
                    if len(out[i]) == len(ids) and ef < len(self.x):
                        again.append(i)
            left, ef = np.array(again, int), ef * 2
        return out

    def audited(self, threshold: float, ef: int, recall: float, sample: int) -> int:
        """The beam at which ``recall`` of the sample's true links are found."""
        at = np.linspace(0, len(self.x) - 1, min(sample, len(self.x))).astype(int)
        true = [set(np.flatnonzero(self.exact @ self.exact[i] >= threshold).tolist()) for i in at]
        while ef < len(self.x):
            found = self.linked(self.exact[at], threshold, ef)
            if sum(len(t & set(f.tolist())) for t, f in zip(true, found, strict=True)) >= recall * sum(map(len, true)):
                break
            ef *= 2
        return ef


def near_duplicates(rows: DataFrame, threshold: float = 0.93, shards: int = 2, shard_rows: int = 50_000, query_rows: int = 8192, beam: int = 32, recall: float = 0.99, sample: int = 64, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    ``shards`` per label at least; more where one would exceed ``shard_rows``.
    """
    known = complete(rows.select("vec_id", "embedding", "label")).withColumn("usable", F.col("usable") & F.col("label").isNotNull())
    kept = known.where("usable").drop("usable")
    nodes = stored(kept.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).withColumn("width", F.size("embedding")))
    sizes = nodes.groupBy("label", "width").agg(F.count("*").alias("size")).select("label", "width", F.greatest(F.lit(shards), F.ceil(F.col("size") / shard_rows)).cast("int").alias("shards"), F.ceil(F.col("size") / query_rows).cast("int").alias("chunks"))
    dealt = nodes.join(sizes, ["label", "width"])

    def norm(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def build(key, table):
        label, width, shard = (k.as_py() for k in key)
        table = table.sort_by("node")
        x = norm(matrix(table.column("embedding"), width))
        graph = Graph(x, seed)
        graph.exact = x
        ef = graph.audited(threshold, beam, recall, sample)
        blob = pickle.dumps({"x": x, "start": graph.start, "top": graph.top, "layers": graph.layers, "ef": ef, "node": table.column("node").to_numpy(), "n": table.column("n").to_numpy()}, protocol=5)
        return pa.table({"label": pa.array([label], pa.int64()), "width": pa.array([width], pa.int32()), "shard": pa.array([shard], pa.int32()), "chunks": pa.array([table.column("chunks")[0].as_py()], pa.int32()), "graph": pa.array([blob], pa.binary())})

    own = dealt.withColumn("label", F.col("label").cast("long")).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    graphs = stored(own.select("label", "width", "shard", "chunks", "node", "n", "embedding").groupBy("label", "width", "shard").applyInArrow(build, "label long, width int, shard int, chunks int, graph binary"))

    def query(key, graph_table, table):
        width = key[1].as_py()
        ids, counts, a, b = [], [], [], []
        if graph_table.num_rows and table.num_rows:
            saved = pickle.loads(graph_table.column("graph")[0].as_py())
            graph = object.__new__(Graph)
            graph.exact, graph.x = saved["x"], saved["x"].astype(np.float32)
            graph.start, graph.top, graph.layers = saved["start"], saved["top"], saved["layers"]
            table = table.sort_by("node")
            mine = table.column("node").to_numpy()
            q = norm(matrix(table.column("embedding"), width))
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for v, found in zip(mine.tolist(), graph.linked(q, threshold, saved["ef"]), strict=True):
                other = found[saved["node"][found] != v]
                ids.append(v)
                counts.append(int(saved["n"][other].sum()))
                for w in saved["node"][other].tolist():
                    x, y = find(v), find(w)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(v)
                        b.append(w)
        none = [None] * len(ids)
        return pa.table({"node": pa.array(ids + [None] * len(a), pa.int64()), "linked": pa.array(counts + [None] * len(a), pa.int64()), "a": pa.array(none + a, pa.int64()), "b": pa.array(none + b, pa.int64())})

    left = graphs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asks = dealt.withColumn("label", F.col("label").cast("long")).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    keys = ["label", "width", "shard", "chunk"]
    found = stored(left.groupBy(*keys).cogroup(asks.select(*keys, "node", "embedding").groupBy(*keys)).applyInArrow(query, "node long, linked long, a long, b long"))
    links = found.where("node is not null").groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "member")
    classes = nodes.join(links, "node", "left").join(roots, nodes.node == roots.member, "left").select("label", "embedding", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    ids = kept.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "root")
    alone = known.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("root"))
    out = ids.union(alone)
    return out.select("vec_id", "n_links", F.col("root").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("root"), F.lit(True)).alias("kept"))
