"""Nearest vectors by inner product from randomly rotated one-bit codes.

Vectors lie in blocks. A block subtracts its mean from each vector, scales the rest to length 1, rotates it at random and
keeps the signs as packed bits, with two scalars: the length, and how well the signs point along the rotated vector. The
signs' inner product with a rotated query, divided by that second scalar, is an unbiased estimate whose error is bounded,
with a chosen confidence, by the scalar alone. A vector is reranked on its original numbers if its upper bound reaches the
k-th best lower bound of its block. Queries meet every block; each meeting returns its k best, and the best of these are
the result.

Rules: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do rows without an id;
vectors of different width are not compared; a query's own id is no candidate; equal scores go to the smaller id;
repeated rows are candidates each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import stored
from barloom.llm.vectors import matrix, usable

CODES = "width int, block int, ids binary, vectors binary, bits binary, length binary, along binary, mean binary"
FOUND = "query_id long, vec_id long, score double"


@functools.lru_cache(maxsize=4)
def rotation(width: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Packed signs, lengths, and inner products of the unit vectors with their signs' direction; and the mean."""
    mean = x.mean(0)
    rest = x - mean
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ rotation(x.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(x.shape[1]), mean


def bounds(q: np.ndarray, bits: np.ndarray, length: np.ndarray, along: np.ndarray, mean: np.ndarray, seed: int, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of queries x vectors, and the half widths of their intervals."""
    width = q.shape[1]
    signs = np.unpackbits(bits, axis=1, count=width).astype(np.float32) * 2 - 1
    turned = (q @ rotation(width, seed).T).astype(np.float32)
    size = np.linalg.norm(q, axis=1)
    safe = np.where(along > 0, along, 1)
    estimate = (q @ mean)[:, None] + (turned @ signs.T) * (length / (safe * np.sqrt(width)))
    spread = np.sqrt(np.maximum(0, 1 - along**2)) / safe * sigmas / np.sqrt(max(1, width - 1))
    half = size[:, None] * (length * (spread + 1e-5))[None, :] + 1e-5 * size[:, None] * (np.linalg.norm(mean) + 1e-30)
    return estimate, half


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search(rows: DataFrame, is_query: Column, k: int = 20, block_rows: int = 16_384, query_rows: int = 1024, sigmas: float = 4.0, seed: int = 17) -> DataFrame:
    """(query_id, rank, vec_id, score) for every usable row that ``is_query`` marks."""
    kept = usable(rows).select("vec_id", "embedding", is_query.alias("asks")).withColumn("width", F.size("embedding"))
    n, asked = kept.agg(F.count("*"), F.count_if("asks")).first()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))

    def code(key, table):
        width, block = (x.as_py() for x in key)
        x = matrix(table.column("embedding"), width)
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        x = x[order]
        bits, length, along, mean = encode(x, seed)
        values = [table.column("vec_id").to_numpy()[order], x, bits, length, along, mean]
        return pa.table({"width": pa.array([width], pa.int32()), "block": pa.array([block], pa.int32())} | {c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in zip(("ids", "vectors", "bits", "length", "along", "mean"), values, strict=True)})

    codes = stored(kept.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("width", "block").applyInArrow(code, CODES))

    def meet(key, table, queries):
        width = key[0].as_py()
        ids, vecs, scores = [], [], []
        if table.num_rows and queries.num_rows:
            row = table.to_pylist()[0]
            own = np.frombuffer(row["ids"], np.int64)
            x = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
            bits = np.frombuffer(row["bits"], np.uint8).reshape(len(own), -1)
            length, along, mean = (np.frombuffer(row[c], np.float64) for c in ("length", "along", "mean"))
            asking, q = queries.column("vec_id").to_numpy(), matrix(queries.column("embedding"), width)
            for s in range(0, len(q), 128):
                estimate, half = bounds(q[s : s + 128], bits, length, along, mean, seed, sigmas)
                for i in range(len(estimate)):
                    name = asking[s + i]
                    other = own != name
                    low = np.where(other, estimate[i] - half[i], -np.inf)
                    floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                    at = np.flatnonzero(other & (estimate[i] + half[i] >= floor))
                    exact = x[at] @ q[s + i]
                    top = best(exact, own[at], k)
                    ids.append(np.full(len(top), name))
                    vecs.append(own[at][top])
                    scores.append(exact[top])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query_id": join(ids, pa.int64()), "vec_id": join(vecs, pa.int64()), "score": join(scores, pa.float64())})

    left = codes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = kept.where("asks").withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("width", "block", "chunk").cogroup(right.select("width", "block", "chunk", "vec_id", "embedding").groupBy("width", "block", "chunk")).applyInArrow(meet, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
