"""Ranked lexical search turned round: the items' terms are the index, and the documents stream through it.

The inverted index of the items (term -> items that hold it, with their counts) is broadcast. Each task counts a
document's terms, looks up those that some item holds, adds their scores to the items in the terms' postings, and keeps
a heap of the best documents for every item; an item whose heap is full is touched again only by a document that reaches
its last score. The heaps of all tasks are merged, first among neighbouring tasks, then over all. Two passes read the
documents: one for the counts in the formula (N, L and the document frequencies of the items' terms), one for the scores.

An index holds at most about ``postings`` postings. Items with more are dealt by hash to several indexes, each of which
the documents pass through in turn, so what is broadcast does not grow with the items; what a task holds besides is
``k`` documents for each item of an index. Texts are split a slice at a time.

Rules: a null text has no terms; documents without terms count nowhere, and items without terms return no row; rows of
documents that share a doc_id, and repeated rows, are documents of their own; a document whose doc_id is null comes after
all others of its score; equal rows of items are one item, and rows that share an item_id only are ranked each by itself;
only doc_id, text and item_id, text are read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm import terms
from barloom.llm.common import documents, stored

KEPT = terms.table(digits=True)
#: Neighbouring tasks whose heaps are merged first.
NEIGHBOURS = 32


@dataclass
class Index:
    """Postings of term t: ``items`` and ``counts`` from ``starts[t]`` to ``starts[t + 1]``."""

    ids: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    counts: np.ndarray
    size: int

    def found(self, text: bytes) -> tuple[int, list[tuple[int, int]]]:
        """Number of terms of a text, repeats included, and (term, occurrences) for the terms that an item holds."""
        n, counts = 0, Counter()
        for part in terms.split(text, KEPT):
            n += len(part)
            counts.update(part)
        return n, [(self.ids[w], counts[w]) for w in counts.keys() & self.ids.keys()]

    def scores(self, at: np.ndarray, each: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Adds to ``total`` what the terms ``at`` bring, ``each`` an occurrence in the item; returns the items touched."""
        low, high = self.starts[at], self.starts[at + 1]
        long = high - low
        where = np.repeat(low - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(long.sum())
        items = self.items[where]
        np.add.at(total, items, np.repeat(each, long) * self.counts[where])
        return items


def index_of(rows: list[tuple[int, bytes, int]], size: int) -> Index:
    """Rows (item from 0, term, occurrences) -> index."""
    ids = {t: i for i, t in enumerate(sorted({t for _, t, _ in rows}))}
    at = np.array([ids[t] for _, t, _ in rows], np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(ids) + 1))
    return Index(ids, starts, np.array([i for i, _, _ in rows], np.int64)[order], np.array([n for *_, n in rows], np.int64)[order], size)


def length_weight(n: int, documents_: int, terms_: int) -> int:
    """m of a document with n terms: 75 and a quarter of its length in hundredths of the mean."""
    return 100 - 25 + (25 * n * documents_) // terms_


def statistics(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """(N, L, df by term of the index); all documents are counted."""

    def run(batches):
        index = shared.value
        df, with_terms, total = np.zeros(len(index.ids), np.int64), 0, 0
        for batch in batches:
            for text in terms.texts(batch):
                n, found = index.found(text)
                with_terms += n > 0
                total += n
                if found:
                    df[[t for t, _ in found]] += 1
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *on.tolist()], pa.int64()), pa.array([with_terms, total, *df[on].tolist()], pa.int64())], names=["term", "n"])

    found = dict(docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row per term of the index
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(t, 0) for t in range(len(shared.value.ids))], np.int64)


def heaps(docs: DataFrame, shared, n_docs: int, n_terms: int, weights: np.ndarray, k: int) -> DataFrame:
    """(part, item, doc_id, score): the k best documents of every item within each task."""

    def run(batches):
        index = shared.value
        best: list[list[tuple]] = [[] for _ in range(index.size)]
        floor, total = np.ones(index.size, np.int64), np.zeros(index.size, np.int64)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), terms.texts(batch), strict=True):
                n, found = index.found(text)
                if not found:
                    continue
                at, tf = np.array([t for t, _ in found], np.int64), np.array([c for _, c in found], np.int64)
                each = weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length_weight(n, n_docs, n_terms)))
                touched = index.scores(at, each, total)
                name = -doc if doc is not None else -math.inf
                for i in np.unique(touched[total[touched] >= floor[touched]]).tolist():
                    entry, heap = (int(total[i]), name), best[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[i] = heap[0][0]
                total[touched] = 0
        rows = [(i, None if d == -math.inf else -d, s) for i, heap in enumerate(best) for s, d in heap]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item int, doc_id long, score long").withColumn("part", F.spark_partition_id())


def merged(rows: DataFrame, k: int) -> DataFrame:
    """The k best of every item, with their rank from 1."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = Window.partitionBy("item", F.expr(f"part div {NEIGHBOURS}")).orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """(name, item_id, terms, counts): the different items that hold a term; ``name`` tells them apart."""

    def run(batches):
        for batch in batches:
            found = [sorted(Counter(w for part in terms.split(t, KEPT) for w in part).items()) for t in terms.texts(batch)]
            lists = pa.array([[w for w, _ in f] for f in found], pa.list_(pa.binary())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("item_id"), *lists], names=["name", "item_id", "terms", "counts"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    named = rows.select(F.sha2(F.concat_ws("\x1f", F.col("item_id").isNull().cast("string"), F.col("item_id").cast("string"), "text"), 256).alias("name"), "item_id", "text")
    return named.mapInArrow(run, f"name string, item_id {kind}, terms array<binary>, counts array<bigint>").where("size(terms) > 0")


def search(docs: DataFrame, items: DataFrame, k: int = 20, postings: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, those with a score above 0.

    Formula, as fixed by the query's contract: a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document scores
    the sum of w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, m as in ``length_weight``.

    ``postings``: size an index is meant to have; items are dealt by hash, so one may be somewhat larger.
    """
    spark = docs.sparkSession
    rows, asked = documents(docs), stored(item_terms(items))
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-size // postings))
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for part in range(parts):
        one = asked.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).orderBy("name").collect() if size else []
        if not one:
            continue
        index = index_of([(i, bytes(t), n) for i, r in enumerate(one) for t, n in zip(r.terms, r.counts, strict=True)], len(one))
        shared = spark.sparkContext.broadcast(index)
        n_docs, n_terms, df = statistics(rows, shared)
        if not n_docs:
            break
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        best = merged(heaps(rows, shared, n_docs, n_terms, weights, k), k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(one)], f"item int, item_id {kind}")
        found = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = stored(found) if parts > 1 else found
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
