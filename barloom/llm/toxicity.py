"""Toxicity scores from the nearest labelled examples.

Terms are lower-cased words and their beginnings of 3, 4 and 5 letters, and each of them marked where it makes up 1/128
or 1/64 of a text's words or more. Counts over all labelled training rows choose the
terms most of whose rows have the label, beyond chance (likelihood ratio against the number of terms tried). A bounded
sample of training rows, as TF-IDF vectors over these terms, is the example set; equal vectors are one entry with its
label counts. A text's nearest entries by cosine are found exactly: entries lie in blocks, every term knows its largest
weight in each block, and blocks whose bound cannot reach the k-th best are skipped. Votes fall with the distance and are
drawn towards the base rate, which makes the score a probability; the nearest examples are the evidence. A text without
any chosen term gets the rate of the examples without one.

Rules: a null text is empty and is scored; label rows without a label, or with another value than 0 and 1, are not
learnt from; of repeated label rows of a document the largest label counts; ties of cosine go to the earlier entry; only
doc_id and text of the documents are read; without training rows of both labels the score is the base rate, 0 if there is
none; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import documents, slices, stored

WORD = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5)


DENSE = ((128, "^"), (64, "^^"))
#: Bounds of what a worker remembers: words with their terms, bytes of vectors that it has scored.
MEMO_WORDS, TOLD_BYTES = 50_000, 2 << 20


def terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def term_counts(words: dict[str, int], known: dict[str, tuple[str, ...]] | None = None) -> dict[str, int]:
    """Counts of a text's terms, marked ones included; ``known``: the terms to count of each word."""
    out: dict[str, int] = {}
    for word, n in words.items():
        for t in terms(word) if known is None else known[word]:
            out[t] = out.get(t, 0) + n
    total = sum(words.values())
    return out | {t + mark: n for t, n in out.items() for share, mark in DENSE if n * share >= total}


def held_out(doc_id, folds: int = 3, fold: int = 1):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Examples:
    """Entries sorted by their strongest term, in blocks of ``block``; postings by term, and the largest weight of each term in each block."""

    vocabulary: dict[str, tuple[int, float]]
    rate: float
    bare: float
    ids: np.ndarray
    positive: np.ndarray
    total: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray]]
    largest: np.ndarray
    starts: np.ndarray
    block: int = 64

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.weights[at]
        return w / np.linalg.norm(w)

    def __post_init__(self) -> None:
        self.weights = np.array([w for _, w in sorted(self.vocabulary.values())])
        self.memo: dict[str, tuple[str, ...]] = {}
        self.told: dict[bytes, tuple[float, list[int]]] = {}
        self.held = 0
        self.bases = {t.rstrip("^") for t in self.vocabulary}

    def count(self, text: str) -> dict[int, int]:
        words, memo = Counter(WORD.findall(text.lower())), self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in words:
            if word not in memo:
                memo[word] = tuple(t for t in terms(word) if t in self.bases)
        return {self.vocabulary[t][0]: n for t, n in term_counts(words, memo).items() if t in self.vocabulary}

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines of the k nearest with a cosine above 0, exactly: blocks by falling bound, until none can reach the k-th best."""
        most = self.largest[at]
        bounds = w @ most
        order = np.argsort(-bounds, kind="stable")
        scores, floor, done = np.zeros(len(self.ids)), 0.0, 0
        while done < len(order) and bounds[order[done]] > 0 and bounds[order[done]] >= floor - 1e-9:
            part = order[done : done + step]
            terms_in, blocks_in = np.nonzero(most[:, part])
            entries, weights = [], []
            for t, block in zip(terms_in.tolist(), part[blocks_in].tolist(), strict=True):
                i = at[t]
                of, values = self.postings[i]
                low, high = self.starts[i, block], self.starts[i, block + 1]
                entries.append(of[low:high])
                weights.append(values[low:high] * w[t])
            scores += np.bincount(np.concatenate(entries), np.concatenate(weights), len(scores))
            done += step
            step *= 2
            floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0.0
        top = np.flatnonzero(scores >= floor - 1e-9) if floor > 0 else np.flatnonzero(scores > 0)
        top = top[np.argsort(-np.round(scores[top], 9), kind="stable")][:k]
        return top, np.minimum(scores[top], 1.0)

    def score(self, text: str, k: int, pull: float) -> tuple[float, list[int]]:
        counts = self.count(text)
        if not counts or not len(self.ids):
            return self.bare, []
        at, n = np.array(sorted(counts.items()), np.int64).T
        key = np.stack([at, n]).astype("<u4").tobytes()
        if key not in self.told:
            self.held += len(key)
            if self.held > TOLD_BYTES:
                self.told.clear()
                self.held = len(key)
            n = n.astype(float)
            top, cosine = self.nearest(at, self.vector(at, n), k)
            vote = cosine**4
            self.told[key] = float((vote @ self.positive[top] + pull * self.rate) / (vote @ self.total[top] + pull)), self.ids[top[:3]].tolist()
        return self.told[key]


def build(rows: list[tuple[int, int, int, np.ndarray, np.ndarray]], vocabulary: dict[str, tuple[int, float]], rate: float, block: int = 64) -> Examples:
    """Distinct vectors (smallest doc_id, positive, total, sorted terms, their counts) -> index."""
    index = Examples(vocabulary, rate, rate, np.zeros(0, np.int64), np.zeros(0), np.zeros(0), [], np.zeros((len(vocabulary), 0)), np.zeros((len(vocabulary), 1), np.int64), block)
    bare = [r for r in rows if not len(r[3])]
    index.bare = (sum(r[1] for r in bare) + rate) / (sum(r[2] for r in bare) + 1)
    vectors = [(at, index.vector(at, n), doc, p, t) for doc, p, t, at, n in rows if len(at)]
    vectors.sort(key=lambda v: (int(v[0][np.argmax(v[1])]), -float(v[1].max()), v[2]))
    index.ids = np.array([v[2] for v in vectors], np.int64)
    index.positive = np.array([v[3] for v in vectors], float)
    index.total = np.array([v[4] for v in vectors], float)
    index.largest = np.zeros((len(vocabulary), -(-len(vectors) // block)))
    if not vectors:
        return index
    terms_of, weights = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
    entries = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    np.maximum.at(index.largest, (terms_of, entries // block), weights)
    order = np.argsort(terms_of, kind="stable")
    ends = np.searchsorted(terms_of[order], np.arange(len(vocabulary) + 1))
    index.postings = [(entries[order[a:b]], weights[order[a:b]]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    blocks = np.arange(index.largest.shape[1] + 1) * block
    index.starts = np.array([np.searchsorted(e, blocks) for e, _ in index.postings], np.int32)
    return index


def fit(docs: DataFrame, labels: DataFrame, most_terms: int = 4096, most_examples: int = 20_000, share: float = 0.5) -> Examples:
    """Learns from documents with a label (doc_id, toxic), all of them for the counts, ``most_examples`` by hash for the examples.

    ``share``: of the rows with a term, how many have label 1 at least.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = stored(documents(docs).join(known.hint("shuffle_hash"), "doc_id"))  # one plan at every size; the labels are the hashed side

    def count(batches):
        counted: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array([x[0] for x in counted.values()], pa.int64()), pa.array([x[1] for x in counted.values()], pa.int64())], names=["term", "negative", "positive"])

        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for term in term_counts(Counter(WORD.findall(text.lower()))):
                    counted.setdefault(term, [0, 0])[label] += 1
                if len(counted) > 150_000:
                    yield out()
                    counted.clear()
        yield out()

    totals = dict(rows.groupBy("toxic").count().collect())
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    rate = positive / max(1, positive + negative)
    if not positive or not negative:
        return build([], {}, rate)
    table = stored(rows.select("text", "toxic").mapInArrow(count, "term string, negative long, positive long").groupBy("term").agg(F.sum("negative").alias("n"), F.sum("positive").alias("p")))
    tried = table.count()
    both = F.col("p") + F.col("n")
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    without_p, without_n, without = positive - F.col("p"), negative - F.col("n"), positive + negative - both
    ratio = 2 * (part(F.col("p"), both * rate) + part(F.col("n"), both * (1 - rate)) + part(without_p, without * rate) + part(without_n, without * (1 - rate)))
    chosen = table.where((F.col("p") > both * rate) & (F.col("p") >= both * share)).withColumn("ratio", ratio).where(F.col("ratio") > 2 * math.log(max(2, tried)) + 6).orderBy(F.desc("ratio"), "term").limit(most_terms).collect()
    vocabulary = {r.term: (i, math.log((1 + positive + negative) / (1 + r.p + r.n)) + 1) for i, r in enumerate(chosen)}
    shape = build([], vocabulary, rate)

    def vectors(batches):
        for batch in slices(batches):
            counts = [sorted(shape.count(t).items()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([[i for i, _ in c] for c in counts], pa.list_(pa.int32())), pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int32()))], names=["doc_id", "toxic", "at", "n"])

    last = rows.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(most_examples).agg(F.max("h")).first()[0]
    picked = rows.where(F.xxhash64("doc_id") <= F.lit(last)).select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, at array<int>, n array<int>")
    found = picked.groupBy("at", "n").agg(F.min("doc_id").alias("doc"), F.sum("toxic").alias("positive"), F.count("*").alias("total")).orderBy("doc").toArrow()  # most_examples rows at most
    lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (found.column("at").combine_chunks(), found.column("n").combine_chunks())]
    examples = [
        (doc, p, t, lists[0][0][a:b].astype(np.int64), lists[1][0][c : c + b - a].astype(float))
        for doc, p, t, a, b, c in zip(*(found.column(x).to_pylist() for x in ("doc", "positive", "total")), lists[0][1][:-1].tolist(), lists[0][1][1:].tolist(), lists[1][1][:-1].tolist(), strict=True)
    ]
    return build(examples, vocabulary, rate)


def score(docs: DataFrame, examples: Examples, k: int = 15, pull: float = 0.25, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, evidence): evidence holds up to three of the nearest examples."""

    def run(batches):
        for batch in slices(batches):
            found = [examples.score(t, k, pull) for t in batch.column("text").to_pylist()]
            p = [x for x, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=["doc_id", "score", "predicted", "evidence"])

    return documents(docs).mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>")


def clean_only(docs: DataFrame, examples: Examples, k: int = 15, pull: float = 0.25, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold."""

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([examples.score(t or "", k, pull)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
