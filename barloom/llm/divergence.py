"""Audit of how sources of a language differ in their terms, over hash-consed segment trees of term counts.

Counting: every task counts terms and the documents that hold them by (lang, source, term); partial counts are summed,
and a language keeps the terms that enough of its documents hold. Its kept terms are dealt by hash to chunks of about
``chunk`` terms, and within a chunk they get ids by falling count, so that rare terms, and with them equal counts, stand
side by side.

Trees: over a chunk's ids every source has a segment tree whose leaves are its counts. Nodes are hash-consed bottom-up
over all sources at once: a node's number stands for the pair of its children's numbers, so subtrees with equal counts
are one node, whoever they belong to. Two sources are compared by walking both trees from the root level by level; equal
pairs of nodes are met once, with the number of times they stand for, and so every different pair of counts is priced
once. Prices are whole numbers and add up over chunks, so a chunk is a task's work and a language has as many tasks as
chunks. Sources of a language come in blocks, and a task sees two blocks at most.

Rules: null text, lang and source are ''; a group without kept terms takes part with counts of 0; a language without kept
terms has pairs of value 0; repeated rows and rows that share a doc_id are documents of their own; only text, lang and
source are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm import terms
from barloom.llm.common import stored

KEPT = terms.table(digits=False)
SCALE = 1_000_000_000
#: Counted terms that a task holds before it passes them on.
HELD = 200_000
#: Rounds of long division by a factor of 1,000 each that make up SCALE.
STEPS = 3


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row without a term tells that its group occurs."""

    def run(batches):
        occurs: dict[tuple, Counter] = {}
        holds: dict[tuple, Counter] = {}

        def out():
            for group, words in occurs.items():
                names = [None, *words]
                n = [0, *words.values()]
                held = [0, *map(holds[group].__getitem__, words)]
                yield pa.RecordBatch.from_arrays([pa.array([group[0]] * len(names)), pa.array([group[1]] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(held, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            occurs.clear()
            holds.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), terms.texts(batch), strict=True):
                words, held = occurs.setdefault((lang, source), Counter()), holds.setdefault((lang, source), Counter())
                size -= len(words)
                seen: set[bytes] = set()
                for part in terms.split(text, KEPT):
                    words.update(part)
                    seen.update(part)
                held.update(seen)
                size += len(words)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total), by long division, so that counts up to 9e15 stay within 64 bits."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(STEPS):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def cons(counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Counts (trees x ids) -> roots by tree, children by level, leaf values.

    ``children[k][node]`` is the pair of numbers, one level down, that the node stands for; the last level's numbers are
    places in the leaf values. Ids are filled up to a power of two with leaves of count -1, which have no price.
    """
    width = 1 << max(0, (counts.shape[1] - 1).bit_length())
    full = np.full((len(counts), width), -1, np.int64)
    full[:, : counts.shape[1]] = counts
    values, nodes = np.unique(full, return_inverse=True)
    nodes, children = nodes.reshape(full.shape), []
    while nodes.shape[1] > 1:
        n = int(nodes.max()) + 1
        pairs, at = np.unique(nodes[:, ::2] * n + nodes[:, 1::2], return_inverse=True)
        children.append(np.stack(np.divmod(pairs, n), axis=1))
        nodes = at.reshape(len(counts), -1)
    return nodes[:, 0], children[::-1], values


def met(a: int, b: int, children: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walks two trees at once: (counts of a, counts of b, times) for every different pair of leaves."""
    left, right, times = np.array([a]), np.array([b]), np.array([1])
    for level in children:
        below = int(level.max()) + 1
        pairs, at = np.unique((level[left] * below + level[right]).ravel(), return_inverse=True)
        times = np.bincount(at, np.repeat(times, 2), len(pairs)).astype(np.int64)
        left, right = np.divmod(pairs, below)
    on = values[left] >= 0
    return values[left[on]], values[right[on]], times[on]


def compared(key: tuple, table: pa.Table, top: int) -> pa.Table:
    """One chunk of a language and one pair of source blocks: header rows (term null, n the source's total) and counts."""
    lang, _, low, high = (k.as_py() for k in key)
    rows = {c: table.column(c).combine_chunks() for c in table.column_names}
    head = rows["term"].is_null().to_numpy(zero_copy_only=False)
    heads = table.filter(pa.array(head)).sort_by("source").to_pydict()
    sources, totals = heads["source"], np.array(heads["n"], np.int64)
    kept, width = heads["kept"][0], heads["width"][0]
    place = {s: i for i, s in enumerate(sources)}
    coded = rows["term"].filter(pa.array(~head)).dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    code, n, lang_n = coded.indices.to_numpy(zero_copy_only=False), rows["n"].to_numpy()[~head], rows["lang_n"].to_numpy()[~head]
    whole = np.zeros(len(names), np.int64)
    whole[code] = lang_n
    order = sorted(range(len(names)), key=lambda i: (-whole[i], names[i]))
    to = np.zeros(len(names), np.int64)
    to[order] = np.arange(len(names))
    names, whole = [names[i] for i in order], whole[order]
    counts = np.zeros((len(sources), width), np.int64)
    own = rows["source"].filter(pa.array(~head)).dictionary_encode()
    if len(code):
        counts[np.array([place[s] for s in own.dictionary.to_pylist()])[own.indices.to_numpy(zero_copy_only=False)], to[code]] = n
    out = []
    roots, children, values = cons(counts) if width else ([], [], [])
    blocks = heads["block"]
    for a in range(len(sources)):
        for b in range(a + 1, len(sources)):
            if low != high and blocks[a] == blocks[b]:
                continue
            there, back = 0, 0
            if width:
                x, y, times = met(roots[a], roots[b], children, values)
                p, q = shares(x, totals[a] + kept), shares(y, totals[b] + kept)
                there, back = int((price(p, q) * times).sum()), int((price(q, p) * times).sum())
            out += [(sources[a], "pair", sources[b], there), (sources[b], "pair", sources[a], back)]
        on = np.flatnonzero(counts[a, : len(names)]) if low == high else ()
        if len(on):
            p, q = shares(counts[a, on], totals[a] + kept), shares(whole[on], heads["lang_n"][0] + kept)
            more = p > q
            best = sorted(zip((-price(p, q)[more]).tolist(), on[more].tolist(), strict=True), key=lambda x: (x[0], names[x[1]]))[:top]
            out += [(sources[a], "term", names[i].decode(), -f) for f, i in best]
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array([lang] * len(out), pa.string()), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)]], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least: int = 3, top: int = 200, chunk: int = 8192, block: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: how far a source's term shares stand from those of each other source of its language, over all kept
    terms. Part ``term``: the ``top`` terms that a source uses more than its language does. ``least``: documents that a
    kept term is in.
    """
    rows = stored(counted(docs))
    of = Window.partitionBy("lang", "term")
    lead = {"held": F.sum("docs").over(of), "lang_n": F.sum("n").over(of), "first": F.min("source").over(of)}
    kept = stored(rows.where("term is not null").withColumns(lead).where(F.col("held") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first")).cast("int").alias("first")))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = rows.select("lang", "source").distinct().withColumn("block", F.floor(number / block).cast("int")).withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "kept", "lang_n")}
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero)
    groups = stored(groups.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("kept") / chunk)).cast("int")))
    there = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk")
    terms_of = kept.join(groups.select("lang", "source", "block", "blocks", "chunks"), ["lang", "source"]).select("lang", there, "source", "block", "blocks", "term", "n", "lang_n", "first")
    widths = terms_of.groupBy("lang", "chunk").agg(F.sum("first").alias("width"))
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "source", "block", "blocks", F.lit(None).cast("string").alias("term"), "n", "lang_n", "kept").join(widths, ["lang", "chunk"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    both = heads.unionByName(terms_of.drop("first"), allowMissingColumns=True)
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("low"), F.greatest("block", k).alias("high")))
    dealt = both.withColumn("meets", F.explode(meets)).select("*", "meets.low", "meets.high").drop("meets", "blocks")
    found = dealt.groupBy("lang", "chunk", "low", "high").applyInArrow(lambda key, table: compared(key, table, top), "lang string, source string, part string, item string, value long")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    return summed.where(F.when(F.col("part") == "term", F.col("rank") <= top).otherwise(True))
