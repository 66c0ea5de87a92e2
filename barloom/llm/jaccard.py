"""Exact Jaccard join of shingle sets by parity sketches.

Two sets of a and b elements are linked when 100 * intersection >= percent * union, which bounds their symmetric
difference by D = (a + b) * (100 - percent) / (100 + percent).

Sketches: within a size band every element is XOR-hashed into one of s words of 64 bits. Each element that only one set
has can change one word, so the number of differing words never exceeds the symmetric difference, and at least s - D words
agree. Of a document's s words, put in an order that depends on the word alone, the first D + 1 must then share a word
with the first D + 1 of its partner (the pigeonhole): these are its keys. The order puts words of elements that are rare
in the corpus first, and empty words last, so that a passage many documents share makes few common keys. A document also
visits the band below when a partner may stand there. A second sketch of single parity bits, whose Hamming distance is a
lower bound as well, discards candidates before the exact count.

Groups: texts with equal sets are one class. In each bucket of a key, members are compared with one centre, what links is
joined to components, and buckets that still hold several components are compared again with other centres. In the last
round, which is left out only where no bucket holds several, such buckets are joined with themselves across components, under the second sketch's bound, so only pairs that may
be linked come out. A bucket of near copies costs a star per round, and no link between components is lost.

Rules: a null or wordless text has an empty set and no link; fewer words than a shingle has are one shingle; repeated rows
are linked (J = 1); rows with a null doc_id are returned with no component; columns other than doc_id and text are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import components, documents, forget, slices, stored
from barloom.llm.shingles import mix, shingles

#: Cells in which shingles are counted for the words' order, bits of the second sketch, classes remembered by a task,
#: different centres that buckets of the same members get in a round.
CELLS, BITS, REMEMBER, CENTRES = 1 << 16, 1024, 20_000, 4


def allowed(total: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return total * (100 - percent) // (100 + percent)


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, keys): the band of n, and the one below when a set there can be large enough."""
    low = 1 << (n.bit_length() - 1)
    out = [(low, allowed(n + n * 100 // percent, percent) + 1)]
    if low > 1 and (low - 1) * 100 >= n * percent:
        out.append((low >> 1, allowed(n + low - 1, percent) + 1))
    return out


def keys(elements: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The pigeonhole keys of a set of distinct hashes; ``common``: per cell, whether its elements are frequent."""
    out = []
    rare = ~common[(elements >> np.uint64(48)).astype(np.int64)]
    for band, wanted in bands(len(elements), percent):
        words = max(1, band * 4 // 5)
        at = (elements % np.uint64(words)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        where = at[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        parity = np.bitwise_xor.reduceat(mix(elements[order] + np.uint64(band)), first)
        name = (np.uint64(band) << np.uint64(32)) + where[first].astype(np.uint64)
        key = mix(parity ^ mix(name))
        if wanted < len(key):
            count = np.diff(np.concatenate([first, [len(elements)]]))
            light = np.add.reduceat(rare[order].astype(np.int64), first)
            key = key[np.lexsort((key, -count, -light))[:wanted]]
        elif wanted > len(key):
            empty = np.setdiff1d(np.arange(words), where[first]).astype(np.uint64)
            more = np.sort(mix(~mix((np.uint64(band) << np.uint64(32)) + empty)))
            key = np.concatenate([key, more[: wanted - len(key)]])
        out.append(key)
    return np.concatenate(out)


def parity_bits(elements: np.ndarray) -> np.ndarray:
    """BITS parity bits as 64-bit numbers."""
    at = ((elements >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def possible(percent: int):
    """Condition on the columns n_a, n_b, bits_a and bits_b of a pair that every linked pair meets."""
    differ = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(BITS // 64)])
    bound = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (differ <= bound)


def _frequent(rows: DataFrame, width: int) -> np.ndarray:
    """Cells whose shingles stand out in the corpus; all documents are counted, a cell at a time."""

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            for h in shingles(batch.column("text").to_pylist(), width):
                cells += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=CELLS) if len(h) > CELLS // 8 else 0
                if len(h) <= CELLS // 8:
                    np.add.at(cells, (h >> np.uint64(48)).astype(np.int64), 1)
        on = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(cells[on])], names=["cell", "n"])

    cells = np.zeros(CELLS, np.int64)
    for cell, n in rows.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # a row per cell
        cells[cell] = n
    mean = cells.mean()
    return cells > 2 * mean + 8 * np.sqrt(mean)


def _profiles(rows: DataFrame, width: int, percent: int) -> DataFrame:
    common = _frequent(rows, width)

    def run(batches):
        seen: dict[bytes, None] = {}
        for batch in slices(batches):
            n, ids, bits, key = [], [], [], []
            known = batch.column("doc_id").is_valid().to_pylist()  # rows without a doc_id get no keys, so they do not stand for a class
            for h, has_id in zip(shingles(batch.column("text").to_pylist(), width), known, strict=True):
                u = np.unique(h)
                name = hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None
                n.append(len(u))
                ids.append(name)
                bits.append(parity_bits(u) if len(u) else None)
                key.append(keys(u, common, percent).view(np.int64) if len(u) and has_id and name not in seen else None)
                if has_id:
                    seen[name] = None
                if len(seen) > REMEMBER:
                    seen.pop(next(iter(seen)))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(key, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "class", "bits", "keys"])

    return stored(rows.mapInArrow(run, "doc_id long, n long, class binary, bits array<long>, keys array<long>"))


def _verified(pairs: DataFrame, rows: DataFrame, info: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of doc_ids that are linked: equal classes at once, the others by sketch and exact count."""
    left, right = (info.select(*[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "class", "bits")]) for s in "ab")
    known = pairs.join(left, pairs.a == left.doc_id_a).join(right, pairs.b == right.doc_id_b)
    equal = known.where("class_a = class_b").select("a", "b")
    near = stored(known.where(F.col("class_a") != F.col("class_b")).where(possible(percent)).select("a", "b"))

    def sets(batches):
        for batch in slices(batches):
            u = [np.unique(h).tobytes() for h in shingles(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(u, pa.binary())], names=["doc_id", "elements"])

    asked = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    elements = rows.where("doc_id is not null").join(asked, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, elements binary")
    both = near.join(elements.selectExpr("doc_id a", "elements x"), "a").join(elements.selectExpr("doc_id b", "elements y"), "b")

    def count(batches):
        for batch in slices(batches, "x", 4 << 20):
            on = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                on.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    found = stored(equal.union(both.select("a", "b", "x", "y").mapInArrow(count, "a long, b long")))
    forget(near)
    return found


def similar_groups(docs: DataFrame, percent: int = 80, width: int = 5, rounds: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row.

    component_id: the smallest doc_id reachable by links; it is the row's own where it has none. Rows that share a doc_id
    are one document for this. ``rounds``: rounds of centres before all remaining pairs across components are compared.
    """
    rows = documents(docs)
    base = _profiles(rows, width, percent)
    sizes = stored(base.select("doc_id", "n"))
    info = stored(base.where("doc_id is not null and n > 0").select("doc_id", "n", "class", "bits").dropDuplicates(["doc_id"]))
    keyed = base.where("doc_id is not null and keys is not null").select("doc_id", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("size")).where("low < high")
    met = stored(met)
    two = met.where("size = 2").select("key", F.explode(F.array("low", "high")).alias("doc_id"))
    more = keyed.join(met.where("size > 2").select("key"), "key").select("key", "doc_id").distinct()
    buckets = stored(two.union(more))
    first = base.where("doc_id is not null and n > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    same = base.where("doc_id is not null and n > 0").select("doc_id", "class").join(first, "class").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = stored(same)
    forget(met, base)
    asked = None
    turn = 0
    while turn <= rounds:
        roots = components(links)
        now = buckets.select("key", "doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        open_keys = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        if turn:
            now = now.join(open_keys, "key")
        now = stored(now.select("key", "doc_id", "root"))
        forget(buckets)
        buckets = now  # a key whose members are in one component stays so
        if turn and now.isEmpty():
            break
        if turn < rounds:
            pick = F.struct(F.xxhash64("doc_id", F.pmod("key", F.lit(CENTRES)), F.lit(turn)) if turn else F.lit(0).cast("long"), "doc_id", "root")
            centre = now.groupBy("key").agg(F.min(pick).alias("c")).select("key", F.col("c.doc_id").alias("centre"), F.col("c.root").alias("centre_root"))
            pairs = now.join(centre, "key").where("root <> centre_root").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))
        else:
            whole = now.join(info.select("doc_id", "n", "bits"), "doc_id")
            left, right = (whole.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "root", "n", "bits")]) for side in "ab")
            across = (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("root_a") != F.col("root_b"))
            pairs = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & across & possible(percent)).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
        pairs = pairs.distinct()
        if asked is not None:
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        asked = pairs if asked is None else asked.union(pairs)
        new = _verified(pairs, rows, info, width, percent)
        links = links.union(new)
        turn = rounds if 0 < turn < rounds and pairs.isEmpty() else turn + 1  # centres that repeat say nothing of the other pairs
    roots = components(links)
    return (
        sizes.select("doc_id", F.col("n").alias("n_shingles"))
        .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    )


def one_of_each_group(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group; rows with a null doc_id stay. Of rows that share a doc_id one stays."""
    groups = similar_groups(docs, percent, width)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*columns)  # one plan at every size
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    again = stored(again)
    return left.join(again, "doc_id", "left_anti").select(*columns).union(left.join(again, "doc_id", "left_semi").select(*columns).dropDuplicates(["doc_id"]))
