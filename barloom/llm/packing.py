"""Best-fit packing of documents into fixed-length token sequences, in bulk-synchronous steps.

Lengths and gaps are whole numbers up to the capacity. Pieces longer than half a sequence open one each. The rest goes
band by band, longest first. Every step range-sorts the open gaps, gives each gap a rank among its equals, and sweeps the
lengths downwards: a length takes the gaps that are its nearest successors, as many copies to a gap as fit, the pieces
and gaps of equal size meeting by rank, so no two pieces want one place. Then the gaps are updated and sorted anew, until
the band is placed; a length that no gap can take any more opens new sequences. Rows are ranked, matched and updated in
distributed tables; the sweep itself sees two counts per size, so what reaches the driver is bounded by the capacity.

Rules: a null text is empty, and an empty document is its end id alone; repeated rows are packed each; ties of length go
by doc_id and start; columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm import bpe
from barloom.llm.common import documents, slices, stored, tasks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_ids(text: str, encoder, special: dict[str, int]) -> np.ndarray:
    """Ids of a text in which a string of ``special`` is one token wherever it stands."""
    for word, token in special.items():
        if word in text:
            parts = [token_ids(x, encoder, {}) for x in text.split(word)]
            return np.concatenate([y for x in parts for y in ([token], x)][1:]).astype(np.uint32)
    return encoder.encode_to_numpy(text, disallowed_special=())


def cut(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], end: int, capacity: int) -> DataFrame:
    """The pieces of every document: one, or where it is longer than a sequence, a first shorter one and full ones."""
    if len(special) > 1:
        raise ValueError("one special string at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe._encoder(ranks, pattern)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(token_ids(text, encoder, special), end).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, PIECES)


def ranked(rows: DataFrame, size: str, order: list[str], parts: int) -> tuple[DataFrame, dict[int, int]]:
    """Range-sorts and adds ``rank``: the place among the rows of equal size, from 0. Also the number of rows per size.

    A range partition spans neighbouring sizes, so partitions and sizes meet in no more than partitions + sizes
    combinations; only counts of these come to the driver and go back as a broadcast table.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts, size, *order) if parts > 1 else rows.coalesce(1)
    kept = stored(dealt.sortWithinPartitions(size, *order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    numbers: dict[int, int] = {}
    shift = []
    for part, s, n, first in kept.groupBy("part", size).agg(F.count("*"), F.min("at")).orderBy("part", size).collect():
        shift.append((part, s, numbers.get(s, 0) - first))
        numbers[s] = numbers.get(s, 0) + n
    table = spark.createDataFrame(shift, f"part int, {size} long, shift long")
    return kept.join(F.broadcast(table), ["part", size]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift"), numbers


def sweep(left: np.ndarray, gaps: np.ndarray, band: range, capacity: int, wait: bool) -> tuple[list[tuple], list[tuple]]:
    """Matches counts per length with counts per gap; ``left`` is lowered by what was placed.

    Returns matches (length, pieces placed, copies to a gap, gap, first gap rank, gaps used) in the order in which the
    pieces' ranks are taken, and openings (length, pieces, copies to a sequence). With ``wait``, pieces stay for the next
    sweep where a gap used in this one can still take one of them.
    """
    free, taken, rest = gaps.copy(), np.zeros_like(gaps), 0
    matches, openings = [], []
    for s in band:
        n = int(left[s])
        for g in s + np.flatnonzero(free[s:]) if n else ():
            k = int(g) // s
            use = min(int(free[g]), -(-n // k))
            placed = min(n, use * k)
            matches.append((s, placed, k, int(g), int(taken[g]), use))
            rest = max(rest, g - s * (placed - (use - 1) * k), g - s * k if use > 1 else 0)
            taken[g] += use
            free[g] -= use
            n -= placed
            if not n:
                break
        if n and (rest < s or not wait):
            openings.append((s, n, capacity // s))
            rest = max(rest, capacity - s * ((n - 1) % (capacity // s) + 1))
            n = 0
        left[s] = n
    return matches, openings


def bands(capacity: int) -> list[range]:
    """Half the capacity down to 1, each band reaching to 0.6 of its longest; the shortest 1/32 are one band."""
    out, high = [], capacity // 2
    while high > 0:
        low = int(high * 0.6) if high > capacity // 32 else 0
        out.append(range(high, low, -1))
        high = low
    return out


def pack(pieces: DataFrame, capacity: int = 1024, waits: int = 1, rows_per_task: int = 500_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length of 1 to ``capacity``).

    ``waits``: sweeps of a band after which its pieces no longer wait for a used gap and open a sequence.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    kept = stored(pieces)
    parts = max(1, min(tasks(spark), -(-kept.count() // rows_per_task)))
    items, sizes = ranked(kept, "length", ["doc_id", "start", "piece"], parts)
    if any(not 0 < s <= capacity for s in sizes):
        raise ValueError("a piece is longer than a sequence or has no length")
    items = stored(items)
    left = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        left[s] = n

    def table(rows: list[tuple], columns: str) -> DataFrame:
        """Lines of the plan: no more in a sweep than sizes of pieces and gaps together."""
        return F.broadcast(spark.createDataFrame(rows, columns))

    def opened(lines: list[tuple]) -> DataFrame:
        """Pieces that stand in sequences opened for their length, ``k`` in each, from number ``bin``."""
        rows = items.join(table(lines, "length long, low long, high long, k long, bin long"), "length").where("rank >= low and rank < high")
        return rows.withColumn("step", F.col("rank") - F.col("low")).withColumn("bin", F.col("bin") + F.expr("step div k"))

    def opened_gaps(lines: list[tuple]) -> DataFrame:
        rows = opened(lines).where("step % k = 0")
        return rows.select("bin", (capacity - F.least("k", F.col("high") - F.col("rank")) * F.col("length")).alias("gap"))

    long = [s for s in range(capacity, capacity // 2, -1) if left[s]]
    first = np.concatenate([[0], np.cumsum(left[long])]).tolist()
    made = int(first[-1])
    fresh = [(s, 0, int(left[s]), 1, b) for s, b in zip(long, first, strict=False)]
    left[capacity // 2 + 1 :] = 0
    done, opens, moves, stands = np.zeros_like(left), list(fresh), [], []
    gaps = spark.createDataFrame([], "bin long, gap long")
    for band in bands(capacity):
        sweeps = 0
        while any(left[s] for s in band):
            shortest = int(np.flatnonzero(left)[0])
            if fresh:
                gaps = gaps.union(opened_gaps(fresh))
            at, have = ranked(gaps.where(F.col("gap") >= shortest), "gap", ["bin"], parts)
            counts = np.zeros_like(left)
            for g, n in have.items():
                counts[g] = n
            matches, openings = sweep(left, counts, band, capacity, sweeps < waits)
            sweeps += 1
            by, fresh = [], []
            for s, n, k, g, rank, use in matches:
                moves.append((s, int(done[s]), int(done[s]) + n, k, len(stands), g, rank))
                by.append((g, rank, rank + use, k, s, n))
                done[s] += n
            for s, n, k in openings:
                fresh.append((s, int(done[s]), int(done[s]) + n, k, made))
                done[s] += n
                made += -(-n // k)
            opens += fresh
            lines = table(by, "by long, low long, high long, k long, length long, n long")
            hit = at.join(lines, (F.col("gap") == F.col("by")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
            stands.append(hit.where("by is not null").select(F.lit(len(stands)).cast("long").alias("turn"), "gap", "rank", "bin"))
            filled = F.least("k", F.col("n") - (F.col("rank") - F.col("low")) * F.col("k")) * F.col("length")
            gaps = hit.select("bin", (F.col("gap") - F.coalesce(filled, F.lit(0))).alias("gap"))
    alone = opened(opens).select(*names, F.col("bin").alias("sequence_id"), (F.col("step") % F.col("k") * F.col("length")).alias("offset"))
    if not stands:
        return alone
    to = items.join(table(moves, "length long, low long, high long, k long, turn long, gap long, gap_rank long"), "length").where("rank >= low and rank < high")
    to = to.withColumn("step", F.col("rank") - F.col("low")).withColumn("rank", F.col("gap_rank") + F.expr("step div k"))
    joined = to.join(functools.reduce(DataFrame.union, stands), ["turn", "gap", "rank"])
    return alone.union(joined.select(*names, F.col("bin").alias("sequence_id"), (capacity - F.col("gap") + F.col("step") % F.col("k") * F.col("length")).alias("offset")))


def pack_documents(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], end: int, capacity: int = 1024) -> DataFrame:
    """Cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(docs, ranks, pattern, special, end, capacity), capacity)
