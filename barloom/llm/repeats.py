"""Removal of long byte strings that occur more than once, by a distributed merge sort of suffixes.

Which suffixes are sorted: of every window of ``length`` bytes the k-gram with the smallest hash is its anchor, so equal
windows have equal anchors at the same distance, and a document has about two anchors per length - k bytes. An anchor
stands for the run of windows it was chosen by. Anchors whose k-gram is met once in all documents need no sorting.

How: each block of documents sorts its anchors' suffixes (what its windows reach to the right; the reversed left context
is carried), keeps one entry per distinct neighbourhood, front-codes the run, and sends each range of it to one task. The
task merges its runs with a loser tree whose nodes remember the prefix they share with the last winner: two contenders
with different shared lengths are decided by these alone, and otherwise compared from the shared length on. The merged
order yields common prefixes of neighbours; suffixes that share a k-gram form a group, in which for every distance a
window repeats if another entry agrees to the right and to the left. Both are runs of sorted orders, so no pairs arise.

Where passages are counted in words, each word is a hash of WORD_BYTES bytes and the same is done with these: what is
found there and spans whole words stands for the words.

Rules: text is taken as UTF-8 bytes, a null text is empty; texts shorter than ``length`` lose nothing; matches never
cross documents; repeated rows repeat each other, so rows of ``length`` bytes or more lose all; columns other than
doc_id and text are passed on, except those named like the results, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from barloom.llm.common import forget, stored, tasks
from barloom.llm.shingles import BATCH, powers, word_codes, word_edges

#: Bits of a key that hold a position, so the longest stretch hashed at once; bytes that stand for a word where words are counted.
POSITION_BITS, WORD_BYTES = 24, 5


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k bytes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Texts laid end to end, each at least ``length`` long -> anchors' position, hash, first and last window start."""
    h = gram_hashes(data, k)
    low = np.uint64((1 << POSITION_BITS) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, size = length - k + 1, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: len(m) - (width - size)], m[width - size :]) if width > size else m
    inside = np.ones(len(m) + 1, bool)
    inside[-1] = False
    for e in ends[:-1].tolist():
        inside[e - length + 1 : e] = False
    new = np.empty(len(m) + 1, bool)
    new[0], new[-1] = True, True
    new[1:-1] = (m[1:] != m[:-1]) | (inside[1:-1] != inside[:-2])
    first = np.flatnonzero(new)
    first, last = first[:-1], first[1:] - 1
    on = inside[first]
    first, last = first[on], last[on]
    at = (m[first] & low).astype(np.int64)
    return at, h[at], first, last


def text_anchors(texts: list[bytes], length: int, k: int):
    """(text index, anchor, hash, first window, last window) arrays, positions counted in the text; batch by batch."""
    batch, size = [], 0
    reach = (1 << POSITION_BITS) - 1

    def flush():
        data = np.frombuffer(b"".join(x for _, _, x in batch), np.uint8)
        ends = np.cumsum([len(x) for _, _, x in batch])
        at, h, first, last = anchors(data, ends, length, k)
        which = np.searchsorted(ends, first, "right")
        shift = np.array([s for _, s, _ in batch])[which] - np.concatenate([[0], ends[:-1]])[which]
        return np.array([i for i, _, _ in batch])[which], at + shift, h, first + shift, last + shift

    for i, text in enumerate(texts):
        for s in range(0, max(1, len(text) - length + 1), reach - length):
            part = text[s : s + reach - 1] if len(text) > reach else text
            if len(part) < length:
                continue
            if batch and size + len(part) > BATCH:
                yield flush()
                batch, size = [], 0
            batch.append((i, s, part))
            size += len(part)
    if batch:
        yield flush()


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 8
    while low + step < high and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_code(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, left context, windows before, flag, entry) -> shared lengths, rests and contexts."""
    rests, lcps, before = [], [], b""
    for suffix, *_ in entries:
        n = shared(before, suffix)
        lcps.append(n)
        rests.append(suffix[n:])
        before = suffix
    fields = np.array([[n, len(r), len(e[1]), e[2], e[3], e[4]] for n, r, e in zip(lcps, rests, entries, strict=True)], "<i4")
    return zstandard.compress(struct.pack("<I", len(entries)) + fields.tobytes() + b"".join(rests) + b"".join(e[1] for e in entries), 3)


def front_decode(blob: bytes) -> tuple[list[int], list[tuple[bytes, bytes, int, int, int]]]:
    raw = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    fields = np.frombuffer(raw, "<i4", n * 6, 4).reshape(n, 6).tolist()
    at, left = 4 + 24 * n, 4 + 24 * n + sum(f[1] for f in fields)
    out, before = [], b""
    for lcp, rest, context, windows, flag, entry in fields:
        before = before[:lcp] + raw[at : at + rest]
        out.append((before, raw[left : left + context], windows, flag, entry))
        at, left = at + rest, left + context
    return [f[0] for f in fields], out


def merge(runs: list[tuple[list[int], list[tuple]]]):
    """Loser tree over sorted runs (shared lengths, entries): yields (length shared with the one before, run, entry).

    A contender's number is the prefix it shares with the last winner. The larger number is the smaller suffix; equal
    numbers are compared from there on, and the loser then keeps what it shares with its new winner.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads = [0] * width
    texts = [run[1][0][0] if run[1] else None for run in runs] + [None] * (width - len(runs))
    share = [0] * width
    losers = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = texts[a], texts[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = share[a], share[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = shared(x, y, p)
        if n == len(x) or n < len(y) and x[n] < y[n]:
            share[b] = n
            return a, b
        share[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if width > 1 else 0
    while texts[top] is not None:
        lcps, entries = runs[top]
        yield share[top], top, entries[heads[top]]
        heads[top] += 1
        if heads[top] < len(entries):
            texts[top], share[top] = entries[heads[top]][0], lcps[heads[top]]
        else:
            texts[top] = None
        node = (top + width) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated_distances(suffixes: list[bytes], lcps: list[int], lefts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Entries of one k-gram in suffix order -> per entry the distances (first, last) from window start to anchor that repeat.

    ``lcps[i]``: what entry i shares with entry i - 1. Both orders' runs change at known distances only.
    """
    n = len(suffixes)
    order = sorted(range(n), key=lambda i: lefts[i])
    near = [shared(lefts[order[i - 1]], lefts[order[i]]) for i in range(1, n)]
    if n == 2:
        span = (length - lcps[1], near[0])
        return [[span], [span]] if span[0] <= span[1] else [[], []]
    right, left, place = np.array(lcps[1:]), np.array(near), np.array(order)
    points = np.unique(np.concatenate([[0], length - right, left + 1]))
    points = points[(points >= max(0, length - int(right.max()))) & (points <= int(left.max()))]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    run = np.empty(n, np.int64)
    for j, o in enumerate(points.tolist()):
        last = int(points[j + 1]) - 1 if j + 1 < len(points) else int(left.max())
        code = np.concatenate([[0], np.cumsum(right < length - o)]) * n
        run[place] = np.concatenate([[0], np.cumsum(left < o)])
        code += run
        by = np.argsort(code, kind="stable")
        same = code[by][1:] == code[by][:-1]
        hit = np.zeros(n, bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        for i in np.flatnonzero(hit).tolist():
            if out[i] and out[i][-1][1] == o - 1:
                out[i][-1] = (out[i][-1][0], last)
            else:
                out[i].append((o, last))
    return out


def _sorted_texts(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """A block's rows in an order that depends on the rows alone."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table, [x.encode() for x in table.column("text").to_pylist()]


def whole_words(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of a text's word codes -> bytes from the first word that lies in a run whole to the last."""
    start, stop = word_edges(np.frombuffer(text + b" ", np.uint8))
    words = [(-(-a // WORD_BYTES), b // WORD_BYTES) for a, b in runs]
    return [(int(start[a]), int(stop[b - 1])) for a, b in words if a < b]


def joined(runs: list) -> list[tuple[int, int]]:
    """Runs in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, runs)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


#: Columns that hold a document's block and the runs found so far; other columns keep their names.
BLOCK, RUNS = "__block", "__runs"


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 64, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary): what is left of each text."""
    return _remove(docs, length, k, block_bytes).drop(RUNS)


def _remove(docs: DataFrame, length: int, k: int, block_bytes: int, by_words: bool = False, used: list[DataFrame] | None = None) -> DataFrame:
    """remove_repeats with the removed runs in RUNS; runs that docs has in RUNS already are removed, too.

    ``by_words``: matches are of whole words, each of which is WORD_BYTES of ``length`` and ``k``. ``used`` gets the tables that the result is read from.
    """
    if not 8 <= k <= length < 1 << (POSITION_BITS - 1):
        raise ValueError("a k-gram has 8 bytes at least and fits the length")
    spark = docs.sparkSession
    results = ["n_bytes", "n_removed", "n_spans", "kept"]
    rows = docs.drop(*results).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    if RUNS not in rows.columns:
        rows = rows.withColumn(RUNS, F.lit(None).cast("binary"))
    size = F.octet_length("text").cast("long")
    least = 2 * (length // WORD_BYTES) - 1 if by_words else length  # a word and a space have two bytes
    code = (lambda x: word_codes(x, WORD_BYTES)) if by_words else bytes
    alone = (size < least) & (F.coalesce(F.octet_length(RUNS), F.lit(0)) == 0)
    short = rows.where(alone).withColumns({"n_bytes": size, "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": F.encode("text", "utf-8")})
    long = rows.where(~alone)
    blocks = max(1, -(-int(long.agg(F.sum(size)).first()[0] or 0) // block_bytes))
    long = long.withColumn(BLOCK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def count(batches):
        """Distinct k-gram hashes of a batch's anchors, their number, and the k-grams' first bytes for the splitters."""
        for batch in batches:
            texts, which = [code(x.encode()) for x in batch.column("text").to_pylist()], np.array(batch.column("block").to_pylist())
            for of, at, h, _, _ in text_anchors(texts, length, k):
                start = np.array([int.from_bytes(texts[i][p : p + 8], "big") >> 1 for i, p in zip(of.tolist(), at.tolist(), strict=True)], np.int64)
                key = np.rec.fromarrays([which[of].astype(np.int32), h.view(np.int64), start], names="block,hash,start")
                one, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one["block"]), pa.array(one["hash"]), pa.array(one["start"]), pa.array(n.astype(np.int64))], names=["block", "hash", "start", "n"])

    met = stored(long.select(F.col(BLOCK).alias("block"), "text").mapInArrow(count, "block int, hash long, start long, n long"))
    often = met.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    wanted = stored(met.join(often, "hash").groupBy("block", "hash").agg(F.min("start").alias("start")))
    entries = wanted.count()
    ranges = max(1, min(4096, max(tasks(spark), entries // 100_000)))
    cuts = wanted.agg(F.percentile_approx("start", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts if ranges > 1 else [], np.int64))

    def sort(key, docs_table, hashes):
        """One block's sorted run, front-coded and cut at the splitters; range -1 has where the entries stand."""
        texts = [code(x) for x in _sorted_texts(docs_table)[1]]
        block = key[0].as_py()
        keep = np.sort(hashes.column("hash").to_numpy())
        found: dict[tuple[bytes, bytes, int], list[int]] = {}
        for of, at, h, first, last in text_anchors(texts, length, k) if len(keep) else ():
            on = np.flatnonzero(keep[np.minimum(np.searchsorted(keep, h.view(np.int64)), len(keep) - 1)] == h.view(np.int64))
            for i, a, s, e in zip(of[on].tolist(), at[on].tolist(), first[on].tolist(), last[on].tolist(), strict=True):
                found.setdefault((texts[i][a : e + length], texts[i][s:a][::-1], a - e), []).extend((i, a))
        order = sorted(found)
        parts: dict[int, list] = {}
        for n, (suffix, left, before) in enumerate(order):
            to = int(np.searchsorted(cuts, int.from_bytes(suffix[:8], "big") >> 1, "right"))
            parts.setdefault(to, []).append((suffix, left, before, int(len(found[suffix, left, before]) > 2), n))
        places = zstandard.compress(struct.pack("<I", len(order)) + np.array([len(found[x]) for x in order], "<i4").tobytes() + np.array([y for x in order for y in found[x]], "<i4").tobytes(), 3)
        return pa.table({"range": pa.array([*parts, -1], pa.int32()), "block": pa.array([block] * (len(parts) + 1), pa.int32()), "run": pa.array([*(front_code(p) for p in parts.values()), places], pa.binary())})

    runs = stored(long.select(BLOCK, "doc_id", "text").groupBy(BLOCK).cogroup(wanted.select("block", "hash").groupBy("block")).applyInArrow(sort, "range int, block int, run binary"))
    forget(met, wanted)

    def sweep(_key, table):
        """Merges a range's runs and resolves each group of suffixes that share the k-gram."""
        owners = table.column("block").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        group: list[tuple[int, int, tuple]] = []

        def resolve() -> None:
            if len(group) > 1:
                spans = repeated_distances([e[0] for _, _, e in group], [n for n, _, _ in group], [e[1] for _, _, e in group], length)
            else:
                spans = [[]]
            for (_, run, (_, left, before, twice, entry)), found in zip(group, spans, strict=True):
                for a, b in [(before, len(left))] if twice else found:
                    if max(a, before) <= min(b, len(left)):
                        out.append((owners[run], entry, max(a, before), min(b, len(left))))

        for lcp, run, entry in merge([front_decode(x) for x in table.column("run").to_pylist()]):
            if lcp < k and group:
                resolve()
                group.clear()
            group.append((lcp, run, entry))
        resolve()
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("block", "entry", "near", "far"), columns, strict=True)})

    if used is not None:
        used.append(runs)
    spans = runs.where("range >= 0").groupBy("range").applyInArrow(sweep, "block int, entry int, near int, far int")
    told = runs.where("range < 0").selectExpr("block", "run", "cast(null as int) entry", "cast(null as int) near", "cast(null as int) far").union(spans.selectExpr("block", "cast(null as binary)", "entry", "near", "far"))
    names = [c for c in long.columns if c not in (BLOCK, RUNS)]
    schema = T.StructType([*[long.schema[n] for n in names], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField(RUNS, T.BinaryType())])

    def remove(_key, docs_table, about):
        docs_table, texts = _sorted_texts(docs_table)
        places: list[list[int]] = []
        for blob in about.column("run").drop_null().to_pylist():
            raw = zstandard.decompress(blob)
            (n,) = struct.unpack_from("<I", raw)
            counts = np.frombuffer(raw, "<i4", n, 4)
            places = [x.tolist() for x in np.split(np.frombuffer(raw, "<i4", -1, 4 + 4 * n), np.cumsum(counts)[:-1])] if n else []
        covered: dict[int, list[tuple[int, int]]] = {}
        lines = about.filter(pc.is_valid(about.column("entry")))
        for entry, near, far in zip(*(lines.column(c).to_pylist() for c in ("entry", "near", "far")), strict=True):
            at = places[entry]
            for i, a in zip(at[::2], at[1::2], strict=True):
                covered.setdefault(i, []).append((a - far, a - near + length))
        removed, spans_n, kept, gone = [], [], [], []
        for i, (text, blob) in enumerate(zip(texts, docs_table.column(RUNS).to_pylist(), strict=True)):
            own = joined(covered.get(i, []))
            if by_words:
                own = whole_words(text, own)
            own = joined(own + np.frombuffer(blob or b"", "<i8").reshape(-1, 2).tolist())
            edges = [0, *(x for run in own for x in run), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(sum(b - a for a, b in own))
            spans_n.append(len(own))
            gone.append(np.array(own, "<i8").tobytes())
        table = docs_table.select(names)
        for name, column in (("n_bytes", pa.array([len(x) for x in texts], pa.int64())), ("n_removed", pa.array(removed, pa.int64())), ("n_spans", pa.array(spans_n, pa.int64())), ("kept", pa.array(kept, pa.binary())), (RUNS, pa.array(gone, pa.binary()))):
            table = table.append_column(name, column)
        return table

    left = long.groupBy(BLOCK).cogroup(told.groupBy("block")).applyInArrow(remove, schema)
    return short.select(*names, *results, RUNS).union(left.select(*names, *results, RUNS))


def without_repeats(docs: DataFrame, length: int = 400, k: int = 64, words: int = 0, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with what is left of each text, and its n_chars; a character of which only some bytes are left goes too.

    ``words``: sequences of so many whole words (what stands between ASCII white space) that also start elsewhere go as
    well, however few bytes they have, with the white space within them. Both are judged on the input.
    """

    names = docs.columns
    inner = {n: n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)}
    used: list[DataFrame] = []
    kept = _remove(docs.select(*[F.col(f"`{n}`").alias(inner[n]) for n in names]), length, k, block_bytes, used=used)
    if words:
        kept = stored(kept.select(*inner.values(), RUNS))
        forget(*used)
        kept = _remove(kept, words * WORD_BYTES, max(8, min(40, words * WORD_BYTES // 2)), block_bytes, by_words=True)
    schema = kept.select(*inner.values()).schema

    def run(batches):
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            columns = {n: batch.column(c) for n, c in inner.items()} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(x) for x in texts], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(inner.values()))

    return kept.select(*inner.values(), "kept").mapInArrow(run, schema).toDF(*names)
