"""Byte-level BPE over whole texts: overlapping chunks, stitched where their pre-token boundaries agree.

Pre-tokens are matches of a pattern without look-behind, so what follows a true boundary depends on the text after it
alone. Texts longer than a chunk are cut into chunks that overlap; each chunk is pre-tokenised by itself, and from the
first boundary that both neighbours have in their overlap on, the later chunk's boundaries are the true ones. The pieces
between these points are encoded apart and their ids joined. Only boundaries after a visible character count, for a run of
white space is split by what follows it, and a piece that ends in one would lose sight of that. A text whose chunks never meet is encoded in one piece.

Rules: a null text is empty; an empty text has no ids; repeated rows are encoded alike and all returned; columns other
than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import documents, slices, stored, tasks

#: Characters at a chunk's end whose boundaries depend on what follows it: contractions reach 3 characters on.
MARGIN = 4


@functools.lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def _ids(texts: list[str], path: str, pattern: str) -> pa.Array:
    encoder = _encoder(path, pattern)
    return pa.array([encoder.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in texts], pa.binary())


def _with_ids(df: DataFrame, path: str, pattern: str, keys: str) -> DataFrame:
    """Replaces ``text`` by ``ids``; ``keys``: DDL of the columns that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], _ids(batch.column(at).to_pylist(), path, pattern)], names=[*[n for n in batch.schema.names if n != "text"], "ids"])

    return df.mapInArrow(run, f"{keys}, ids binary")


def _boundaries(chunks: DataFrame, pattern: str, stride: int, overlap: int) -> DataFrame:
    """(t, c, head, tail): boundaries in the overlap with the chunk before, and those in the overlap with the next, counted from the next one's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _pattern(pattern).finditer
        for batch in slices(batches, "chunk"):
            heads, tails = [], []
            for text in batch.column("chunk").to_pylist():
                ends = [e for e in (m.end() for m in find(text)) if text[e - 1] != " " and text[e - 1].isprintable()]
                heads.append([e for e in ends if e <= overlap])
                tails.append([e - stride for e in ends if stride <= e <= len(text) - MARGIN])
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("c"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["t", "c", "head", "tail"])

    return chunks.mapInArrow(run, "t string, c int, head array<int>, tail array<int>")


def stitched_pieces(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts (t, text), each longer than ``chunk`` -> (t, c, text): pieces whose ids, in order of c, are those of the whole text.

    The chunks are dealt out once; their boundaries alone travel to meet their neighbours' and come back to them.
    """
    stride = chunk - overlap
    count = F.ceil((F.length("text") - overlap) / stride).cast("int")
    dealt = (
        texts.select("t", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("c"))
        .select("t", "c", F.expr(f"substring(text, c * {stride} + 1, {chunk})").alias("chunk"))
        .repartition(tasks(texts.sparkSession), "t", "c")
    )
    order = Window.partitionBy("t").orderBy("c")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    found = (
        _boundaries(dealt, pattern, stride, overlap)
        .dropDuplicates(["t", "c"])
        .withColumn("start", F.when(F.col("c") == 0, 0).otherwise(met))
        .withColumn("stop", F.lead("start").over(order) + stride)
        .withColumn("lost", F.max(F.col("start").isNull()).over(Window.partitionBy("t")))
    )
    kept = dealt.join(found.where("not lost").select("t", "c", "start", "stop").hint("shuffle_hash"), ["t", "c"])
    pieces = kept.select("t", "c", F.expr("substring(chunk, start + 1, coalesce(stop, length(chunk)) - start)").alias("text"))
    whole = texts.join(found.where("lost").select("t").distinct(), "t").select("t", F.lit(0).alias("c"), "text")
    return pieces.union(whole)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers. Equal long texts are encoded once."""
    if not MARGIN < overlap < chunk - overlap:
        raise ValueError("an overlap must be shorter than half a chunk")
    rows = documents(docs)
    short = _with_ids(rows.where(F.length("text") <= chunk), path, pattern, "doc_id long")
    long = stored(rows.where(F.length("text") > chunk).select("doc_id", F.sha2("text", 256).alias("t"), F.coalesce("doc_id", F.lit(-1 << 63)).alias("d"), "text"))  # few rows, read several times
    one = long.groupBy("t").agg(F.min("d").alias("d"))
    pieces = stitched_pieces(long.join(one, ["t", "d"], "left_semi").select("t", "text"), pattern, chunk, overlap)

    def joined(rows):
        rows = rows.drop_duplicates("c").sort_values("c")
        return rows.iloc[:1][["t"]].assign(ids=b"".join(rows["ids"]))

    ids = _with_ids(pieces, path, pattern, "t string, c int").groupBy("t").applyInPandas(joined, "t string, ids binary")
    return short.union(long.select("doc_id", "t").join(ids, "t").select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, bytes): the tokens' bytes, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = _encoder(path, pattern)
        for batch in slices(batches, "ids"):
            out = [encoder.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
