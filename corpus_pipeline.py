"""A corpus from documents to packed sequences; every stage works on all that the one before it kept.

Counted as part of the subpackage barloom.llm and gone with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import jaccard, packing, repeats, toxicity
from barloom.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Labels are learnt from the rows that op3_toxicity learns from, of the documents at hand."""
    out = toxicity.held_out(F.col("doc_id"))
    examples = toxicity.fit(docs.where(~out), read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~out))
    return toxicity.clean_only(docs, examples)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard.one_of_each_group(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes and the passages of over 50 words that also start elsewhere; a document stays even if nothing is left of it."""
    return repeats.without_repeats(docs, words=51)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50_256}, 2)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("repeated_passages", drop_repeats), ("packing", pack)]
#: No stage can be written in SQL as a whole; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
