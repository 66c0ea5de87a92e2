"""Stable placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: offset + j * skip. The shards take turns, each
claiming its next free slot, until the table is full. Placing a row is then one hash and one table read, and adding or
removing a shard moves little more than that shard's share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = 65_537, weights: Sequence[int] | None = None) -> np.ndarray:
    """Shard index per slot. ``weights``: turns a shard has in each round, 1 by default."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime no smaller than the number of shards")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("one weight per shard, none negative, not all zero")
    table = np.full(size, -1, dtype=np.int32)
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    filled = 0
    while True:
        for i, n in enumerate(turns):
            for _ in range(n):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % size
                table[at[i]] = i
                filled += 1
                if filled == size:
                    return table


def place(rows: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = 65_537, weights: Sequence[int] | None = None) -> DataFrame:
    """Adds ``slot`` and ``shard`` (replacing columns of these names, which may be keys all the same).

    The table that is broadcast has ``size`` rows whatever the input, so its size is bounded. Rows with equal keys go to
    one shard; a null key is a value like any other; an empty input gives no rows.
    """
    spark = rows.sparkSession
    names = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, size, weights))]
    table = spark.createDataFrame(names, "__slot int, __shard string")
    slot = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(size)).cast("int")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard")]
    return rows.withColumn("__slot", slot).join(F.broadcast(table), "__slot").select(*kept, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))
