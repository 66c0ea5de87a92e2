"""What the vector operators share: which vectors take part, and their rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def complete(rows: DataFrame) -> DataFrame:
    """vec_id as long, embedding as doubles, and ``usable``: the id is set and the embedding is neither null, empty nor zero and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.forall("embedding", lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    typed = rows.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return typed.withColumn("usable", F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def usable(rows: DataFrame) -> DataFrame:
    return complete(rows).where("usable").drop("usable")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column whose lists have ``width`` numbers each, as a float64 matrix."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).astype(np.float64).reshape(-1, width) if parts else np.zeros((0, width))
