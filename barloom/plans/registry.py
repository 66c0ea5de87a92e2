"""Collects the registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from barloom.functions.scalar import cut

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.covers: dict[str, tuple[str, ...]] = {}

    def add(self, name: str, ids: str, sql: str | None = None):
        """Decorator: register under ``name`` for the inventory ids, with the SQL to compare."""

        def wrap(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
            self.covers[name] = tuple(ids.split())
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: doubles rounded, dates and times as text, booleans as 0/1."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = cut(c.cast("double"), digits)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(kind, T.BooleanType):
            c = c.cast("int")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        cols.append(c.alias(field.name))
    return df.select(*cols)


REG = Registry()
