"""Mixing sources to target weights: a hash-random order within each source, cut where its budget of words is used up.

Every row gets a hash-random key. The rows are range-sorted by (source, key); each range partition knows its sums per
source, and the sums of the partitions before it, so every row learns how many of its source's words come before it
without any source passing through one task. A source whose budget exceeds its words takes whole passes first; the last
pass stops at exactly the budget, inside a document if need be.

Targets: sources share ``percent`` of all words by weight, none more than ``most`` times its own words, and what exceeds
that is shared again among the others. With sources ordered by cap over weight, the level of the first one whose share
at that level stays within its cap is the final level; sources are numbered, summed and levelled by the same distributed
running sums as the rows, so their number has no bound either.

Rules: a null text has no words; a null source is a source of its own, after all others; a document with no words takes
none; repeated rows and rows without a doc_id are rows of their own; rows of a source that agree in doc_id and size are
interchangeable, all other ties of the key go by doc_id and size, so reruns agree; only doc_id, text and source are read,
whatever else the table holds; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import stored, tasks

WORDS = "[^\\x20\\x09-\\x0D]+"


def running(rows: DataFrame, groups: list[str], order: list[Column], values: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their range partition ``part`` by groups and order, and the totals of each (part, groups); groups are never null.

    ``values`` maps a column to the name of its sum. In the totals, that name is the sum within the part and ``before_``
    + name the sum over the group's earlier parts; a range partition holds neighbouring groups, so there are no more
    totals than parts and groups together, and no more totals in a group than parts.
    """
    salt = F.monotonically_increasing_id()  # rows equal in all else may stand anywhere, but not all in one part
    dealt = rows.withColumn("_salt", salt).repartitionByRange(tasks(rows.sparkSession), *groups, *order, "_salt")
    kept = stored(dealt.withColumn("part", F.spark_partition_id()))
    sums = kept.groupBy("part", *groups).agg(*[F.sum(v).alias(n) for v, n in values.items()])
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return kept, stored(sums.withColumns({f"before_{n}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in values.values()}))


def placed(kept: DataFrame, sums: DataFrame, groups: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """Adds to each row, under the sum's name, the sum over its group's rows before it; other columns of ``sums`` come along."""
    earlier = Window.partitionBy("part", *groups).orderBy(*order, "_salt").rowsBetween(Window.unboundedPreceding, -1)
    inner = kept.withColumns({f"in_{n}": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v, n in values.items()})
    out = inner.join(sums.drop(*values.values()), ["part", *groups]).withColumns({n: F.col(f"before_{n}") + F.col(f"in_{n}") for n in values.values()})
    return out.drop("_salt", "part", *[f"{p}_{n}" for n in values.values() for p in ("before", "in")])


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, source_size) -> these and target: each source's words in the mix."""
    rows = sizes.withColumns({"all": F.lit(0), "one": F.lit(1)})
    order = [F.col("source")]
    kept, sums = running(rows, ["all"], order, {"one": "rank"})
    ranked = placed(kept, sums, ["all"], order, {"one": "rank"})
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    capped = ranked.select("source", "source_size", "all", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"), (most * F.col("source_size")).alias("cap"))
    total, weight = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    order = [F.col("cap") / F.col("weight"), F.col("source")]
    both = {"cap": "caps", "weight": "weights"}
    kept, sums = running(capped, ["all"], order, both)
    levels = placed(kept, sums, ["all"], order, both).withColumns({"left": F.lit(total * percent / 100) - F.col("caps"), "rest": F.lit(weight) - F.col("weights")})
    fits = levels.where(F.col("left") * F.col("weight") <= F.col("cap") * F.col("rest"))
    level = fits.agg(F.min(F.struct(F.col("cap") / F.col("weight"), F.col("caps"), (F.col("left") / F.col("rest")).alias("level")))["level"]).first()[0]
    target = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return capped.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: str = "") -> DataFrame:
    """(doc_id, size, source, source_size, target, passes, part_words, taken): one row per row of docs.

    The mix holds the document ``passes`` times as a whole and then its first ``part_words`` words; taken is the sum of
    words. Weights go round the sources in their order by code point.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    source = F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b"))  # orders as the sources do, null last
    rows = stored(docs.select("doc_id", source.alias("source"), words.alias("size"), key.alias("key")))
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    kept, sums = running(rows, ["source"], order, {"size": "words"})
    wanted = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most)
    out = placed(kept, sums.join(wanted, "source"), ["source"], order, {"size": "words"})
    out = out.withColumn("budget", F.floor("target").cast("long"))
    out = out.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    out = out.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    out = out.withColumn("part_words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("words"))).cast("long"))
    named = F.when(F.col("source") != "b", F.expr("substring(source, 2)"))
    return out.select("doc_id", "size", named.alias("source"), "source_size", "target", "passes", "part_words", (F.col("passes") * F.col("size") + F.col("part_words")).alias("taken"))
