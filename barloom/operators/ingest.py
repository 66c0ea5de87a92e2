"""Ingestion: upsert, batch classification, source merging, gates, hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scalar import SCALE8, local_close_utc, add_weekdays, as_col
from barloom.operators.panel import BY, block_lag, latest


# ---- upsert -----------------------------------------------------------------

def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest(df, keys, order)


def _differs(a: str, b: str, values: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{v}").eqNullSafe(F.col(f"{b}.{v}")) for v in values])


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Merge unique-key updates into the target: (merged rows, every key with its outcome).

    Outcomes: added, updated, skipped (identical), kept (not in the batch).
    """
    old = target.select(*keys, F.struct(*values).alias("_old"))
    new = updates.select(*keys, F.struct(*values).alias("_new"))
    both = old.join(new, list(keys), "full")
    outcome = (
        F.when(F.col("_new").isNull(), "kept")
        .when(F.col("_old").isNull(), "added")
        .when(_differs("_old", "_new", values), "updated")
        .otherwise("skipped")
    )
    both = both.withColumn("outcome", outcome).withColumn("_row", F.coalesce("_new", "_old"))
    return both.select(*keys, "_row.*"), both.select(*keys, "outcome")


def classify_batch(
    batch: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str], block: Column
) -> DataFrame:
    """Outcome of every occurrence in a batch, in arrival order: against the previous one of its key, else the target."""
    packed = batch.withColumn("_new", F.struct(*values))
    seq = block_lag(packed, keys, block, order, {"_prev": "_new"}, seen="_again")
    stored = target.select(*keys, F.struct(*values).alias("_stored"))
    seq = seq.join(stored, list(keys), "left")
    base = F.when(F.col("_again"), F.col("_prev")).otherwise(F.col("_stored"))
    seq = seq.withColumn("_base", base)
    outcome = F.when(F.col("_base").isNull(), "added").when(_differs("_base", "_new", values), "updated").otherwise("skipped")
    return seq.withColumn("outcome", outcome).select(*batch.columns, "outcome")


def update_log(classified: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Counts of a refresh per key: received, written, added, updated, skipped."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    out = classified.groupBy(*by).agg(
        F.count_if(F.col("outcome") != "kept").alias("received"),
        n("added").alias("added"), n("updated").alias("updated"), n("skipped").alias("skipped"),
    )
    return out.withColumn("written", F.col("added") + F.col("updated")).withColumn(
        "status", F.when(F.col("received") == 0, "empty").when(F.col("written") == 0, "unchanged").otherwise("written")
    )


def diff_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """new / changed / same / gone row counts of b against a, per group."""
    _, audit = upsert(a, b, keys, values)
    renamed = audit.withColumn(
        "state",
        F.when(F.col("outcome") == "added", "new").when(F.col("outcome") == "updated", "changed").when(F.col("outcome") == "skipped", "same").otherwise("gone"),
    )
    return renamed.groupBy(*by).pivot("state", ["new", "changed", "same", "gone"]).count().na.fill(0, ["new", "changed", "same", "gone"])


def drop_placeholders(target: DataFrame, updates: DataFrame, by: Sequence[str] = BY, marker: str = "DEMO") -> DataFrame:
    """Remove rows of placeholder sources for keys that now have real rows."""
    real = updates.where(~F.upper(F.col("source")).startswith(marker)).select(*by).distinct().withColumn("_real", F.lit(True))
    out = target.join(real, list(by), "left")
    return out.where(~(F.upper(F.coalesce("source", F.lit(""))).startswith(marker) & F.col("_real").isNotNull())).drop("_real")


# ---- several sources ----------------------------------------------------------

def first_available(sources: Sequence[DataFrame], by: Sequence[str] = BY) -> DataFrame:
    """Per key all rows of the first source, in the given order, that has any."""
    stacked = reduce(lambda a, b: a.unionByName(b), [df.withColumn("priority", F.lit(i)) for i, df in enumerate(sources)])
    best = stacked.groupBy(*by).agg(F.min("priority").alias("priority"))
    return stacked.join(best, [*by, "priority"])


def append_newer(primary: DataFrame, secondary: DataFrame, by: Sequence[str] = BY, t: str = "trade_date") -> DataFrame:
    """Primary rows plus the secondary ones dated after the primary's last date of the key."""
    ends = primary.groupBy(*by).agg(F.max(t).alias("_end"))
    newer = secondary.join(ends, list(by), "left").where(F.col("_end").isNull() | (F.col(t) > F.col("_end"))).drop("_end")
    return primary.withColumn("origin", F.lit("primary")).unionByName(newer.withColumn("origin", F.lit("secondary")))


def patch_invalid(df: DataFrame, other: DataFrame, keys: Sequence[str], invalid: Column, values: Sequence[str]) -> DataFrame:
    """Replace values of invalid rows by the other source's row of the same key, where it has one."""
    spare = other.select(*keys, F.struct(*values).alias("_spare"))
    out = df.withColumn("_bad", F.coalesce(invalid, F.lit(False))).join(spare, list(keys), "left")
    use = F.col("_bad") & F.col("_spare").isNotNull()
    return out.withColumns({**{v: F.when(use, F.col(f"_spare.{v}")).otherwise(F.col(v)) for v in values}, "patched": use}).drop("_bad", "_spare")


def normalise_records(df: DataFrame, aliases: dict[str, Sequence[str]], multipliers: dict[str, Column | float] | None = None) -> DataFrame:
    """Vendor columns to the common names: first present alias, decimal cast, unit multiplier.

    ``multipliers`` maps an output name to a factor or a Column, such as 100 for lots.
    """
    multipliers = multipliers or {}
    out = []
    for name, options in aliases.items():
        present = [F.col(f"`{o}`") for o in options if o in df.columns]
        value = F.coalesce(*present) if present else F.lit(None).cast("string")
        if name in multipliers:
            factor = multipliers[name]
            value = value.cast(SCALE8) * (factor if isinstance(factor, Column) else F.lit(factor).cast("decimal(20,8)"))
            value = value.cast(SCALE8)
        out.append(value.alias(name))
    taken = {o for options in aliases.values() for o in options}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in taken and c not in aliases], *out)


# Magnitude words in column headers.
UNIT_WORDS = {"亿": 100_000_000, "万": 10_000, "千": 1_000, "手": 100}


def header_scale(header) -> Column:
    """Unit multiplier named in a header text."""
    text = as_col(header)
    scale = F.lit(1)
    for word, factor in reversed(UNIT_WORDS.items()):
        scale = F.when(text.contains(word), factor).otherwise(scale)
    return scale


def effective_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("effective_volume", (F.col("volume").cast("decimal(28,4)") * F.coalesce("volume_multiplier", F.lit(1)).cast("decimal(10,4)")).cast(SCALE8))


# ---- gates and revisions -------------------------------------------------------

def payload_hash(cols: Sequence[str]) -> Column:
    """SHA-256 of the canonical text of some columns, in name order; NULL is kept apart from empty."""
    parts = []
    for c in sorted(cols):
        parts += [F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def group_hash(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], blocks: Sequence[Column]) -> DataFrame:
    """Digest of the ordered rows of a group, as a tree of digests.

    ``blocks`` runs from the finest to the coarsest block number, each a
    non-decreasing function of ``order`` (key // 1000, key // 1000000, ...). Rows
    meet only inside a finest block and digests only inside the next one, so with
    enough levels no task gathers more than a block, however large the group.
    """
    names = [f"_b{i}" for i in range(len(blocks))]
    rows = df.select(*by, *[b.alias(n) for b, n in zip(blocks, names)], F.struct(*order).alias("_k"), payload_hash(cols).alias("_d"), F.lit(1).alias("_n"))
    for level in range(len(names) + 1):
        keep = names[level:]
        gathered = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_d"))), lambda x: x["_d"])
        rows = rows.groupBy(*by, *keep).agg(F.sha2(F.array_join(gathered, ""), 256).alias("_d"), F.sum("_n").alias("_n"))
        if keep:
            rows = rows.withColumn("_k", F.col(keep[0]))
    return rows.select(*by, F.col("_d").alias("group_hash"), F.col("_n").alias("rows"))


def table_fingerprint(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Row count and order-free XOR of the rows' content hashes (60 bits of each) per group; combines map-side."""
    bits = F.conv(F.substring(payload_hash(cols), 1, 15), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_xor(bits).alias("fingerprint"))


def ingest_gate(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], as_of, start=None, end=None, require_volume: bool = True,
    by: Sequence[str] = BY, t: str = "trade_date",
) -> DataFrame:
    """Issue rows of a batch: duplicates by payload, date range, future dates, volume, staleness."""
    cutoff = F.lit(as_of).cast("date")
    hashed = df.withColumn("_h", payload_hash(values))
    dup = hashed.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("_h").alias("_h0"), F.max("_h").alias("_h1"))
    dups = dup.where("_c > 1").select(
        *by, F.col(t).alias("day"),
        F.when(F.col("_h0") == F.col("_h1"), "IDENTICAL_DUPLICATE").otherwise("CONFLICTING_DUPLICATE").alias("code"),
    )
    checks = [F.when(F.col(t) > cutoff, F.lit("FUTURE_TRADE_DATE"))]
    if start is not None:
        checks.append(F.when(F.col(t) < F.lit(start).cast("date"), F.lit("DATE_BEFORE_REQUEST")))
    if end is not None:
        checks.append(F.when(F.col(t) > F.lit(end).cast("date"), F.lit("DATE_AFTER_REQUEST")))
    if require_volume:
        checks.append(F.when(F.col("volume").isNull(), F.lit("MISSING_VOLUME")))
        checks.append(F.when(F.col("volume") <= 0, F.lit("NONPOSITIVE_VOLUME")))
    rows = df.select(*by, F.col(t).alias("day"), F.explode(F.array_compact(F.array(*checks))).alias("code"))
    out = dups.unionByName(rows)
    if end is not None:
        lag = F.date_diff(F.lit(end).cast("date"), F.max(t))
        stale = df.groupBy(*by).agg(F.max(t).alias("day"), lag.alias("_lag")).where("_lag > 5")
        out = out.unionByName(
            stale.select(*by, "day", F.when(F.col("_lag") > 14, "STALE_END_DATE").otherwise("POSSIBLE_STALE_END_DATE").alias("code"))
        )
    warning = F.col("code").isin("IDENTICAL_DUPLICATE", "POSSIBLE_STALE_END_DATE")
    return out.groupBy(*by, "code").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).withColumn(
        "severity", F.when(warning, "warning").otherwise("blocking")
    )


def append_revisions(existing: DataFrame, batch: DataFrame, identity: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts). A retry of known revisions appends nothing; the
    same identity with another payload is a conflict, inside the batch or against the store."""
    keyed = batch.withColumn("_h", payload_hash(values))
    inside = keyed.groupBy(*identity).agg(F.min("_h").alias("_h0"), F.max("_h").alias("_h1"), F.first(F.struct(*batch.columns)).alias("_row"))
    stored = existing.select(*identity, payload_hash(values).alias("_stored"))
    both = inside.join(stored, list(identity), "left")
    clash = (F.col("_h0") != F.col("_h1")) | (F.col("_stored").isNotNull() & (F.col("_stored") != F.col("_h0")))
    fresh = both.where(F.col("_stored").isNull() & (F.col("_h0") == F.col("_h1"))).select("_row.*")
    return fresh, both.where(clash).select(*identity)


def verify_chain(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, parent: str, payload: Sequence[str], block: Column) -> DataFrame:
    """Broken links: parent differs from the previous hash, or the hash from its payload."""
    seq = block_lag(df, by, block, order, {"_prev": value})
    bad_parent = ~F.col("_prev").eqNullSafe(F.col(parent))
    bad_digest = F.col(value) != payload_hash(payload)
    return seq.withColumn("broken", F.when(bad_parent, "PARENT").when(bad_digest, "DIGEST")).where(F.col("broken").isNotNull()).drop("_prev")


# ---- availability ---------------------------------------------------------------

def available_at(observed: Column, policy: Column) -> Column:
    """When an observation became known, by release policy, as a UTC timestamp."""
    nxt = F.add_months(F.trunc(observed, "month"), 1)
    sh = "Asia/Shanghai"
    return (
        F.when(policy == "fund_nav", local_close_utc(add_weekdays(observed, 2), "23:59", sh))
        .when(policy == "next_day", local_close_utc(F.date_add(observed, 1), "00:05", "America/New_York"))
        .when(policy == "month_plus_2", local_close_utc(F.date_add(nxt, 2), "12:00", sh))
        .when(policy == "month_plus_14", local_close_utc(F.date_add(nxt, 14), "12:00", sh))
        .when(policy == "month_plus_19", local_close_utc(F.date_add(nxt, 19), "12:00", sh))
        .when(policy == "same_day_evening", local_close_utc(observed, "18:00", sh))
        .when(policy == "same_day_noon", local_close_utc(observed, "12:00", sh))
    )


def complete_daily(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Completed daily points only: stamped at midnight, on a weekday."""
    t = F.col(ts).cast("timestamp")
    return df.where((F.date_trunc("day", t) == t) & ~F.dayofweek(t).isin(1, 7))


def freshness(bars: DataFrame, calendar: DataFrame, now, close_hhmm: str, zone: str, delay_minutes: int = 30, by: Sequence[str] = BY) -> DataFrame:
    """Latest stored session per key against the last session already closed (plus delay) at ``now`` (UTC)."""
    close = local_close_utc("session_date", close_hhmm, zone) + F.make_interval(mins=F.lit(delay_minutes))
    expected = calendar.where(close <= F.lit(now).cast("timestamp")).select(F.max("session_date")).scalar()
    out = bars.groupBy(*by).agg(F.max("trade_date").alias("latest")).withColumn("expected", expected)
    return out.withColumn("fresh", F.coalesce(F.col("latest") >= F.col("expected"), F.lit(False)))


def validate_forecasts(df: DataFrame, domains: dict[str, Sequence[str]], ranges: dict[str, tuple[float, float]], reasons: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with an issues array): enum domains, finite ranges, non-empty reasons."""
    checks = []
    for c, allowed in domains.items():
        checks.append(F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), F.lit(f"BAD_{c.upper()}")))
    for c, (lo, hi) in ranges.items():
        ok = F.coalesce(~F.isnan(F.col(c).cast("double")) & F.col(c).between(lo, hi), F.lit(False))
        checks.append(F.when(~ok, F.lit(f"RANGE_{c.upper()}")))
    good_reasons = F.coalesce((F.size(reasons) > 0) & F.forall(reasons, lambda x: F.length(F.trim(x)) > 0), F.lit(False))
    checks.append(F.when(~good_reasons, F.lit("EMPTY_REASONS")))
    marked = df.withColumn("issues", F.array_compact(F.array(*checks)))
    return marked.where(F.size("issues") == 0).drop("issues"), marked.where(F.size("issues") > 0)


def apply_ticks(df: DataFrame, ticks: DataFrame, prices: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Round prices to each instrument's tick size (half-even steps). The tick table is one row per instrument."""
    out = df.join(ticks.select(*on, "tick"), list(on), "left")
    step = F.col("tick")
    return out.withColumns({p: F.when(step > 0, F.bround(F.col(p) / F.when(step > 0, step), 0) * step).otherwise(F.col(p)) for p in prices})
