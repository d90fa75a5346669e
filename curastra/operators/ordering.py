"""Operators whose result depends on an order: sampling, top-k, numbering, batches, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_key


def round_robin(rows: DataFrame, stratum: list[str], family: str, key: str, count: int, seed: str) -> DataFrame:
    """``count`` rows of each stratum, taken in turn from its families.

    Families and the rows within them are in the order of seeded digests; each round takes a
    row from each family that still has one. Adds ``position`` from 1.
    """
    keyed = rows.withColumn("_k", stable_key(seed, F.col(key))).withColumn("_f", stable_key(seed, F.col(family)))
    turn = F.row_number().over(Window.partitionBy(*stratum, family).orderBy("_k"))
    turns = keyed.withColumn("_turn", turn).where(F.col("_turn") <= count)
    place = F.row_number().over(Window.partitionBy(*stratum).orderBy("_turn", "_f"))
    return turns.withColumn("position", place).where(F.col("position") <= count).drop("_k", "_f", "_turn")


def require_full(sample: DataFrame, stratum: list[str], count: int, strata: DataFrame) -> DataFrame:
    """The sample, or an error if a stratum has too few rows."""
    got = strata.join(sample.groupBy(*stratum).agg(F.count("*").alias("n")), stratum, "left")
    short = got.where(F.coalesce("n", F.lit(0)) != count).limit(5).collect()
    if short:
        raise ValueError("insufficient samples for " + ", ".join("/".join(str(r[c]) for c in stratum) + f": {r['n'] or 0}" for r in short))
    return sample


def frozen_or_new(frozen: DataFrame | None, expected: int, sample) -> DataFrame:
    """A sample that was frozen before is kept; one of another size is an error; else a new one."""
    if frozen is None:
        return sample()
    n = frozen.count()
    if n != expected:
        raise ValueError(f"frozen sample has {n} rows, expected {expected}")
    return frozen


def top_per_group(rows: DataFrame, group: str, count: int, *order: Column) -> DataFrame:
    """The first ``count`` rows of each group, with their ``rank``. Strings order by bytes."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= count)


def top(rows: DataFrame, count: int, *order: Column) -> DataFrame:
    """The first ``count`` rows of all; a heap in each task, then one of those."""
    return rows.orderBy(*order).limit(count)


def numbered_ids(rows: DataFrame, prefix: Column, group: str, rank: str, width: int = 4) -> DataFrame:
    """Adds ``unit_id``: prefix and a number that runs over groups in order, then ranks.

    A group's start is the rows of the groups before it: counts are windowed, not rows.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, start.alias("_start"))
    number = F.row_number().over(Window.partitionBy(group).orderBy(rank)) + F.col("_start")
    text = number.cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)  # lpad would cut long numbers
    return rows.join(starts, group).withColumn("unit_id", F.concat(prefix, padded)).drop("_start")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def last_event(events: DataFrame, run: str, seq: str, kind: Column) -> DataFrame:
    """The last event of a kind in each run."""
    others = [c for c in events.columns if c != run]
    return events.where(kind).groupBy(run).agg(F.max_by(F.struct(*others), F.col(seq)).alias("e")).select(run, "e.*")


def shuffled_batches(rows: DataFrame, key: str, seed: str, epoch: int, size: int, group: str | None = None) -> DataFrame:
    """Rows with ``place`` in a reproducible shuffle of the epoch and ``batch`` (from 1).

    The order is by a digest of seed, epoch and key. Places come from the counts of digest
    prefixes, so no task sorts all rows.
    """
    digest = stable_key(f"{seed}:{epoch}", F.col(key))
    rows = rows.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 3))
    by = [group] if group else []
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", key))
    out = rows.join(starts, [*by, "_b"]).withColumn("place", inner + F.col("_start"))
    return out.withColumn("batch", F.ceil(F.col("place") / size)).drop("_d", "_b", "_start")


def first_seen_across(groups: DataFrame, order: str, digest: str, count: int, *rank: Column) -> DataFrame:
    """Units kept when groups are worked through in order with one set of seen digests.

    A group's candidates are those whose digest no earlier group *kept*; its first ``count``
    are kept. Repeats within a group survive, and a candidate that was cut off blocks
    nobody. Groups depend on one another, so they are decided in rounds: each round ranks
    all groups, and keeps what it finds for every group that no undecided one before could
    take a digest from.
    """
    from .components import stored

    rows = stored(groups.withColumn("_id", F.xxhash64(*groups.columns)))
    kept = stored(rows.limit(0))
    left = rows
    while not left.isEmpty():
        free = left.join(kept.select(digest, F.col(order).alias("_before")).groupBy(digest).agg(F.min("_before").alias("_before")), digest, "left").where(F.col("_before").isNull() | (F.col("_before") >= F.col(order))).drop("_before")
        place = F.row_number().over(Window.partitionBy(order).orderBy(*rank))
        ranked = stored(free.withColumn("_place", place))
        # a group is certain if no digest of its rows is also in an earlier undecided group
        first = ranked.groupBy(digest).agg(F.min(order).alias("_first"))
        open_ = ranked.join(first, digest).where(F.col("_first") < F.col(order)).select(order).distinct()
        done = stored(ranked.join(open_, order, "left_anti"))
        kept = stored(kept.unionByName(done.where(F.col("_place") <= count).drop("_place")))
        left = stored(ranked.drop("_place").join(done.select(order).distinct(), order, "left_anti"))
    return kept.drop("_id")
