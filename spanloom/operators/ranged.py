"""Range-sorted running totals: window sums inside a range partition plus partition offsets.

A plain ``Window.partitionBy(group)`` sends each group to one task. Here rows are
range-partitioned on (group, order), so a group of any size spreads over as many
partitions as its rows need; totals run within a partition and one offset per
(partition, group) fragment carries them across.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import partitions_for, stage

PID, LOCAL, START, SIZE, TOTAL = "_pid", "_local", "_start", "_size", "_total"
_BEGUN = "_begun"


@dataclass
class Ranged:
    """``rows`` hold ``_pid`` and ``_local``; ``fragments`` one row per (``_pid``, group)
    with ``_start`` (weight before the fragment), ``_size`` and ``_total`` of the group; ``ties``
    are the columns whose equal values share a rank."""

    rows: DataFrame
    fragments: DataFrame
    group: list[str]
    ties: list[str]


def range_totals(df: DataFrame, group: list[str], order: list[str], weight: str, name: str, partitions: int | None = None, rank: bool = False) -> Ranged:
    """Range-sort ``df`` on (group, order) and total ``weight`` within each partition.

    ``_local`` is the inclusive running sum of ``weight`` within (partition, group), or with
    ``rank`` the running rank of rows of weight 1 (ties share the smallest). Ties may be cut
    by a partition border, so one value with most rows is many tasks: a rank that begins in
    an earlier partition is carried across by ``with_global``. The ranged rows are staged
    once: offsets and readers see the same boundaries whatever is run again.
    """
    n = partitions or partitions_for(df)
    tie = [F.xxhash64(*df.columns)] if rank else []
    ranged = df.repartitionByRange(n, *group, *order, *tie).withColumn(PID, F.spark_partition_id())
    inside = Window.partitionBy(PID, *group).orderBy(*order)
    local = F.rank().over(inside).cast("long") if rank else F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = stage(ranged.withColumn(LOCAL, local), name)
    sizes = rows.groupBy(PID, *group).agg(F.sum(weight).alias(SIZE))
    # A group has at most one fragment per range partition, so these windows stay small.
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    fragments = sizes.withColumn(START, F.coalesce(F.sum(SIZE).over(over.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(TOTAL, F.sum(SIZE).over(over))
    return Ranged(rows, fragments, group, order if rank else [])


def with_global(ranged: Ranged, out: str) -> DataFrame:
    """``rows`` with ``out`` = local total + offset of its fragment.

    Only the first group of a range partition can have rows in an earlier partition, so the
    fragments with an offset number at most one per partition: safe to broadcast.
    """
    late = ranged.fragments.filter(F.col(START) > 0).select(PID, *ranged.group, START)
    joined = _join_few(ranged.rows, late, [PID, *ranged.group], START)
    total = F.col(LOCAL) + F.coalesce(START, F.lit(0))
    if ranged.ties:
        joined = _join_few(joined, _cut_ties(ranged), [PID, *ranged.group, *ranged.ties], _BEGUN)
        total = F.coalesce(_BEGUN, total)
    kept = [c for c in ranged.rows.columns if c not in (PID, LOCAL)]
    return joined.select(*kept, total.alias(out))


def _join_few(rows: DataFrame, few: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of ``few``, which has at most one row per range partition."""
    few = few.select(*(F.col(c).alias(f"_few_{c}") for c in keys), value)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_few_{c}"))
    return rows.join(F.broadcast(few), same, "left").drop(*(f"_few_{c}" for c in keys))


def _cut_ties(ranged: Ranged) -> DataFrame:
    """(_pid, group, order, rank) of the tie a partition begins with, if an earlier one began it."""
    key = F.struct(*ranged.group, *ranged.ties)
    starts = _join_few(ranged.rows, ranged.fragments.filter(F.col(START) > 0).select(PID, *ranged.group, START), [PID, *ranged.group], START)
    # Two rows per partition: its first and its last tie, with the rank the last one has.
    ends = starts.groupBy(PID).agg(F.min(key).alias("_first"), F.max(F.struct(key.alias("k"), (F.col(LOCAL) + F.coalesce(START, F.lit(0))).alias("r"))).alias("_last"))
    before = ends.select(F.col(PID).alias("_before"), F.col("_last.k").alias("_k"), F.col("_last.r").alias("_r"))
    met = ends.join(before, (F.col("_first") == F.col("_k")) & (F.col("_before") < F.col(PID)))
    return met.groupBy(PID, "_first").agg(F.min("_r").alias(_BEGUN)).select(PID, "_first.*", _BEGUN)


def carry_forward(df: DataFrame, group: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``df`` with nulls of ``column`` replaced by the last value before them in the group.

    Range-sorted as the totals are, so one group may be any size; what a partition's first
    group has before it comes from the ends of earlier partitions, one row each.
    """
    ranged = df.repartitionByRange(partitions_for(df), *group, *order).withColumn(PID, F.spark_partition_id())
    inside = Window.partitionBy(PID, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = stage(ranged.withColumn(column, F.last(column, ignorenulls=True).over(inside)), name)
    ends = rows.groupBy(PID, *group).agg(F.max_by(column, F.struct(*order)).alias("_end"))
    over = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    late = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(over)).filter(F.col("_carry").isNotNull()).select(PID, *group, "_carry")
    joined = _join_few(rows, late, [PID, *group], "_carry")
    return joined.select(*(F.coalesce(column, "_carry").alias(column) if c == column else F.col(c) for c in df.columns))


def dense_codes(keys: DataFrame, column: str, out: str, name: str) -> DataFrame:
    """Codes 0, 1, 2, ... in key order for the distinct values of ``column`` (null first)."""
    distinct = keys.select(F.col(column)).distinct().withColumn("_one", F.lit(1).cast("long"))
    ranged = range_totals(distinct, [], [column], "_one", name)
    return with_global(ranged, out).select(column, (F.col(out) - 1).alias(out))
