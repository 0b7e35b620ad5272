"""Percentiles of very large numeric columns: cumulative frequencies over mergeable counts.

The state is a table of (group, value, count). States of days, files or partitions merge by
adding counts. Percentiles range-sort a state, run window sums inside each range partition,
add partition offsets, and take the first value whose running count reaches the target rank:
no group is ever one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ranged import LOCAL, PID, SIZE, START, TOTAL, range_totals


def bounded(value: Column, relative_error: float) -> Column:
    """``value`` moved to the middle of its geometric cell: off by at most ``relative_error``.

    Cells have the ratio (1 + e) / (1 - e); zero stays zero, the sign is kept. A group then
    has no more than some thousand distinct values, however many rows it has.
    """
    ratio = (1 + relative_error) / (1 - relative_error)
    cell = F.ceil(F.log(F.abs(value)) / math.log(ratio))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * F.pow(F.lit(ratio), cell) * 2 / (ratio + 1))


def value_counts(df: DataFrame, group: list[str], value: str, relative_error: float = 0.0) -> DataFrame:
    """State of ``df``: (group columns, value double, n). Null and NaN values are left out.

    With ``relative_error`` 0 values are kept as they are and percentiles are exact.
    """
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    kept = bounded(F.col("_v"), relative_error) if relative_error else F.col("_v")
    return rows.groupBy(*group, kept.alias("value")).agg(F.count("*").alias("n"))


def merge_counts(states: list[DataFrame], group: list[str]) -> DataFrame:
    """One state for all rows behind ``states``; built with one relative error, it keeps it."""
    return reduce(DataFrame.unionByName, states).groupBy(*group, "value").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, group: list[str], shares: list[float]) -> DataFrame:
    """(group columns, share, value, n) for every group and each of ``shares``.

    value is the smallest of the group's values whose running count reaches
    ceil(share * n), at least 1; n is the group's count. Null group keys are groups; groups
    without values have no row; an empty state gives no rows.
    """
    ranged = range_totals(state.select(*group, "value", "n"), group, ["value"], "n", "value-counts")
    targets = ranged.fragments.withColumn("share", F.explode(F.array(*(F.lit(float(p)) for p in shares)))).withColumn("_target", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col(TOTAL))))
    # Exactly one fragment of a group holds a target rank, whatever the size of the group.
    hit = targets.filter((F.col(START) < F.col("_target")) & (F.col("_target") <= F.col(START) + F.col(SIZE)))
    hit = hit.select(F.col(PID).alias("_hp"), *(F.col(c).alias(f"_h_{c}") for c in group), "share", F.col(TOTAL).alias("_all"), (F.col("_target") - F.col(START)).alias("_rank"))
    cond = (F.col(PID) == F.col("_hp")) & (F.col(LOCAL) >= F.col("_rank")) & (F.col(LOCAL) - F.col("n") < F.col("_rank"))
    for c in group:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return ranged.rows.join(hit, cond).select(*group, "share", "value", F.col("_all").alias("n"))
