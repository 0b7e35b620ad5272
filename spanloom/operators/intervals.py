"""Interval joins with an equality key and line buckets.

A bare range condition becomes a nested-loop join; here both sides meet on (key, bucket of
``BUCKET`` lines), which is an equi join that also splits a key with very many intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 256


def _buckets(low: str, high: str) -> Column:
    return F.explode(F.sequence(F.expr(f"cast(floor({low} / {BUCKET}) as int)"), F.expr(f"cast(floor(greatest({low}, {high}) / {BUCKET}) as int)")))


def containing(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """Every (point row, range row) with equal ``key`` and low <= point <= high, inclusive."""
    p = points.withColumn("_b", F.expr(f"cast(floor({point} / {BUCKET}) as int)"))
    r = ranges.filter(F.col(low) <= F.col(high)).withColumn("_b", _buckets(low, high))
    return p.join(r, [key, "_b"]).filter(F.col(point).between(F.col(low), F.col(high))).drop("_b")


def innermost(points: DataFrame, ranges: DataFrame, key: str, point_id: list[str], point: str, range_id: str, low: str, high: str) -> DataFrame:
    """(point_id columns, range_id) of the smallest range around each point.

    Ranges of one size tie to the smaller ``range_id``; points in no range have no row.
    """
    slim = ranges.select(key, range_id, low, high)
    inside = containing(points.select(key, *point_id, point).distinct(), slim, key, point, low, high)
    best = inside.groupBy(*point_id).agg(F.min(F.struct((F.col(high) - F.col(low)).alias("size"), F.col(range_id).alias("id"))).alias("_b"))
    return best.select(*point_id, F.col("_b.id").alias(range_id))


def overlapping(left: DataFrame, right: DataFrame, key: str, left_low: str, left_high: str, right_low: str, right_high: str) -> DataFrame:
    """Every pair of rows with equal ``key`` whose line ranges share a line."""
    a = left.filter(F.col(left_low) <= F.col(left_high)).withColumn("_b", _buckets(left_low, left_high))
    b = right.filter(F.col(right_low) <= F.col(right_high)).withColumn("_b", _buckets(right_low, right_high))
    hit = a.join(b, [key, "_b"]).filter((F.col(right_low) <= F.col(left_high)) & (F.col(right_high) >= F.col(left_low)))
    # A pair meets in each bucket both cover; the first of those stands for it.
    first = F.expr(f"cast(floor(greatest({left_low}, {right_low}) / {BUCKET}) as int)")
    return hit.filter(F.col("_b") == first).drop("_b")
