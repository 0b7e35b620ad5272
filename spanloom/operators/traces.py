"""Traces: errored traces, root causes, and whole-trace sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import keep_by_hash
from spanloom.operators.hierarchy import hierarchy


def once(spans: DataFrame, *columns: str) -> DataFrame:
    """One row per (trace_id, span_id): the delivery received first; of ``columns`` only, if given.

    Name the columns: what is not asked for is then neither read nor shuffled.
    """
    kept = [c for c in columns or spans.columns if c not in ("trace_id", "span_id")]
    best = F.min_by(F.struct(*kept), F.struct(F.col("received_at").isNull(), F.col("received_at")))
    return spans.groupBy("trace_id", "span_id").agg(best.alias("_s")).select("trace_id", "span_id", "_s.*")


def tail_sample(spans: DataFrame, rate: float) -> DataFrame:
    """Spans of the traces that are kept: every errored trace, and a hash share of the rest.

    The decision is per trace and map-side combined, then joined back; a trace with most of
    the spans costs one row.
    """
    traces = spans.groupBy("trace_id").agg(F.max((F.col("status") == "error").cast("int")).alias("_bad"))
    kept = traces.filter((F.col("_bad") == 1) | keep_by_hash(F.col("trace_id"), rate)).select("trace_id")
    return spans.join(kept, "trace_id", "left_semi")


def errored_traces(spans: DataFrame, limit: int) -> DataFrame:
    """(trace_id, start_unix_us, status) of spans of errored traces that start them, newest first."""
    bad = spans.filter("status = 'error'").select("trace_id").distinct()
    roots = spans.filter("parent_span_id is null or parent_span_id = ''").join(bad, "trace_id", "left_semi")
    return roots.select("trace_id", "start_unix_us", "status").distinct().orderBy(F.desc("start_unix_us"), "trace_id", "status").limit(limit)


def root_causes(spans: DataFrame) -> DataFrame:
    """(trace_id, origin_span, depth, chain) per errored trace: its deepest errored span.

    Depth is the distance from the root, a missing parent counting as one level; the earliest
    start, then the smaller id win ties. chain is the span's way up to the root, the origin
    first. Spans on loops have no depth and come last.
    """
    one = once(spans.select("trace_id", "span_id", F.expr("nullif(parent_span_id, '')").alias("parent_span_id"), "status", "start_unix_us", "received_at"))
    # Every span of a trace with an error is placed; others leave before the trees grow.
    bad = one.filter("status = 'error'").select("trace_id").distinct()
    one = one.join(bad, "trace_id", "left_semi")
    placed = hierarchy(one, "trace_id", "span_id", "parent_span_id")
    failed = one.filter("status = 'error'").select(F.col("trace_id").alias("tree_key"), F.col("span_id").alias("node_key"), "start_unix_us")
    at = placed.join(failed, ["tree_key", "node_key"])
    missing = F.element_at("path", 1).isNotNull() & F.col("_orphan")
    roots = placed.filter("status = 'orphan_root'").select("tree_key", F.col("node_key").alias("root_key"), F.lit(True).alias("_orphan"))
    at = at.join(roots, ["tree_key", "root_key"], "left").withColumn("_orphan", F.coalesce("_orphan", F.lit(False)))
    depth = F.coalesce(F.col("depth"), F.lit(-1)) + F.when(missing, 1).otherwise(0)
    best = at.groupBy("tree_key").agg(F.max_by(F.struct(F.col("node_key").alias("origin_span"), depth.alias("depth"), F.array_join(F.reverse(F.coalesce("path", F.array("node_key"))), ">").alias("chain")), F.struct(depth, -F.col("start_unix_us"), F.lit(0))).alias("_b"))
    return best.select(F.col("tree_key").alias("trace_id"), "_b.origin_span", "_b.depth", "_b.chain")
