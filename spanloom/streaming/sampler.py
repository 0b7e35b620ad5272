"""Streams of spans: whole-trace sampling with timers, an idempotent sink, traffic windows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRACE_TIMEOUT_MS = 30_000
SAMPLE_RATE = 0.01


def fnv1a(text: str) -> int:
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % (1 << 32)
    return h


def keeps(trace_id: str, errored: bool, rate: float) -> bool:
    """The decision on a trace: errors always stay, the rest by a hash of the id."""
    return errored or rate >= 1 or rate > 0 and fnv1a(trace_id) % 10_000 / 10_000 < rate


def _sampler(columns: list[str], rate: float, timeout_ms: int):
    """Buffers a trace until its root arrives or its time is up, then keeps or drops it whole.

    Time counts from the first sight of the trace: every batch that leaves it undecided sets
    the timer again, to what then remains. State holds the undecided spans of one trace and
    goes at the decision, so a span that comes later opens a trace of its own and is decided
    alone. A timeout of 0 decides on what each batch brings, for the last batch before a
    shutdown.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, first_ms = (list(pickle.loads(state.get[0])), state.get[1]) if state.exists else ([], None)
        if not state.hasTimedOut:
            parts += [part[columns] for part in batches if len(part)]
        held = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
        rooted = (held["parent_span_id"].isna() | (held["parent_span_id"] == "")).any()
        if not (rooted or state.hasTimedOut or timeout_ms <= 0):
            now = state.getCurrentProcessingTimeMs()
            first_ms = now if first_ms is None else first_ms
            state.update((pickle.dumps(parts), first_ms))
            state.setTimeoutDuration(max(1, first_ms + timeout_ms - now))
            return
        if state.exists:
            state.remove()
        if len(held) and keeps(key[0], bool((held["status"] == "error").any()), rate):
            yield held

    return decide


def tail_sample_stream(spans: DataFrame, rate: float = SAMPLE_RATE, timeout_ms: int = TRACE_TIMEOUT_MS) -> DataFrame:
    """Sampled stream of ``spans``; state is fault tolerant, in whichever store the session names.

    With a timeout the query wakes up for timers, so it runs until it is stopped; one that is
    to end with its input takes a timeout of 0, or no batches without data.
    """
    decide = _sampler(spans.columns, rate, timeout_ms)
    timer = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms > 0 else GroupStateTimeout.NoTimeout
    return spans.groupBy("trace_id").applyInPandasWithState(decide, spans.schema, "held binary, first_ms long", "append", timer)


def deliver_once(spans: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Append spans to Parquet at ``path``, each (trace, span) once within the watermark."""
    timed = spans.withColumn("_at", F.timestamp_micros("start_unix_us")).withWatermark("_at", delay)
    once = timed.dropDuplicatesWithinWatermark(["trace_id", "span_id"]).withColumn("day", F.to_date("_at")).drop("_at")
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(**(trigger or {"availableNow": True})).start()


def traffic_windows(spans: DataFrame, length: str = "5 minutes", slide: str | None = None, delay: str = "30 seconds") -> DataFrame:
    """Requests, errors and durations per service and route in tumbling or sliding windows.

    A stream that has the column ``at`` brings its own watermark on it.
    """
    timed = spans
    if "at" not in spans.columns:
        timed = spans.withColumn("at", F.timestamp_micros("start_unix_us"))
        timed = timed.withWatermark("at", delay) if spans.isStreaming else timed
    window = F.window("at", length, slide) if slide else F.window("at", length)
    grouped = timed.groupBy(window.alias("w"), "service_name", "http_route")
    return grouped.agg(F.count("*").alias("n_spans"), F.sum((F.col("status") == "error").cast("long")).alias("n_errors"), F.sum("duration_us").alias("duration_us")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "service_name", "http_route", "n_spans", "n_errors", "duration_us")


def service_sessions(spans: DataFrame, gap: str = "10 minutes", delay: str = "30 seconds") -> DataFrame:
    """Runs of traffic of each service that no gap of ``gap`` interrupts."""
    timed = spans.withColumn("at", F.timestamp_micros("start_unix_us"))
    if spans.isStreaming:
        timed = timed.withWatermark("at", delay)
    grouped = timed.groupBy(F.session_window("at", gap).alias("w"), "service_name").agg(F.count("*").alias("n_spans"))
    return grouped.select("service_name", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_spans")


def sampled_with_statistics(spans: DataFrame, rate: float = SAMPLE_RATE, timeout_ms: int = TRACE_TIMEOUT_MS) -> DataFrame:
    """``tail_sample_stream`` with counts of what comes and what is kept, for ``receiver_report``."""
    counted = spans.observe("received", F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errored"))
    return tail_sample_stream(counted, rate, timeout_ms).observe("kept", F.count("*").alias("n"))


def receiver_report(query: StreamingQuery) -> dict[str, int]:
    """received, errored and kept spans of the batches the query remembers, and the traces it holds undecided."""
    progress = query.recentProgress
    total = lambda name, field: sum(p.observedMetrics[name][field] for p in progress if name in p.observedMetrics)
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    return {"received": total("received", "n"), "errored": total("received", "errored"), "kept": total("kept", "n"), "buffered": held[-1] if held else 0}


def run_batchwise(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``handle`` on every micro-batch that is there, then stop."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
