import pytest
from pyspark.sql import functions as F

from spanloom.operators.traces import tail_sample
from spanloom.streaming.sampler import deliver_once, keeps, receiver_report, run_batchwise, sampled_with_statistics, tail_sample_stream, traffic_windows

SCHEMA = "trace_id string, span_id string, parent_span_id string, status string, start_unix_us long, service_name string, http_route string, duration_us long"


def spans(n=60):
    out = []
    for t in range(n):
        bad = t % 11 == 0
        out += [(f"t{t}", "r", None, "ok", 10**15 + t * 10**7, "svc", "/a", 5), (f"t{t}", "c", "r", "error" if bad else "ok", 10**15 + t * 10**7 + 5, "svc", None, 2)]
    return out


def run(stream, tmp_path, name):
    rows = []
    query = run_batchwise(stream, lambda batch, _: rows.extend(batch.collect()), str(tmp_path / f"cp-{name}"))
    query.awaitTermination()
    return rows


def test_stream_and_batch_sampling_agree(spark, tmp_path):
    df = spark.createDataFrame(spans(), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted((r.trace_id, r.span_id) for r in run(tail_sample_stream(stream, 0.2, 0), tmp_path, "s"))
    assert got == sorted((r.trace_id, r.span_id) for r in tail_sample(df, 0.2).collect())
    assert {t for t, _ in got} >= {f"t{t}" for t in range(0, 60, 11)}


def test_undecided_and_late_spans(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        check_undecided(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def check_undecided(spark, tmp_path):
    folder = tmp_path / "in"
    write = lambda *rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    write(("a", "c1", "r", "error", 1, "s", None, 1), ("b", "r", None, "ok", 1, "s", None, 1))
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
    sampled = tail_sample_stream(stream, 0.0)
    assert run(sampled, tmp_path, "x") == []  # a has no root yet, b is dropped at its root
    write(("a", "r", None, "ok", 2, "s", None, 1), ("b", "late", "r", "error", 2, "s", None, 1))
    assert sorted((r.trace_id, r.span_id) for r in run(sampled, tmp_path, "x")) == [("a", "c1"), ("a", "r")]


def test_decision_rule():
    assert keeps("x", True, 0.0) and not keeps("x", False, 0.0) and keeps("x", False, 1.0)


def test_deliver_once(spark, tmp_path):
    data = spark.createDataFrame(spans(5) + spans(5), SCHEMA)
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    deliver_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


@pytest.mark.parametrize("slide", [None, "10 seconds"])
def test_traffic_windows(spark, slide):
    got = traffic_windows(spark.createDataFrame(spans(6), SCHEMA), "20 seconds", slide)
    assert got.agg(F.sum("n_spans")).first()[0] == 12 * (2 if slide else 1)
    assert got.agg(F.sum("n_errors")).first()[0] == 2 if slide else 1


def test_receiver_report(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        rows = [("a", "r", None, "ok", 1, "s", None, 1), ("a", "c", "r", "error", 1, "s", None, 1), ("b", "r", None, "ok", 1, "s", None, 1), ("c", "x", "gone", "ok", 1, "s", None, 1)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = run_batchwise(sampled_with_statistics(stream, 0.0), lambda b, _: b.collect(), str(tmp_path / "cp"))
        query.awaitTermination()
        assert receiver_report(query) == {"received": 4, "errored": 1, "kept": 2, "buffered": 1}
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_timer_counts_from_first_sight(spark, tmp_path):
    """An undecided errored trace that gets spans in two batches is released at first seen + timeout."""
    import time

    folder, rows, seen = tmp_path / "in", [], {}
    write = lambda *new: spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    def keep(batch, _):
        for r in batch.collect():
            rows.append((r.trace_id, r.span_id))
            seen.setdefault(r.trace_id, time.time())

    def wait(until, most=60):
        end = time.time() + most
        while not until() and time.time() < end:
            time.sleep(0.2)

    write(("bad", "a", "gone", "error", 1, "s", None, 1), ("fine", "a", "gone", "ok", 1, "s", None, 1))
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
    query = tail_sample_stream(stream, 0.0, 12_000).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        wait(lambda: any(p["numInputRows"] for p in query.recentProgress))
        began = time.time()
        write(("bad", "b", "gone", "ok", 2, "s", None, 1))
        wait(lambda: sum(p["numInputRows"] for p in query.recentProgress) >= 3)
        assert rows == []
        wait(lambda: rows)
        wait(lambda: query.lastProgress["stateOperators"] and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0, 20)
        assert sorted(rows) == [("bad", "a"), ("bad", "b")]
        assert seen["bad"] - began < 40
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        query.stop()


def test_late_spans_are_dropped_behind_a_finite_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    hour = 3_600_000_000
    write = lambda *ats: spark.createDataFrame([(f"t{a}", f"s{a}", None, "ok", a, "svc", "/a", 1) for a in ats], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    out, rows = tmp_path / "cp", []

    def go():
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
        q = traffic_windows(stream, "1 hour", delay="1 hour").writeStream.outputMode("append").foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(out)).trigger(availableNow=True).start()
        q.awaitTermination()

    write(1, 2)
    go()
    write(5 * hour)
    go()
    write(3)  # hours behind the watermark of 4 h: too late for its window
    go()
    write(9 * hour)
    go()
    assert [(r.n_spans, r.window_start.hour) for r in sorted(rows, key=lambda r: r.window_start)] == [(2, 0), (1, 5)]
