from spanloom.operators.ranged import carry_forward, dense_codes, range_totals, with_global


def test_running_totals_of_a_hot_group_span_partitions(spark, rows):
    data = [("hot", i % 50, 1) for i in range(400)] + [(None, 1, 2), ("b", 3, 5), ("b", 2, 1)]
    df = spark.createDataFrame(data, "g string, v int, w long").groupBy("g", "v").sum("w").withColumnRenamed("sum(w)", "w")
    ranged = range_totals(df, ["g"], ["v"], "w", "t", partitions=8)
    assert ranged.rows.filter("g = 'hot'").select("_pid").distinct().count() > 1
    got = rows(with_global(ranged, "cum"), "g", "v", "cum")
    want = [("hot", v, 8 * (v + 1)) for v in range(50)] + [(None, 1, 2), ("b", 2, 1), ("b", 3, 6)]
    assert got == sorted(want, key=repr)


def test_rank_ties(spark, rows):
    df = spark.createDataFrame([("a", v, 1) for v in (1, 1, 2, 3, 3, 3, 9)], "g string, v int, w long")
    got = rows(with_global(range_totals(df, ["g"], ["v"], "w", "t", rank=True), "r"), "v", "r")
    assert got == [(1, 1), (1, 1), (2, 3), (3, 4), (3, 4), (3, 4), (9, 7)]


def test_dense_codes(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    assert rows(dense_codes(df, "k", "c", "t")) == sorted([(None, 0), ("a", 1), ("b", 2)], key=repr)


def test_rank_of_a_tie_cut_by_partitions(spark):
    """One value with most rows lies in many partitions, and all its rows have one rank."""
    df = spark.range(0, 3000).selectExpr("id % 2 as g", "cast(case when id < 40 then 1 when id < 2900 then 5 else id end as double) as v", "id", "1L as one")
    ranged = range_totals(df, ["g"], ["v"], "one", "ties", 6, rank=True)
    assert ranged.rows.filter("v = 5").select("_pid").distinct().count() > 1
    got = {(r.g, r.id): r.r for r in with_global(ranged, "r").collect()}
    want = {(r.g, r.id): r.r for r in df.selectExpr("g", "id", "rank() over (partition by g order by v) as r").collect()}
    assert got == want


def test_carry_forward_across_partitions(spark):
    rows = [(g, n, f"{g}{n}" if n in (3, 400) and g != "c" else None) for g in "abc" for n in range(500)]
    df = spark.createDataFrame(rows, "g string, n int, v string")
    got = {(r.g, r.n): r.v for r in carry_forward(df, ["g"], ["n"], "v", "carry").collect()}
    assert got == {(g, n): None if g == "c" or n < 3 else f"{g}{3 if n < 400 else 400}" for g in "abc" for n in range(500)}
    assert carry_forward(df.limit(0), ["g"], ["n"], "v", "carry").count() == 0
