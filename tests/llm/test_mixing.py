import pytest

from spanloom.llm.mixing import plan_mix, reached_shares, sample_mix, water_fill

TOKENS, TARGETS = "doc_id long, source string, n_tokens long, copies int", "source string, target_share double, repeat_cap int"


def test_water_fill_redistributes_until_feasible():
    plan = {p.source: p for p in water_fill([("a", 0.5, 2, 100), ("b", 0.3, 1, 320), ("c", 0.2, 5, 1000), ("d", 0.0, 3, 50)], 1000)}
    assert plan["a"].clamped and plan["a"].planned_tokens == 200
    # b would get 0.3 / 0.5 of the remaining 800 and is over its cap in the second round.
    assert plan["b"].clamped and plan["b"].planned_tokens == 320
    assert plan["c"].planned_tokens == pytest.approx(480) and not plan["c"].clamped
    assert plan["d"].planned_tokens == 0
    assert [p.reachable for p in plan.values()] == [False, True, True, True]


def test_all_clamped_and_no_budget():
    assert sum(p.planned_tokens for p in water_fill([("a", 0.5, 1, 10), ("b", 0.5, 1, 0)], 100)) == 10
    assert [p.planned_tokens for p in water_fill([("a", 1.0, 1, 10)], 0)] == [0.0]


def corpus(spark, n=6000):
    rows = [(i, ("big", "mid", "small", None, "other")[0 if i % 3 == 0 else 1 + i % 4], (i * 37) % 200, 7) for i in range(n)]
    return rows, spark.createDataFrame(rows, TOKENS)


def test_mix_reaches_its_shares(spark):
    rows, tokens = corpus(spark)
    targets = spark.createDataFrame([("big", 0.2, 2), ("mid", 0.5, 3), ("small", 0.3, 1), ("gone", 0.0, 2), (None, 0.3, 1), ("big", 0.0, 4)], TARGETS)
    plan = plan_mix(tokens, targets)
    mix = sample_mix(tokens, plan)
    shares = {r.source: r for r in reached_shares(mix, plan).collect()}
    assert set(shares) == {"big", "mid", "small", "gone"}
    total = sum(r.planned_tokens for r in shares.values())
    for r in shares.values():
        assert r.most_copies <= r.repeat_cap
        assert abs(r.reached_share - r.planned_tokens / total) < 0.02
    assert shares["small"].clamped and not shares["small"].reachable
    assert sorted(mix.collect()) == sorted(sample_mix(tokens.repartition(7), plan).collect())
    assert sample_mix(tokens, plan, seed=5).exceptAll(mix).count() > 0


def test_found_rule_and_empty_tables(spark):
    rows, tokens = corpus(spark, 400)
    plan = plan_mix(tokens, spark.createDataFrame([("small", 0.9, 2), ("absent", 0.01, 9), ("mid", 0.01, 1)], TARGETS))
    size = lambda s: sum(n for _, x, n, _ in rows if x == s)
    total = sum(n for *_, n, _ in rows)
    want = {s for s, share, cap in (("small", 0.9, 2), ("absent", 0.01, 9), ("mid", 0.01, 1)) if size(s) * cap < share * total}
    assert {r.source for r in plan.filter("not reachable").collect()} == want == {"small", "absent"}
    none = spark.createDataFrame([], TOKENS)
    assert plan_mix(tokens, spark.createDataFrame([], TARGETS)).count() == 0
    empty = plan_mix(none, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert sample_mix(none, empty).count() == 0 and reached_shares(sample_mix(none, empty), empty).first().reached_share == 0
    nulls = spark.createDataFrame([(1, "a", None, 0)], TOKENS)
    assert plan_mix(nulls, spark.createDataFrame([("a", None, None)], TARGETS)).first().tokens == 0


def test_first_fill_decides_what_is_reachable():
    import random

    from spanloom.llm.mixing import water_fill

    random.seed(5)
    for _ in range(300):
        n = random.randint(1, 8)
        raw = [random.randint(0, 6) for _ in range(n)]
        shares = [r / (sum(raw) or 1) for r in raw]
        sizes = [random.choice([0, 10, 100, random.randint(1, 400)]) for _ in range(n)]
        caps, budget = [random.randint(1, 4) for _ in range(n)], sum(sizes) + random.randint(0, 300)
        plan = water_fill([(str(i), shares[i], caps[i], sizes[i]) for i in range(n)], budget)
        # Brute force: one comparison per source. Ties of exact arithmetic may fall either way by rounding.
        for i, p in enumerate(plan):
            short = shares[i] * budget - caps[i] * sizes[i]
            if abs(short) > 1e-6:
                assert p.reachable is (short < 0), (p, budget)
            assert p.planned_tokens <= caps[i] * sizes[i] + 1e-6 and p.epochs <= caps[i] + 1e-9
            if not p.reachable:
                assert p.clamped and p.planned_tokens == caps[i] * sizes[i]
        assert sum(p.planned_tokens for p in plan) <= budget + 1e-6


def test_mix_keeps_caps_and_comes_near_its_plan(spark):
    from spanloom.llm.mixing import plan_mix, reached_shares, sample_mix

    docs = spark.range(0, 4000).selectExpr("id as doc_id", "case when id % 10 < 6 then 'big' when id % 10 < 9 then 'mid' when id % 50 = 9 then 'tiny' end as source", "1 + id % 7 as n_tokens")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.5, 3), ("tiny", 0.2, 2), ("none", 0.0, 5)], "source string, target_share double, repeat_cap int")
    plan = plan_mix(docs, targets)
    got = {r.source: r for r in reached_shares(sample_mix(docs, plan), plan).collect()}
    whole = docs.agg({"n_tokens": "sum"}).first()[0]
    assert not got["tiny"].reachable and got["tiny"].most_copies == 2 and got["none"].mix_tokens == 0
    for r in got.values():
        assert r.most_copies <= r.repeat_cap and abs(r.mix_tokens - r.planned_tokens) < 0.03 * whole
    assert abs(sum(r.reached_share for r in got.values()) - 1) < 1e-9
