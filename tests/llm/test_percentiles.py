import math
import random

import pytest

from spanloom.llm.percentiles import merge_counts, percentiles, value_counts

SCHEMA = "g string, h string, v double, n int"
SHARES = [0.0, 0.5, 0.95, 1.0]


def sample(seed, n=1200):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g = "hot" if rng.random() < 0.5 else rng.choice(["a", None])
        v = rng.choice([None, float("nan"), 0.0, -3.5, float(rng.randrange(40)), rng.lognormvariate(5, 3)])
        rows.append((g, rng.choice(["x", None]), v, 1))
    return rows


def brute(data):
    groups = {}
    for g, h, v, _ in data:
        if v is not None and not math.isnan(v):
            groups.setdefault((g, h), []).append(v)
    return {(g, h, p): (sorted(vs)[max(1, math.ceil(p * len(vs))) - 1], len(vs)) for (g, h), vs in groups.items() for p in SHARES}


def test_exact(spark):
    data = sample(1)
    state = value_counts(spark.createDataFrame(data, SCHEMA).repartition(4), ["g", "h"], "v")
    got = {(r.g, r.h, r.share): (r.value, r.n) for r in percentiles(state, ["g", "h"], SHARES).collect()}
    assert got == brute(data)


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_bounded_error_and_merging_of_days(spark, error):
    days = [sample(s, 500) for s in (1, 2, 3)]
    states = [value_counts(spark.createDataFrame(d, SCHEMA), ["g", "h"], "v", error) for d in days]
    got = {(r.g, r.h, r.share): (r.value, r.n) for r in percentiles(merge_counts(states, ["g", "h"]), ["g", "h"], SHARES).collect()}
    want = brute([r for d in days for r in d])
    assert got.keys() == want.keys()
    for key, (value, n) in want.items():
        assert got[key][1] == n
        assert abs(got[key][0] - value) <= error * abs(value) * (1 + 1e-9)


def test_empty_and_all_null(spark):
    for rows in ([], [("a", "b", None, 1)]):
        state = value_counts(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "v")
        assert percentiles(state, ["g", "h"], SHARES).count() == 0
