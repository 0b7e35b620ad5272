import datetime as dt
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from spanloom.operators.heavy_keys import dense_key_stats


def brute(rows):
    out = defaultdict(lambda: [0, 0, 0, None, None, None])
    for k, v, t in rows:
        s = out[k]
        s[0] += 1
        if v is not None:
            s[1] += 1
            s[2] += v
            s[3] = v if s[3] is None else min(s[3], v)
            s[4] = v if s[4] is None else max(s[4], v)
        if t is not None:
            s[5] = t if s[5] is None else max(s[5], t)
    return sorted(((k, n, m, total if m else None, lo, hi, last) for k, (n, m, total, lo, hi, last) in out.items()), key=repr)


SCHEMA = "k string, v long, t timestamp_ntz"


@pytest.mark.parametrize("split_rows", [7, 400_000])
def test_matches_brute_force_with_a_hot_key_and_nulls(spark, rows, split_rows):
    rng = np.random.default_rng(5)
    at = dt.datetime(2026, 1, 1)
    data = [
        (None if i % 19 == 0 else "hot" if i % 3 == 0 else f"k{rng.integers(40)}", None if i % 7 == 0 else int(rng.integers(-50, 2**40)), None if i % 5 == 0 else at + dt.timedelta(seconds=int(rng.integers(10_000))))
        for i in range(600)
    ]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert rows(dense_key_stats(df, "k", "v", "t", split_rows=split_rows)) == brute(data)


def test_long_keys_across_blocks(spark, rows):
    data = [(i % 23, 1, None) for i in range(100)]
    df = spark.createDataFrame(data, "k long, v long, t timestamp_ntz")
    assert rows(dense_key_stats(df, "k", "v", block=4), "key_value", "n_rows") == sorted([(k, len([1 for x, *_ in data if x == k])) for k in range(23)], key=repr)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dense_key_stats(empty, "k", "v", "t").count() == 0
    df = spark.createDataFrame(pd.DataFrame({"n": ["a", "a"], "total": [1, 2], "_k": [9, 9], "key_value": ["x", "y"]}))
    got = dense_key_stats(df, "n", "total").first()
    assert (got.key_value, got.n_rows, got.sum_value) == ("a", 2, 3)


def test_all_values_null(spark):
    got = dense_key_stats(spark.createDataFrame([("a", None, None)], SCHEMA), "k", "v", "t").first()
    assert got.n_rows == 1 and got.n_values == 0 and got.sum_value is None and got.min_value is None and got.last_observed is None
