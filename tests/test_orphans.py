import random

import numpy as np
import pytest

from spanloom.operators import orphans as module
from spanloom.operators.orphans import Container, orphan_keys, orphan_references

REFS, PARENTS = "row_key string, key string, period int, extra string", "key string, _k int"


@pytest.mark.parametrize("sparse", [0, 50, 10**6])
def test_container_and_not(monkeypatch, sparse):
    monkeypatch.setattr(module, "SPARSE", sparse)
    rng = np.random.default_rng(2)
    for size in (0, 1, 40, 3000):
        a, b = rng.integers(0, 65536, size), rng.integers(0, 65536, size)
        b = np.concatenate((b, a[: size // 2]))
        assert Container(a).and_not(Container(b)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert Container(np.array([0, 65535])).and_not(Container(np.array([0]))).tolist() == [65535]


@pytest.mark.parametrize("buffer_rows", [200_000, 16])
def test_matches_brute_force(spark, rows, buffer_rows):
    rng = random.Random(4)
    parents = [f"k{i}" for i in range(0, 300, 2)]
    refs = [(f"r{i}", None if i % 31 == 0 else "k1" if i % 3 == 0 else f"k{rng.randrange(400)}", rng.choice([None, 1, 2, 20000]), "e") for i in range(900)]
    got = orphan_references(spark.createDataFrame(refs + refs[:50], REFS).repartition(4), spark.createDataFrame([(p, 1) for p in parents + parents[:9] + [None]], PARENTS), buffer_rows)
    assert rows(got) == sorted({(r, k, p) for r, k, p, _ in refs if k is not None and k not in parents}, key=repr)


def test_long_keys(spark, rows):
    refs = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("c", 2, 1)], "row_key string, key long, period int")
    parents = spark.createDataFrame([(1,)], "key long")
    assert rows(orphan_keys(refs, parents)) == [(2, 0), (2, 1)]


def test_empty_sides(spark, rows):
    refs = spark.createDataFrame([("a", "x", 1, "")], REFS)
    none = spark.createDataFrame([], PARENTS)
    assert rows(orphan_references(refs, none)) == [("a", "x", 1)]
    assert orphan_references(spark.createDataFrame([], REFS), none).count() == 0
    assert orphan_references(refs, spark.createDataFrame([("x", 1)], PARENTS)).count() == 0


def test_more_keys_than_one_key_range(spark):
    refs = spark.range(0, 150_000).selectExpr("cast(id as string) row_key", "id key", "cast(id % 3 as int) period")
    parents = spark.range(0, 150_000, 7).selectExpr("id key")
    got = orphan_references(refs.coalesce(1), parents)
    assert got.count() == 150_000 - len(range(0, 150_000, 7))
    assert got.filter("key % 7 = 0").count() == 0
