import random

import pytest

from spanloom.operators.hierarchy import ancestor_pairs, hierarchy

SCHEMA = "t string, s string, p string"
COLUMNS = ("tree_key", "node_key", "status", "depth", "root_key", "path", "loop_key")


def brute(data):
    parent = {}
    for t, s, p in data:
        if t is None or s is None:
            continue
        if (t, s) not in parent or (p is None and parent[t, s] is not None) or (p is not None and parent[t, s] is not None and p < parent[t, s]):
            parent[t, s] = p
    out = []
    for (t, s), p in parent.items():
        path, at = [s], p
        while at is not None and (t, at) in parent and at not in path:
            path.append(at)
            at = parent[t, at]
        if at is not None and (t, at) in parent:
            on = at == s
            loop = min(path[path.index(at) :]) if on else None
            out.append((t, s, "cycle" if on else "below_cycle", None, None, None, loop))
        else:
            status = "node" if len(path) > 1 else "root" if p is None else "orphan_root"
            out.append((t, s, status, len(path) - 1, path[-1], path[::-1], None))
    return sorted(out, key=repr)


def forest(seed, n=300):
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        t = "hot" if rng.random() < 0.4 else f"t{rng.randrange(12)}"
        p = None if rng.random() < 0.05 else f"n{rng.randrange(70)}"
        data.append((t, f"n{rng.randrange(70)}", p))
    return data


@pytest.mark.parametrize("giant_rows", [10**9, 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_in_memory_and_distributed(spark, rows, seed, giant_rows):
    data = forest(seed)
    df = spark.createDataFrame(data + data[:40], SCHEMA).repartition(3)
    assert rows(hierarchy(df, "t", "s", "p", giant_rows=giant_rows), *COLUMNS) == brute(data)


def test_runs_cut_between_trees(spark, rows):
    data = forest(3)
    assert rows(hierarchy(spark.createDataFrame(data, SCHEMA).coalesce(1), "t", "s", "p", run_rows=10, run_path=7), *COLUMNS) == brute(data)


def test_descendants(spark, rows):
    df = spark.createDataFrame([("a", "1", None), ("a", "2", "1"), ("a", "3", "2"), ("a", "9", "9"), ("a", "8", "gone"), ("a", "7", "8")], SCHEMA)
    assert rows(ancestor_pairs(hierarchy(df, "t", "s", "p"))) == [("a", "1", "2", 1), ("a", "1", "3", 2), ("a", "2", "3", 1), ("a", "8", "7", 1)]


def test_deep_chain(spark):
    n = 3000
    df = spark.createDataFrame([("a", f"{i:05d}", f"{i - 1:05d}" if i else None) for i in range(n)], SCHEMA)
    placed = hierarchy(df, "t", "s", "p")
    assert placed.agg({"depth": "max"}).first()[0] == n - 1
    assert placed.filter("size(path) != depth + 1").count() == 0


def test_nulls_empty_and_clashing_columns(spark, rows):
    df = spark.createDataFrame([(None, "x", None, 1), ("a", None, "x", 1), ("a", "x", "", 1)], SCHEMA + ", _tree int")
    assert rows(hierarchy(df, "t", "s", "p"), "tree_key", "node_key", "status") == sorted([("a", None, "no_key"), ("a", "x", "orphan_root"), (None, "x", "no_key")], key=repr)
    assert hierarchy(spark.createDataFrame([], SCHEMA), "t", "s", "p").count() == 0


def test_same_node_name_in_other_trees(spark, rows):
    df = spark.createDataFrame([("a", "x", "y"), ("b", "y", "x"), ("b", "x", "y")], SCHEMA)
    assert rows(hierarchy(df, "t", "s", "p"), "tree_key", "node_key", "status") == [("a", "x", "orphan_root"), ("b", "x", "cycle"), ("b", "y", "cycle")]


def test_keys_with_separators_stay_apart(spark, rows):
    """Tree and node keys that hold NUL or colons make no two rows one."""
    data = [("a\0b", "c", None), ("a", "b\0c", None), ("1:a", "x", None), ("1", "a:x", "x"), ("1", "x", None)]
    got = rows(hierarchy(spark.createDataFrame(data, "t string, s string, p string"), "t", "s", "p"), "tree_key", "node_key", "status")
    assert got == sorted([("a\0b", "c", "root"), ("a", "b\0c", "root"), ("1:a", "x", "root"), ("1", "a:x", "node"), ("1", "x", "root")], key=repr)
