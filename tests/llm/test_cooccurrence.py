import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from spanloom.llm import cooccurrence as module
from spanloom.llm.cooccurrence import cooccurring_pairs, heavy_pairs, light_pairs

SCHEMA = "g string, r string, i string, _a int"


def brute(data, support):
    records = defaultdict(set)
    for g, r, i, _ in data:
        if None not in (g, r, i):
            records[g, r].add(i)
    n, pairs, size = defaultdict(int), defaultdict(int), defaultdict(int)
    for (g, _), items in records.items():
        size[g] += 1
        for i in items:
            n[g, i] += 1
        for a, b in combinations(sorted(items), 2):
            pairs[g, a, b] += 1
    return {(g, a, b): (c, n[g, a], n[g, b], size[g], c * size[g] / (n[g, a] * n[g, b])) for (g, a, b), c in pairs.items() if c >= support}


def sample(seed, n=2500):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        i = rng.choice(["top", "top2", "ünï"]) if rng.random() < 0.4 else f"i{int(rng.paretovariate(0.6)) % 60}"
        rows.append((g, None if rng.random() < 0.01 else f"r{rng.randrange(120)}", None if rng.random() < 0.03 else i, 1))
    return rows


@pytest.mark.parametrize("share", [1.1, 1 / 30, 1e-9])
@pytest.mark.parametrize("support", [1, 4])
def test_all_light_mixed_and_all_heavy_agree(spark, share, support):
    data = sample(1)
    got = cooccurring_pairs(spark.createDataFrame(data + data[:200], SCHEMA).repartition(3), "r", "i", "g", support, share)
    want = brute(data, support)
    found = {(r.g, r.item_a, r.item_b): tuple(r)[3:] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k][:4] == want[k][:4] and abs(found[k][4] - want[k][4]) < 1e-12 for k in want)


def test_one_wide_record_is_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(module, "PAIR_CHUNK", 100)
    counted = defaultdict(int)
    for a, b, n in light_pairs(np.zeros(80, np.int64), np.arange(80)[::-1].copy()):
        for x, y, k in zip(a, b, n):
            counted[int(x), int(y)] += int(k)
    assert counted == {p: 1 for p in combinations(range(80), 2)}


def test_popcounts():
    rng = np.random.default_rng(1)
    rows = rng.random((200, 7)) < 0.4
    member, item = np.nonzero(rows)
    got = heavy_pairs(member, item, 200, 7)
    assert (got == np.triu(rows.T.astype(int) @ rows.astype(int))).all()


def test_empty_and_single_items(spark):
    assert cooccurring_pairs(spark.createDataFrame([], SCHEMA), "r", "i", "g").count() == 0
    assert cooccurring_pairs(spark.createDataFrame([("g", "1", "a", 0), ("g", "2", "b", 0), ("g", "1", "a", 0)], SCHEMA), "r", "i", "g").count() == 0


@pytest.mark.parametrize("share", [1 / 2048, 0.02])
def test_wide_records_are_dealt_and_nothing_changes(spark, monkeypatch, share):
    random.seed(3)
    data = [("s", f"t{t}", f"f{random.randint(0, 90)}") for t in range(6) for _ in range(60)] + [("s", f"u{t}", f"f{t % 7}") for t in range(30)]
    df = spark.createDataFrame(data, "service string, trace string, fn string")
    go = lambda: sorted(tuple(r) for r in cooccurring_pairs(df, "trace", "fn", "service", 1, share).collect())
    plain = go()
    monkeypatch.setattr(module, "WIDE_RECORD", 8)
    assert go() == plain and len(plain) > 500
