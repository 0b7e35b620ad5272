import math
import random
import statistics
from collections import defaultdict

from spanloom.llm.rank_fusion import best_items, median_ranks, positions

HITS = "query_id long, node_key string, build_id long, score double, own string"
BUILDS = "build_id long, score_order string, w double"


def brute(hits, orders):
    best = defaultdict(dict)
    for q, item, b, v, *_ in hits:
        if None in (q, item, b, v) or math.isnan(v):
            continue
        v = v if orders.get(b) == "asc" else -v
        best[q, b][item] = min(v, best[q, b].get(item, math.inf))
    out = {}
    for q in {q for q, _ in best}:
        lists = [scores for (p, _), scores in best.items() if p == q]
        for item in {i for scores in lists for i in scores}:
            ranks = [1 + sum(v < s[item] for v in s.values()) if item in s else len(s) + 1 for s in lists]
            out[q, item] = (statistics.median(ranks), sum(ranks) / len(ranks), sum(item in s for s in lists))
    return out


def sample(seed):
    rng = random.Random(seed)
    hits = []
    for _ in range(700):
        q = 1 if rng.random() < 0.4 else rng.randrange(2, 9)
        v = rng.choice([None, float("nan"), float(rng.randrange(12)), rng.random() * 10**6])
        hits.append((rng.choice([q, q, q, None]) if rng.random() < 0.05 else q, None if rng.random() < 0.02 else f"k{rng.randrange(25)}", rng.randrange(4), v, "x"))
    return hits


def test_matches_brute_force_with_ties_nulls_and_a_hot_query(spark):
    hits = sample(3)
    orders = {0: "asc", 1: "desc", 2: "asc"}  # build 3 is not listed: high is better
    ranks = median_ranks(spark.createDataFrame(hits + hits[:100], HITS).repartition(3), spark.createDataFrame([(b, o, 1.0) for b, o in orders.items()], BUILDS), "query_id", "node_key", "build_id", "score", "score_order")
    want = brute(hits, orders)
    got = {(r.query_id, r.node_key): (r.median_rank, r.mean_rank, r.n_scores) for r in ranks.collect()}
    assert got.keys() == want.keys()
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and a[2] == b[2] for a, b in ((got[k], want[k]) for k in want))
    first = {r.query_id: r.node_key for r in best_items(ranks, "query_id", "node_key").collect()}
    assert first == {q: min((v[:2], k[1]) for k, v in want.items() if k[0] == q)[1] for q in {k[0] for k in want}}
    placed = positions(ranks, "query_id", "node_key").filter("query_id = 1").orderBy("position").collect()
    assert [r.position for r in placed] == list(range(1, len(placed) + 1)) and placed[0].node_key == first[1]


def test_no_range_dominates(spark):
    hits = [(1, k, b, s, "") for b, scale in ((0, 1.0), (1, 1.0), (2, 1e9)) for k, s in (("good", 3 * scale if b < 2 else 0.0), ("loud", 2.0 if b < 2 else 9 * scale), ("mid", 1.0 * scale))]
    ranks = median_ranks(spark.createDataFrame(hits, HITS), spark.createDataFrame([], BUILDS), "query_id", "node_key", "build_id", "score", "score_order")
    assert best_items(ranks, "query_id", "node_key").first().node_key == "good"


def test_weights_move_the_median(spark):
    hits = [(1, k, b, float(s), "") for b, order in ((0, "abc"), (1, "abc"), (2, "cba")) for s, k in enumerate(order)]
    builds = spark.createDataFrame([(0, "asc", 1.0), (1, "asc", 1.0), (2, "asc", 5.0)], BUILDS)
    plain = median_ranks(spark.createDataFrame(hits, HITS), builds, "query_id", "node_key", "build_id", "score", "score_order")
    heavy = median_ranks(spark.createDataFrame(hits, HITS), builds, "query_id", "node_key", "build_id", "score", "score_order", "w")
    assert best_items(plain, "query_id", "node_key").first().node_key == "a"
    assert best_items(heavy, "query_id", "node_key").first().node_key == "c"


def test_empty(spark):
    ranks = median_ranks(spark.createDataFrame([], HITS), spark.createDataFrame([], BUILDS), "query_id", "node_key", "build_id", "score", "score_order")
    assert ranks.count() == 0 and best_items(ranks, "query_id", "node_key").count() == 0
