"""Sums over reached nodes: the same as over the pairs, without the pairs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_engine import Facts

from spanloom.operators import bit_reach
from spanloom.operators import graph as G
from spanloom.queries import product
from spanloom.session import _STAGED

BIG = 1 << 54


@pytest.fixture(scope="module")
def tangle(spark):
    """Links with loops and a hub, seeds of several starts, targets that are starts or lead on; far ids."""
    draw = random.Random(5)
    links = {(draw.randrange(60), draw.randrange(90)) for _ in range(110)} | {(k, 7) for k in range(60)} | {(200 + k, 201 + k) for k in range(9)}
    edges = spark.createDataFrame([(a - BIG * (a % 2), b - BIG * (b % 2), "CALLS") for a, b in sorted(links)] + [(1, None, "CALLS"), (2, 3, "HANDLES")], "src_node_id long, dst_node_id long, type string")
    starts = [(s, draw.choice([s, draw.randrange(120)])) for s in range(0, 150) for _ in range(3)] + [(500, 200), (501, 205), (502, 119)]
    seeds = spark.createDataFrame([(s - BIG * (s % 2), n - BIG * (n % 2)) for s, n in starts] + [(None, 4), (9, None)], "seed long, node_id long")
    targets, expand = (spark.createDataFrame([(n - BIG * (n % 2),) for n in nodes], "node_id long") for nodes in ([*range(1, 130, 2), *range(60, 90), 60, 203, 209], [n for n in range(300) if n % 13]))
    return edges, seeds, targets, expand


@pytest.mark.parametrize("depth, words, rounds, chunk, memory", [(0, 8, 32, 1 << 15, 1000), (1, 8, 32, 1 << 15, 1000), (3, 1, 2, 5, 1000), (12, 1, 2, 5, 1000), (None, 8, 32, 1 << 15, 1000), (3, 1, 2, 5, 10)])
def test_sums_are_those_of_the_pairs(spark, rows, tangle, monkeypatch, depth, words, rounds, chunk, memory):
    for name, value in {"BLOCK_WORDS": words, "ROUNDS": rounds, "CHUNK": chunk, "MEMORY_LINKS": memory}.items():
        monkeypatch.setattr(bit_reach, name, value)
    edges, seeds, targets, expand = tangle
    pairs = G.reach(edges, seeds.dropna(), ["CALLS"], depth, expand).join(targets, "node_id", "left_semi").filter("node_id <> seed")
    assert (want := rows(pairs.groupBy("seed").agg(F.count("*"), F.sum("node_id")))) or depth == 0
    assert rows(bit_reach.reach_sums(edges, seeds, ["CALLS"], targets, depth, expand)) == want


def test_blocks_hold_whole_seeds():
    import numpy as np
    import pyarrow as pa

    seeds = np.repeat(np.arange(40), [1, 7, 2, 30] * 10)
    batches = [pa.RecordBatch.from_pydict({"seed": seeds[k : k + 9], "node_id": seeds[k : k + 9], "_end": seeds[k : k + 9] > 0}) for k in range(0, len(seeds), 9)]
    blocks = [b[0] for b in bit_reach._blocks(iter(batches), 3)]
    assert np.array_equal(np.concatenate(blocks), seeds)
    assert [sorted(set(b.tolist())) for b in blocks] == [list(range(k, min(k + 3, 40))) for k in range(0, 40, 3)]


def test_no_links_no_rows(spark, rows, tangle):
    edges, seeds, targets, _ = tangle
    assert rows(bit_reach.reach_sums(edges.limit(0), seeds.limit(0), ["CALLS"], targets)) == []
    # A start is found without a link.
    assert rows(bit_reach.reach_sums(edges.limit(0), spark.createDataFrame([(1, 60), (60, 60)], "seed long, node_id long"), ["CALLS"], targets)) == [(1, 1, 60)]


def test_route_links_stages_no_pairs(spark, rows, tmp_path):
    """Each of 120 routes leads to all: the disk holds the links, not 14,400 pairs."""
    facts = Facts(spark)
    hub = facts.fn("hub")
    routes = [facts.route("svc", "GET", f"/{i}") for i in range(120)]
    for k, route in enumerate(routes):
        facts.chain(route, 0, entry := facts.fn(f"f{k}"))
        facts.edge(entry, hub)
        facts.edge(hub, route, "REQUESTS")
    for name, t in facts.engine().tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    before = len(_STAGED)
    found = rows(product.route_links(spark, str(tmp_path)))
    assert found == sorted(((r, 119, sum(routes) - r) for r in routes), key=repr)
    staged = [p for p in _STAGED[before:] if Path(p.removeprefix("file:")).exists()]
    assert staged and sum(spark.read.parquet(p).count() for p in staged) <= 240
