"""Registered queries look as deep as the operators they bind, not less."""

import pytest
from test_engine import Facts

from spanloom.queries import graph, product, runtime

LENGTH = 6


@pytest.fixture
def long_chain(spark, tmp_path):
    """A route whose handler writes and throws six calls down, as tables on disk."""
    facts = Facts(spark)
    route = facts.route("svc", "POST", "/p")
    calls = [facts.fn(f"f{i}") for i in range(LENGTH + 1)]
    for a, b in zip(calls, calls[1:]):
        facts.edge(a, b)
    facts.edge(calls[-1], facts.node("datastore", "db.orders"), "WRITES")
    facts.edge(calls[-1], facts.node("external", "Error"), "THROWS", line=9)
    facts.chain(route, 0, calls[0])
    facts.folder, facts.calls, facts.first = str(tmp_path), calls, route
    facts.save = lambda: [t.write.parquet(f"{tmp_path}/{name}.parquet") for name, t in facts.engine().tables.items()]
    return facts


def test_write_six_calls_down_is_an_anomaly(spark, long_chain, rows):
    long_chain.save()
    assert rows(runtime.write_without_check(spark, long_chain.folder), "route_node_id", "n_writes") == [(long_chain.first, 1)]


def test_throw_six_calls_down_is_surfaced(spark, long_chain, rows):
    long_chain.save()
    assert rows(runtime.error_surface(spark, long_chain.folder)) == [(long_chain.first, 0, 1)]
    assert rows(runtime.error_correlation(spark, long_chain.folder), "url", "n_static") == [("/p", 1)]


def test_graph_queries_see_the_whole_chain(spark, long_chain, rows):
    long_chain.edge(long_chain.fn("second"), long_chain.calls[-1])
    long_chain.save()
    d, calls = long_chain.folder, long_chain.calls
    assert rows(graph.reachable_per_route(spark, d)) == [(long_chain.first, LENGTH + 1, sum(calls))]
    # The last function has two callers, so it is the hub.
    assert (calls[0], LENGTH) in rows(graph.reverse_closure(spark, d), "node_id", "depth")
    assert max(r.depth for r in graph.shortest_confidence(spark, d).collect()) == LENGTH
    assert max(r.depth for r in graph.walk_forward(spark, d).collect()) == LENGTH + 1


def test_product_queries_follow_far_links_and_routes(spark, long_chain, rows):
    last, hops = long_chain.calls[-1], []
    for i in range(6):
        hops.append(long_chain.route("far", "GET", f"/{i}"))
        long_chain.edge(last, hops[-1], "REQUESTS")
        last = long_chain.fn(f"far{i}")
        long_chain.chain(hops[-1], 0, last)
    long_chain.edge(long_chain.fn("second"), long_chain.calls[-1])
    long_chain.edge(long_chain.fn("third"), long_chain.calls[-1])
    long_chain.rows["function_cfg"].append((long_chain.calls[-1], 0, None, "root", None, None, None, None, 90, 99, 1, 1))
    long_chain.chain(hops[0], 1, None, phase="handler_inline", line=91, end=92)
    long_chain.save()
    d = long_chain.folder
    assert (long_chain.first, 1, hops[0]) in rows(product.route_links(spark, d))
    assert rows(product.remote_routes(spark, d), "node_id", "depth") == [(h, i + 1) for i, h in enumerate(hops)]
    # A change six calls below the first route's handler.
    assert long_chain.first in [r.node_id for r in product.impact_routes(spark, d).collect()]
    assert long_chain.first in [r.node_id for r in product.pr_routes(spark, d).collect()]


def test_namespaces_are_reached_but_not_left(spark, rows):
    from spanloom.operators import graph as G

    edges = spark.createDataFrame([(1, 2, "CALLS", "certain"), (2, 3, "CALLS", "inferred"), (3, 1, "CALLS", "certain")], "src_node_id long, dst_node_id long, type string, confidence string")
    seeds, space = spark.createDataFrame([(3,)], "seed long"), spark.createDataFrame([(2,), (3,)], "node_id long")
    assert rows(G.closure(edges, seeds, ["CALLS"], stop=space)) == [(3, 2, 1, "inferred")]
    assert rows(G.closure(edges, seeds, ["CALLS"]), "node_id", "depth", "path_confidence") == [(1, 2, "inferred"), (2, 1, "inferred"), (3, 3, "inferred")]
    assert rows(G.closure(edges, seeds, ["CALLS"], max_depth=None), "node_id") == [(1,), (2,), (3,)]
    assert rows(G.closure(edges.limit(0), seeds, ["CALLS"])) == []


def test_dealt_hubs_change_nothing(spark, rows, monkeypatch):
    from spanloom.operators import graph as G

    links = [(1, n, "CALLS", "certain") for n in range(2, 40)] + [(n, 50 + n % 3, "CALLS", "observed") for n in range(2, 40)] + [(50, 1, "CALLS", "certain")]
    edges = spark.createDataFrame(links, "src_node_id long, dst_node_id long, type string, confidence string")
    seeds = spark.createDataFrame([(1,), (50,)], "seed long")
    plain = rows(G.closure(edges, seeds, ["CALLS"], reverse=False))
    monkeypatch.setattr(G, "HUB_LINKS", 4)
    assert rows(G.closure(edges, seeds, ["CALLS"], reverse=False)) == plain and len(plain) == 42 * 2
