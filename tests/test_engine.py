import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.operators.graph import closure, walk
from spanloom.plans import render
from spanloom.plans.engine import Ambiguous, Engine, NotFound
from spanloom.schema import TABLES

SVC = "scip npm svc 1 `server.js`/"


class Facts:
    """A small graph, row by row."""

    def __init__(self, spark):
        self.spark, self.rows = spark, {t: [] for t in ("nodes", "edges", "routes", "route_chain", "function_cfg", "unresolved_calls", "spans")}
        self.ids = {}

    def node(self, kind, key):
        if (kind, key) not in self.ids:
            self.ids[kind, key] = len(self.ids) + 1
            self.rows["nodes"].append((self.ids[kind, key], kind, key, 1))
        return self.ids[kind, key]

    def fn(self, name):
        return self.node("symbol", f"{SVC}{name}().")

    def edge(self, a, b, type="CALLS", confidence="certain", line=1, evidence="scip"):
        self.rows["edges"].append((len(self.rows["edges"]) + 1, a, b, type, confidence, evidence, 1, line, None, 1, None, None))

    def route(self, service, method, url):
        n = self.node("route", f"{service} {method} {url}")
        self.rows["routes"].append((n, 1, service, method, url, "", None, None, None, False, "boot", 1))
        return n

    def chain(self, route, position, symbol, phase="handler", name="h", line=None, end=None, evidence="boot", confidence="certain", origin="handler"):
        self.rows["route_chain"].append((route, position, phase, symbol, None, name, None, origin, None, confidence, evidence, 1, line, end, None, 1))

    def engine(self):
        tables = {}
        for name, rows in self.rows.items():
            schema = to_arrow_schema(TABLES[name].schema)
            columns = zip(*rows) if rows else [[]] * len(schema)
            tables[name] = self.spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema))
        return Engine(tables)


@pytest.fixture
def facts(spark):
    return Facts(spark)


def steps(answer):
    return sorted((r.depth, r.key.split("/")[-1], r.cycle, r.truncated) for r in answer["steps"].collect())


def test_flow_cycle(facts):
    a, b = facts.fn("a"), facts.fn("b")
    facts.edge(a, b)
    facts.edge(b, a, line=2)
    facts.chain(facts.route("svc", "POST", "/p"), 0, a)
    answer = facts.engine().endpoint_flow("svc", "post", "/p")
    assert steps(answer) == [(0, "a().", False, False), (1, "b().", False, False), (2, "a().", True, False)]
    assert "(cycle)" in "\n".join(render.flow_lines(answer))


def test_flow_depth_cap_and_call_sites(facts):
    a, b, c, d = (facts.fn(x) for x in "abcd")
    for x, y in ((a, b), (b, c), (c, d)):
        facts.edge(x, y)
    facts.edge(a, b, line=9, confidence="inferred")
    facts.chain(facts.route("svc", "POST", "/p"), 0, a)
    answer = facts.engine().endpoint_flow("svc", "POST", "/p", max_depth=2)
    assert steps(answer) == [(0, "a().", False, False), (1, "b().", False, False), (1, "b().", False, False), (2, "c().", False, True), (2, "c().", False, True)]
    assert sorted(r.path_confidence for r in answer["steps"].filter("depth = 2").collect()) == ["certain", "inferred"]


def test_flow_line_scope(facts):
    module, a, b = facts.node("symbol", SVC), facts.fn("a"), facts.fn("b")
    facts.edge(module, a, line=5)
    facts.edge(module, b, line=50)
    facts.chain(facts.route("svc", "POST", "/p"), 0, module, "onRequest", None, 1, 10, origin="scope")
    assert [s[1] for s in steps(facts.engine().endpoint_flow("svc", "POST", "/p"))] == ["", "a()."]


def test_flow_follows_remote_routes_once(facts):
    one, two = facts.route("r", "POST", "/p"), facts.route("e", "POST", "/q")
    a, b = facts.fn("proxy"), facts.fn("answer")
    facts.edge(a, two, "REQUESTS", "inferred")
    facts.edge(b, one, "REQUESTS", "inferred")
    facts.chain(one, 0, a)
    facts.chain(two, 0, b)
    answer = facts.engine().endpoint_flow("r", "POST", "/p")
    assert answer.facts["visited"] == [one, two] and answer["chain"].count() == 2
    nodes, links = facts.engine().route_graph(answer)
    assert nodes.count() == 4 and links.count() == 2
    assert render.flow_mermaid(answer, nodes, links).count("-.->") == 2
    assert facts.engine().endpoint_flow("r", "POST", "/p", follow_remote=False).facts["visited"] == [one]


def test_unknown_route_lists_the_service(facts):
    facts.route("svc", "GET", "/a")
    with pytest.raises(NotFound) as e:
        facts.engine().endpoint_flow("svc", "GET", "/b")
    assert e.value.candidates == ["GET /a"]


def test_impact_does_not_cross_modules(facts):
    module, seed, handler = facts.node("symbol", SVC), facts.fn("seed"), facts.fn("handler")
    guarded, health = facts.route("svc", "POST", "/guarded"), facts.route("svc", "GET", "/health")
    facts.edge(module, seed)
    facts.edge(handler, seed)
    for route, symbol in ((guarded, handler), (guarded, module), (health, module)):
        facts.edge(route, symbol, "HANDLES", line=None)
    answer = facts.engine().impact("seed")
    assert [r.url for r in answer["routes"].collect()] == ["/guarded"]
    assert module in {r.node_id for r in answer["closure"].filter("depth = 1").collect()}


def test_impact_ranks_the_surest_evidence(facts):
    seed, handler = facts.fn("seed"), facts.fn("handler")
    po, mail = facts.route("svc", "POST", "/po"), facts.route("svc", "POST", "/mail")
    facts.edge(handler, seed)
    facts.edge(po, handler, "HANDLES")
    facts.chain(po, 0, seed, "handler_inline", confidence="inferred", evidence="treesitter")
    facts.chain(mail, 0, seed, "handler_inline", confidence="inferred", evidence="treesitter")
    assert {(r.url, r.bucket) for r in facts.engine().impact("seed")["routes"].collect()} == {("/po", "certain"), ("/mail", "inferred")}


def test_impact_utility_and_trim(facts):
    seed = facts.fn("seed")
    for i in range(12):
        facts.edge(facts.fn(f"c{i}"), seed)
    for i in range(40):
        r = facts.route("svc", "GET" if i % 2 else "POST", f"/r{i:02d}")
        facts.edge(r, seed, "HANDLES", "certain" if i % 4 else "inferred")
    answer = facts.engine().impact("seed", route_limit=10)
    assert answer.facts["fan_in"] == 12 and answer.facts["is_utility"]
    shown = answer["routes"].collect()
    assert {r.total for r in shown} == {40} and 0 < len(shown) <= 12
    assert "40 routes in all" in "\n".join(render.impact_lines(answer))


def test_seeds(facts):
    facts.fn("twice")
    facts.node("symbol", "scip npm other 1 `x.js`/twice().")
    facts.node("file", "repo/src/a.js")
    engine = facts.engine()
    assert engine.seed("src/a.js")[1] == "file" and engine.seed(f"{SVC}twice().")[1] == "key"
    with pytest.raises(Ambiguous):
        engine.seed("twice")
    with pytest.raises(NotFound):
        engine.seed("nothing")


def test_context_pack_skips_what_does_not_fit(facts):
    seed = facts.fn("seed")
    for i in range(30):
        facts.edge(seed, facts.fn(f"a_rather_long_callee_{i}"))
    facts.edge(seed, facts.node("config", "env:PORT"), "READS_CONFIG")
    facts.rows["unresolved_calls"].append((seed, "call", "x", "dynamic", 1, 1, 1, 1))
    answer = facts.engine().context_pack("seed", 40)
    packed = {r.tier: r for r in answer["packed"].collect()}
    assert not packed["callees"].included and packed["config"].included and packed["callers"].included and packed["callers"].n_items == 0
    assert "gaps[1]{kind,target,reason}:" in render.pack_toon(answer)


def test_pr_impact(facts, spark):
    handler, seed = facts.fn("handler"), facts.fn("req")
    route = facts.route("svc", "POST", "/p")
    facts.edge(route, handler, "HANDLES")
    symbols = spark.createDataFrame([(handler, "server.js", "method", 100, 200), (seed, "server.js", "parameter", 100, 100), (9, "server.js", "namespace", 1, 400)], "node_id long, path string, symbol_kind string, start_line int, end_line int")
    hunks = spark.createDataFrame([("server.js", 120, 121), ("server.js", 100, 100), ("server.js", 300, 301), ("gone.js", 1, 2)], "file string, first int, last int")
    answer = facts.engine().pr_impact(hunks, symbols)
    assert {r.node_id for r in answer["seeds"].collect()} == {handler}
    assert [r.url for r in answer["routes"].collect()] == ["/p"]
    assert {(r["file"], r["first"]) for r in answer["unmapped"].collect()} == {("server.js", 300), ("gone.js", 1)}
    assert [r.file for r in answer["unindexed"].collect()] == ["gone.js"]
    comment = render.impact_comment(answer)
    assert comment.startswith(render.COMMENT_MARK) and "`svc POST /p`" in comment and "gone.js" in comment


def test_error_paths_are_independent(facts):
    handler = facts.fn("handler")
    facts.chain(facts.route("svc", "POST", "/p"), 0, handler)
    facts.rows["function_cfg"] += [(handler, 0, None, "root", None, None, None, None, 1, 20, 1, 1), (handler, 1, 0, "guard", "!x", None, None, None, 3, 4, 1, 1), (handler, 2, 1, "exit", None, "error_exit", "return_error", "E-1", 3, 3, 1, 1), (handler, 3, 0, "exit", None, "unknown", "return_value", None, 9, 9, 1, 1)]
    facts.edge(handler, facts.node("external", "error:E"), "THROWS", line=3)
    facts.edge(handler, facts.node("external", "error:F"), "THROWS", line=7)

    def span(i, parent, status, start):
        base = dict.fromkeys(f.name for f in TABLES["spans"].schema)
        base |= {"trace_id": "t", "span_id": i, "parent_span_id": parent, "service_name": "svc", "http_route": "/p", "status": status, "start_unix_us": start}
        facts.rows["spans"].append(tuple(base.values()))

    span("root", None, "error", 1), span("mid", "root", "error", 2), span("leaf", "mid", "error", 3)
    answer = facts.engine().error_paths("svc", "POST", "/p")
    assert [(r.error_name, r.guard) for r in answer["surface"].collect()] == [("E-1", "!x")]
    assert [r.line for r in answer["throws"].collect()] == [7] and answer["opaque_exits"].count() == 1
    assert [(r.origin_span, r.depth, r.chain) for r in answer["observed"].collect()] == [("leaf", 2, "leaf>mid>root")]


def test_follow_a_hit(facts):
    route, handler = facts.route("svc", "GET", "/a"), facts.fn("h")
    facts.chain(route, 0, handler)
    e = facts.engine()
    assert e.follow("svc GET /a").facts["visited"] == [route]
    assert e.follow(f"{SVC}h().").facts["node_id"] == handler
    with pytest.raises(NotFound):
        e.follow("nothing")


def test_errors_of_spans_without_a_route(facts, spark):
    facts.chain(facts.route("svc", "GET", "/po/:id"), 0, facts.fn("h"))

    def span(t, path, route=None, service="svc"):
        facts.rows["spans"].append((t, "s", None, "x", "server", service, 1, 2, 1, "error", None, route, "GET", 500, None, None, None, None, None, None, None, path, None, None, None, None, None))

    span("t1", "/po/7")
    span("t2", "/po/7/lines")
    span("t3", None, "/po/:id")
    span("t4", "/po/8", "/other")
    span("t5", "/po/9", service="else")
    assert sorted(r.trace_id for r in facts.engine().error_paths("svc", "GET", "/po/:id")["observed"].collect()) == ["t1", "t3"]
    from spanloom.operators.routing import errored_traces_of_routes

    e = facts.engine()
    # Asked by route over all spans, a concrete path counts whatever the span says of its route.
    assert sorted(r.trace_id for r in errored_traces_of_routes(e.table("spans"), e.table("routes"), 10).collect()) == ["t1", "t3", "t4"]
    assert errored_traces_of_routes(e.table("spans").limit(0), e.table("routes"), 10).count() == 0


def test_picture(facts):
    import json

    from spanloom.plans.payload import graph_payload, payload_json

    route, handler, low, store = facts.route("svc", "GET", "/a"), facts.fn("h"), facts.fn("low"), facts.node("datastore", "postgres://?/t")
    facts.chain(route, 0, handler)
    facts.edge(handler, low)
    facts.edge(handler, low, line=4, confidence="inferred")
    facts.edge(low, store, "WRITES", "inferred")
    facts.rows["function_cfg"] += [(low, 0, None, "root", None, None, None, None, 1, 9, 1, 1), (low, 1, 0, "exit", None, "error_exit", "throw", "Bad", 3, 3, 1, 1)]
    facts.rows["unresolved_calls"].append((low, "call", "cb", "dynamic", 1, 5, 2, 1))
    e = facts.engine()
    made = json.loads(payload_json(graph_payload(e.endpoint_flow("svc", "GET", "/a"), *(e.table(t) for t in ("nodes", "symbols", "files", "function_cfg"))), {"service": "svc"}))
    assert {n["label"]: n["outcome"] for n in made["nodes"]} == {"h": None, "low": "error_exit", "postgres://?/t": None}
    assert {(x["source"], x["target"], x["type"], x["path_confidence"]) for x in made["edges"]} == {(handler, low, "CALLS", "certain"), (low, store, "WRITES", "inferred")}
    assert made["services"] == ["svc"] and [b["error_name"] for b in made["cfg"][str(low)]] == [None, "Bad"] and made["unknowns"][0]["reason"] == "dynamic" and "line" in made["legend"]
    assert next(n for n in made["nodes"] if n["label"] == "h")["chain"]["channel"] == "boot"


def test_error_renderer(facts):
    facts.chain(facts.route("svc", "GET", "/a"), 0, facts.fn("h"))
    assert render.error_lines(facts.engine().error_paths("svc", "GET", "/a")) == ["observed: no errored trace", "can fail: no error exit known"]


def test_walk_and_closure_agree(facts, spark):
    import random

    rng = random.Random(2)
    names = [facts.fn(f"f{i}") for i in range(14)]
    for i in range(22):
        facts.edge(rng.choice(names), rng.choice(names), line=i, confidence=rng.choice(["certain", "inferred"]))
    e = facts.engine()
    seeds = spark.createDataFrame([("s", names[0], None, None)], "position string, node_id long, low int, high int")
    walked = {r.node_id: r.d for r in walk(e.table("edges"), e.table("nodes"), seeds, 6, ["CALLS"]).filter("depth > 0").groupBy("node_id").agg({"depth": "min"}).withColumnRenamed("min(depth)", "d").collect()}
    closed = {r.node_id: r.depth for r in closure(e.table("edges"), spark.createDataFrame([(names[0],)], "seed long"), ["CALLS"], False, 6).collect()}
    assert walked == closed


def test_promotion_in_one_answer(facts, spark):
    from spanloom.operators.routing import promote

    caller, callee, fn = facts.route("web", "GET", "/c"), facts.route("api", "GET", "/o/:id"), facts.fn("weigh")
    facts.node("datastore", "postgres://?/t")
    store = facts.node("datastore", "redis://?/k")
    facts.edge(caller, callee, "REQUESTS", "inferred")
    facts.edge(fn, store, "READS")
    facts.edge(fn, facts.fn("idle"))

    def span(i, parent, kind, service, start=10**15, **over):
        row = dict(zip(TABLES["spans"].schema.names, (f"t{i[0]}", i, parent, "x", kind, service, start, start, 0, "ok")))
        facts.rows["spans"].append(tuple({**dict.fromkeys(TABLES["spans"].schema.names), **row, **over}.values()))

    span("a1", None, "server", "web", http_route="/c", http_method="GET")
    span("a2", "a1", "client", "web", http_route="/o/:id", server_address="localhost", server_port=80)
    span("a3", "a2", "server", "api", url_path="/o/7", http_method="GET")
    span("a4", "a3", "internal", "api", code_function="weigh", code_filepath="server.js")
    span("a5", "a3", "internal", "api", code_function="weigh", code_filepath="other.js")
    span("a6", "a3", "client", "api", db_system="Postgres", db_name="d")
    span("a7", "a3", "client", "api", db_system="mysql")
    span("a8", "a3", "server", "api", url_path="/none")
    span("b1", "a9", "client", "web", http_route="/o/:id", server_address="unknown.example")
    e = facts.engine()
    hosts, ports = spark.createDataFrame([("web", "web"), ("api", "api")], "host string, service string"), spark.createDataFrame([(80, "api")], "port int, service string")
    after, report = promote(e.table("spans"), e.table("routes"), e.table("nodes"), e.table("edges"), hosts, ports)
    row = report.first().asDict()
    assert row == {"matched_routes": 1, "routes_by_template": 1, "promoted": 1, "added": 0, "matched_symbols": 1, "matched_datastores": 1, "unmatched": 4, "possibly_dead": 0}
    got = {(r.src_node_id, r.dst_node_id): (r.confidence, r.last_observed_at is not None) for r in after.collect()}
    assert got == {(caller, callee): ("observed", True), (fn, store): ("certain", True), (fn, facts.fn("idle")): ("certain", True)}
    assert promote(e.table("spans").limit(0), e.table("routes"), e.table("nodes"), e.table("edges"), hosts, ports)[1].first()["possibly_dead"] == 3


def test_context_pack_with_source(facts, spark):
    hub, near, far = facts.fn("hub"), facts.fn("near"), facts.fn("far")
    facts.edge(near, hub)
    facts.edge(far, near)
    e = facts.engine()
    row = lambda n, file, a, b: (n, file, None, "method", None, None, a, b, None, None, None)
    e.tables["symbols"] = spark.createDataFrame([row(hub, 1, 2, 3), row(near, 2, 1, 1), row(far, 3, 1, 1)], TABLES["symbols"].schema)
    e.tables["files"] = spark.createDataFrame([(i, 1, f"{i}.js", "js", "x", 1) for i in (1, 2, 3)], TABLES["files"].schema)
    sources = spark.createDataFrame([("1.js", "line one\nfunction hub() {\n}\nend"), ("2.js", "n" * 400), ("3.js", "f" * 4000)], "path string, content string")
    answer = e.context_pack("hub", sources=sources)
    assert answer["source"].first().text == "function hub() {\n}" and answer.facts["reserved"] == 5
    delta = answer["delta"].first()
    assert delta.dump_tokens == 8 + 100 and delta.packed_tokens >= 5 and delta.ratio < 1
    assert e.context_pack("hub", budget=5, sources=sources)["packed"].filter("included and cost > 0").count() == 0
