"""An index run of a small repository, twice, and the facts it leaves."""

import pytest
from pyspark.sql import functions as F

from spanloom.extract.ingest import Run
from spanloom.functions.keys import node_id
from spanloom.operators import graph as G
from spanloom.operators import summaries
from spanloom.plans.pipeline import index_repository
from spanloom.plans.render import report_lines, scan_lines
from spanloom.sources.boot import BOOT
from spanloom.store import Store
from test_extract import INDEX

PKG = "scip-typescript npm shop 1.0.0 "
CODE = """import x from 'lib';
function weigh(order) {
  if (order.empty) throw new Missing('order');
  return process.env.LIMIT;
}
function handle(order) {
  const refusalError = verifyBuyer(order);
  if (refusalError) return refusalError;
  weigh(order);
  useState(1);
  return db.query('UPDATE orders SET x = 1');
}
"""
RUN = Run(5, 1, "shop", "shop")


def index_of(spark):
    occ = [
        (PKG + "`a.ts`/", 1, 0, 0, 0, 0, 0, 0, 12), (PKG + "`a.ts`/weigh().", 1, 0, 1, 9, 1, 14, 1, 4), (PKG + "`a.ts`/handle().", 1, 0, 5, 9, 5, 15, 5, 11),
        (PKG + "`a.ts`/weigh().", 0, 0, 8, 2, 8, 7, None, None), ("scip-typescript npm react 18.3.1 `index.d.ts`/useState().", 0, 0, 9, 2, 9, 10, None, None),
    ]
    return spark.createDataFrame([("i", "a.ts", "ts", occ, [(PKG + "`a.ts`/weigh().", "", 0, "", ["function weigh(order)", "Weighs."])])], INDEX)


def boot_of(spark):
    step = lambda position, phase, name, line, origin: (position, phase, name, None, "a.ts", line, 0, None, name is None, origin, None, None)
    dump = spark.createDataFrame([("b/1", "shop", [("POST", "/orders", "", "shop POST /orders", True, None, None, [step(0, "onRequest", "cors", 1, "framework"), step(1, "handler", "handle", 6, "handler")])], [])], BOOT)
    return dump.select("service", F.explode("routes").alias("r")).select("service", "r.method", "r.url", "r.prefix", F.col("r.hasSchema").alias("has_schema"), F.col("r.routeKey").alias("route_key"), "r.chain")


def sources_of(spark, text=CODE):
    return spark.createDataFrame([("a.ts", "typescript", text)], "path string, lang string, content string").withColumn("content_sha256", F.sha2("content", 256))


def ids(spark, *keys):
    return [spark.range(1).select(node_id(F.lit(kind), F.lit(key))).first()[0] for kind, key in keys]


def test_index_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    go = lambda **over: index_repository(store, RUN, **({"sources": sources_of(spark), "index": index_of(spark), "boot": boot_of(spark), "rules": {"verifyBuyer": "auth"}} | over))
    report = go()
    assert report.changes == {"added": 1} and not report.missing and not report.skipped and store.snapshot == 1
    weigh, handle, react, route, service, orders = ids(spark, ("symbol", PKG + "`a.ts`/weigh()."), ("symbol", PKG + "`a.ts`/handle()."), ("external", "npm:react@18.3.1"), ("route", "shop POST /orders"), ("service", "shop"), ("datastore", "postgres://?/orders"))
    edges = {(r.src_node_id, r.dst_node_id, r.type, r.confidence, r.evidence_kind) for r in store.read("edges").collect()}
    assert {(handle, weigh, "CALLS", "certain", "scip"), (handle, react, "CALLS_EXTERNAL", "inferred", "scip"), (service, route, "CONTAINS", "certain", "boot"), (route, handle, "HANDLES", "certain", "boot"), (handle, orders, "WRITES", "inferred", "treesitter")} <= edges
    chain = sorted((r.phase, r.position, r.symbol_node_id, r.name, r.check_kind, r.line) for r in store.read("route_chain").collect())
    assert chain == [("handler", 1, handle, "handle", None, 6), ("handler_inline", 0, None, "verifyBuyer", "auth", 7), ("onRequest", 0, None, "cors", None, 1)]
    assert store.read("routes").first().handler_node_id == handle
    symbol = store.read("symbols").filter(F.col("node_id") == weigh).first()
    assert (symbol.display_name, symbol.signature, symbol.doc, symbol.symbol_kind, symbol.start_line, symbol.end_line) == ("weigh", "function weigh(order)", "Weighs.", "method", 2, 5)
    assert {r.symbol_node_id for r in store.read("function_cfg").collect()} == {weigh, handle}
    assert store.read("edges").filter("cfg_block_index is not null").count() == report.rows["attributed"] > 0 and report.rows["unkeyed"] == 0
    assert store.verify().filter("n_rows > 0 and column_name <> 'run_id' and column_name <> 'last_run_id'").collect() == []

    # Nothing touched: nothing derived, nothing committed.
    again = go()
    assert again.skipped and again.changes == {"unchanged": 1} and store.snapshot == 1 and "nothing derived" in report_lines(again)[1]
    # By force: the same facts, once. A helper that is no rule any more takes its check with it.
    n_edges = store.read("edges").count()
    assert not go(force=True, rules={}).skipped and store.read("edges").count() == n_edges
    assert store.read("route_chain").filter("phase = 'handler_inline'").count() == 0
    # What is missing is named.
    report = go(sources=sources_of(spark, CODE + "// more\n"), index=None, boot=None)
    assert report.changes == {"changed": 1}
    assert report.missing == ["index", "boot dump"] and any("missing: boot dump" in line for line in report_lines(report))
    assert store.read("edges").filter("type = 'CALLS'").count() == 0 and store.read("edges").filter("type = 'HANDLES'").count() == 1


def test_call_tree(spark):
    sym = lambda name, package="app": f"scip npm {package} 1 `f.ts`/{name}()."
    calls = [("a", "b", 3, 4, "certain"), ("a", "b", 9, 0, "inferred"), ("a", "c", 5, 0, "inferred"), ("b", "a", 1, 0, "certain"), ("c", "d", 2, 0, "certain")]
    df = spark.createDataFrame([(sym(x), sym(y), "f.ts", n, c, s) for x, y, n, c, s in calls] + [(sym("a"), sym("far", "lib"), "f.ts", 6, 0, "certain"), (sym("far", "lib"), sym("deep", "lib"), "f.ts", 1, 0, "certain")], "src_symbol string, dst_symbol string, path string, line int, col int, confidence string")
    gaps = spark.createDataFrame([(sym("a"), "cb", "dynamic", "f.ts", 7, 0)], "src_symbol string, target string, reason string, path string, line int, col int")
    roots = lambda *bound: spark.createDataFrame([("p", sym("a"), ["app"], *bound)], "position string, symbol string, packages array<string>, low int, low_col int, high int")
    got = [(r.way, r.symbol.split("/")[-1].rstrip("()."), r.path_confidence, r.external, r.cycle, r.truncated) for r in G.call_tree(df, roots(None, None, None), gaps).orderBy("way").collect()]
    assert got == [([], "a", "certain", False, False, False), ([3], "b", "certain", False, False, False), ([3, 1], "a", "certain", False, True, False), ([5], "c", "inferred", False, False, False), ([5, 2], "d", "inferred", False, False, False), ([6], "far", "certain", True, False, False), ([7], "cb", "unresolved", True, False, False)]
    scoped = {r.line for r in G.call_tree(df, roots(3, 5, 6), gaps).filter("depth = 1").collect()}
    assert scoped == {5, 6}  # column 4 of line 3 lies before the function
    cut = {r.symbol for r in G.call_tree(df, roots(None, None, None), max_depth=1).filter("truncated").collect()}
    assert cut == {sym("b"), sym("c")}


def test_summaries_stay_apart(spark, rows):
    from pathlib import Path

    import spanloom

    root = Path(spanloom.__file__).parent
    modules = {str(p.relative_to(root)): p.read_text() for folder in ("plans", "queries") for p in (root / folder).glob("*.py") if p.name != "tables.py"}
    assert summaries.containment(modules) == {"keys": [], "readers": []}
    assert summaries.containment({"bad": "select * from summaries"})["readers"] == ["bad"]
    nodes = spark.createDataFrame([(1, "symbol", PKG + "`a.ts`/f().", 1), (2, "symbol", PKG + "`b.ts`/g().", 1)], "node_id long, kind string, key string, repo_id long")
    wanted = summaries.inputs(nodes, spark.createDataFrame([], "src_node_id long, dst_node_id long, type string"))
    plan = lambda scope, seed="": [(r.kind, r.node_key.split("/")[-1]) for r in summaries.plan_generation(wanted, scope, seed).collect()]
    assert plan("module", "shop/a.ts") == [("function", "f()."), ("module", "a.ts")]
    assert plan("function", PKG + "`b.ts`/g().") == [("function", "g().")]
    assert [k for k, _ in plan("service", "shop")] == ["function", "function", "module", "module", "service"] == [k for k, _ in plan("all")]
    with pytest.raises(ValueError):
        summaries.plan_generation(wanted, "planet")


def test_scan_lines(spark):
    found = spark.createDataFrame([("a", "throw", None), ("a", "throw", None), ("b", None, "SyntaxError: x")], "path string, kind string, problem string")
    assert scan_lines(found) == ["throw: 2", "! b: SyntaxError: x"]
