"""The product's composite questions over whole tables: flows across routes, impact, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.operators import graph as G
from spanloom.operators.bit_reach import reach_sums
from spanloom.plans import payload
from spanloom.plans.engine import Engine
from spanloom.queries.common import EDGES_SQL, NAME_SQL, RANK_SQL, SPACES_SQL, read
from spanloom.queries.graph import _CLOSURE, _hub, _ranges, _spaces, walk_sql

#: Rounds of the SQL below; a route that far away is a row too much, and the comparison fails.
ROUNDS = 40
#: Links a picture goes from its route.
PICTURE_DEPTH = 4
_TABLES = ("nodes", "edges", "routes", "route_chain", "function_cfg")


def _engine(spark: SparkSession, d: str) -> Engine:
    return Engine({t: read(spark, d, t) for t in _TABLES})


def _route_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges that a flow can follow, chain, symbols, routes); other kinds are never left and never asked for."""
    nodes = read(spark, d, "nodes")
    symbols, routes = (nodes.filter(F.col("kind") == kind).select("node_id") for kind in ("symbol", "route"))
    edges = read(spark, d, "edges").join(symbols.unionByName(routes).withColumnRenamed("node_id", "dst_node_id"), "dst_node_id", "left_semi")
    chain = read(spark, d, "route_chain").filter("symbol_node_id is not null").select("route_node_id", "symbol_node_id").distinct()
    return edges, chain, symbols, routes


def route_links(spark: SparkSession, d: str) -> DataFrame:
    """How many other routes the chain of each route leads to within MAX_DEPTH links."""
    edges, chain, symbols, routes = _route_graph(spark, d)
    return reach_sums(edges, chain.toDF("seed", "node_id"), G.FLOW_TYPES, routes, expand=symbols).toDF("route_node_id", "n_remote", "id_sum")


def remote_routes(spark, d):
    """Routes the first route leads to, over any number of services, each entered once."""
    edges, chain, symbols, routes = _route_graph(spark, d)
    first = chain.agg(F.min("route_node_id").alias("seed"))
    return G.remote(edges, chain, symbols, routes, first)


def impact_routes(spark, d):
    """Routes a change of the hub can break, by the surest evidence."""
    engine = _engine(spark, d)
    hub = _hub(spark, d)
    closure = G.closure(G.edges_once(engine.table("edges"), "confidence"), hub, G.IMPACT_TYPES, stop=_spaces(spark, d))
    own = hub.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth"), F.lit("certain").alias("path_confidence"))
    return engine.impacted_routes(closure.unionByName(own)).select("node_id", "service_name", "method", "url", "bucket")


def pr_routes(spark, d):
    """Routes at risk when every line span of a route's inline handler entries changes."""
    engine = _engine(spark, d)
    hunks = read(spark, d, "route_chain").filter("phase = 'handler_inline' and file_id is not null and line is not null").select(F.col("file_id").cast("string").alias("file"), F.col("line").alias("first"), F.coalesce("end_line", "line").alias("last")).distinct()
    symbols = _ranges(spark, d).select(F.col("file_id").cast("string").alias("path"), F.col("symbol_node_id").alias("node_id"), F.lit("method").alias("symbol_kind"), "start_line", "end_line")
    return engine.pr_impact(hunks, symbols)["routes"].select("node_id", "service_name", "method", "url", "bucket", "n_seeds")


def artifact_flow(spark, d):
    """Call trees of every step of every route, from derived calls alone, ended at other packages."""
    symbols = read(spark, d, "nodes").filter("kind = 'symbol'").select("node_id", "key")
    calls = read(spark, d, "edges").filter("type = 'CALLS' and evidence_kind = 'scip'").join(symbols.toDF("src_node_id", "src_symbol"), "src_node_id").join(symbols.toDF("dst_node_id", "dst_symbol"), "dst_node_id")
    calls = calls.select("src_symbol", "dst_symbol", F.col("file_id").cast("string").alias("path"), "line", F.lit(0).alias("col"), "confidence")
    chain = read(spark, d, "route_chain").join(symbols.toDF("symbol_node_id", "symbol"), "symbol_node_id")
    none = F.lit(None).cast("int")
    roots = chain.select(F.concat_ws(":", "route_node_id", "position", "phase").alias("position"), "symbol", F.array(S.package_of(F.col("symbol"))).alias("packages"), none.alias("low"), none.alias("low_col"), none.alias("high")).distinct()
    tree = G.call_tree(calls, roots)
    return tree.select("position", F.array_join("symbols", ">").alias("way"), "depth", "line", "path_confidence", "external", "cycle", "truncated")


def graph_payload(spark, d):
    """The picture of the first route: nodes by kind, lane and end, and links by type and sign."""
    engine = _engine(spark, d)
    first = read(spark, d, "route_chain").filter("symbol_node_id is not null").agg(F.min("route_node_id").alias("node_id"))
    route = engine.table("routes").join(first, "node_id", "left_semi").first()
    flow = engine.endpoint_flow(route["service_name"], route["method"], route["url"], PICTURE_DEPTH, False)
    tables = payload.graph_payload(flow, engine.table("nodes"), engine.table("symbols"), engine.table("files"), engine.table("function_cfg"))
    shown = tables["nodes"].groupBy(F.lit("node").alias("what"), "kind", F.coalesce("outcome", F.lit("-")).alias("sign")).agg(F.count("*").alias("n"), F.sum("node_id").alias("id_sum"))
    return shown.unionByName(tables["links"].groupBy(F.lit("link").alias("what"), F.col("type").alias("kind"), F.col("path_confidence").alias("sign")).agg(F.count("*").alias("n"), F.sum("target").alias("id_sum")))


QUERIES = {f.__name__: f for f in (route_links, remote_routes, impact_routes, pr_routes, artifact_flow, graph_payload)}

_FLOW = ", ".join(repr(t) for t in G.FLOW_TYPES)
_IMPACT = ", ".join(repr(t) for t in G.IMPACT_TYPES)
_LINKS = f"""l as (select distinct src_node_id as a, dst_node_id as b from edges where type in ({_FLOW}) and src_node_id in (select node_id from nodes where kind = 'symbol')),
  r as (select distinct route_node_id as seed, symbol_node_id as node_id, 0 as depth from route_chain where symbol_node_id is not null
        union select r.seed, l.b, r.depth + 1 from r join l on l.a = r.node_id where r.depth < {G.MAX_DEPTH}),
  links as (select distinct seed as route_node_id, node_id as remote_node_id from r where node_id <> seed and node_id in (select node_id from nodes where kind = 'route'))"""


def _routes_of(closure: str) -> str:
    """Routes that (seed, node_id, r) rows touch by edge or chain, with their best rank."""
    return f"""hit as (select seed, node_id, r from {closure} where node_id in (select node_id from routes)
    union all select c.seed, ch.route_node_id, least(c.r, {RANK_SQL.replace('confidence', 'ch.confidence')}) from {closure} c join route_chain ch on ch.symbol_node_id = c.node_id),
  best as (select seed, node_id, max(r) as r from hit group by 1, 2)"""


_BUCKET = "case r when 3 then 'certain' when 0 then 'unknown' else 'inferred' end"

ORACLE = {
    "route_links": f"with recursive {_LINKS} select route_node_id, count(*) as n_remote, cast(sum(remote_node_id) as bigint) as id_sum from links group by 1",
    "remote_routes": f"""with recursive {_LINKS}, w as (select min(route_node_id) as seed, min(route_node_id) as node_id, 0 as depth from route_chain where symbol_node_id is not null
        union select w.seed, k.remote_node_id, w.depth + 1 from w join links k on k.route_node_id = w.node_id where w.depth < {ROUNDS})
      select seed, node_id, min(depth) as depth from w where depth > 0 and node_id <> seed group by 1, 2""",
    "impact_routes": f"""{_CLOSURE}, own as (select seed, node_id, r from out union all select seed, seed, 3 from hub), {_routes_of('own')}
      select node_id, service_name, method, url, {_BUCKET} as bucket from best join routes using (node_id)""",
    "pr_routes": f"""with recursive e as {EDGES_SQL},
      h as (select distinct file_id, line as first, coalesce(end_line, line) as last from route_chain where phase = 'handler_inline' and file_id is not null and line is not null),
      rg as (select file_id, symbol_node_id, start_line, end_line from function_cfg where kind = 'root' and start_line <= end_line and file_id is not null),
      hs as (select rg.symbol_node_id as seed from h join rg on rg.file_id = h.file_id and rg.start_line <= h.last and rg.end_line >= h.first and h.first <= h.last
             qualify row_number() over (partition by h.file_id, h.first, h.last order by rg.end_line - rg.start_line, rg.symbol_node_id) = 1),
      sd as (select distinct seed from hs),
      l as (select dst_node_id as a, src_node_id as b, max({RANK_SQL}) as r, dst_node_id in {SPACES_SQL} as halt from e where type in ({_IMPACT}) and src_node_id is not null and dst_node_id is not null group by 1, 2),
      c as (select seed, seed as node_id, 0 as depth, 3 as r from sd union select c.seed, l.b, c.depth + 1, least(c.r, l.r) from c join l on l.a = c.node_id where c.depth < {G.MAX_DEPTH} and (c.depth = 0 or not l.halt)),
      m as (select seed, node_id, min(depth) as depth from c where depth > 0 group by 1, 2),
      cl as (select m.seed, m.node_id, max(c.r) as r from m join c using (seed, node_id, depth) group by 1, 2 union all select seed, seed, 3 from sd), {_routes_of('cl')}
      select node_id, service_name, method, url, case max(case when r = 3 then 2 when r > 0 then 1 else 0 end) when 2 then 'certain' when 1 then 'inferred' else 'unknown' end as bucket, count(distinct seed) as n_seeds
      from best join routes using (node_id) group by 1, 2, 3, 4""",
    "artifact_flow": f"""with recursive sy as (select node_id, key, string_split(key, ' ')[3] as pkg from nodes where kind = 'symbol'),
      cc as (select a.key as s, b.key as d, e.line, {RANK_SQL} as r from edges e join sy a on a.node_id = src_node_id join sy b on b.node_id = dst_node_id where type = 'CALLS' and evidence_kind = 'scip' qualify row_number() over (partition by a.key, b.key order by e.line, e.file_id::varchar, e.confidence) = 1),
      w as (select distinct concat_ws(':', route_node_id, position, phase) as position, [sy.key] as path, sy.key as symbol, 0 as depth, cast(null as int) as line, 3 as r, sy.pkg as own, false as external, false as cycle from route_chain join sy on sy.node_id = symbol_node_id
        union all select w.position, list_append(w.path, cc.d), cc.d, w.depth + 1, cc.line, least(w.r, cc.r), w.own, string_split(cc.d, ' ')[3] <> w.own, list_contains(w.path, cc.d)
        from w join cc on cc.s = w.symbol where not w.external and not w.cycle and w.depth < {G.MAX_DEPTH})
      select position, array_to_string(path, '>') as way, depth, line, {NAME_SQL.format('r')} as path_confidence, external, cycle, depth = {G.MAX_DEPTH} and not external and not cycle and symbol in (select s from cc) as truncated from w""",
    "graph_payload": f"""{walk_sql(PICTURE_DEPTH)}, st as (select distinct x.*, n.kind from x left join nodes n on n.node_id = x.node_id),
      ends as (select symbol_node_id as node_id, case when bool_or(coalesce(outcome, '') = 'error_exit') then 'error_exit' when bool_or(coalesce(outcome, '') = 'success') then 'success' else 'unknown' end as outcome from function_cfg where kind = 'exit' group by 1),
      nd as (select distinct node_id, kind from st), lk as (select path[-2] as source, node_id as target, type, max(r) as r from st where depth > 0 group by 1, 2, 3)
      select 'node' as what, kind, coalesce(outcome, '-') as sign, count(*) as n, cast(sum(node_id) as bigint) as id_sum from nd left join ends using (node_id) group by 1, 2, 3
      union all select 'link', type, {NAME_SQL.format('r')}, count(*), cast(sum(target) as bigint) from lk group by 1, 2, 3""",
}
