"""Graph queries: identities, closures, walks, co-change, control flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.functions.confidence import name_of, rank
from spanloom.operators import cfg as C
from spanloom.operators import cochange as CC
from spanloom.operators import graph as G
from spanloom.operators.intervals import innermost, overlapping
from spanloom.queries.common import EDGES_SQL, NAME_SQL, RANK_SQL, SPACES_SQL, read


def _edges(spark, d, *columns):
    return G.edges_once(read(spark, d, "edges"), *columns)


def edge_identity_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d, "edge_id").select("edge_id", "src_node_id", "dst_node_id", "type", "evidence_kind")


def edge_type_counts(spark, d):
    return _edges(spark, d, "confidence").groupBy("type", "confidence").agg(F.count("*").alias("n"))


def cross_repo_edges(spark, d):
    repo = read(spark, d, "nodes").select("node_id", "repo_id")
    e = _edges(spark, d, "edge_id").select("src_node_id", "dst_node_id", "type")
    a, b = repo.toDF("src_node_id", "src_repo"), repo.toDF("dst_node_id", "dst_repo")
    return e.join(a, "src_node_id").join(b, "dst_node_id").filter("src_repo <> dst_repo").groupBy("type").agg(F.count("*").alias("n"))


def cross_file_calls(spark, d):
    nodes = read(spark, d, "nodes").filter("kind = 'symbol'").select("node_id", F.concat_ws("/", S.package_of(F.col("key")), S.descriptors(F.col("key"))[0]["name"]).alias("file"))
    calls = _edges(spark, d, "edge_id").filter("type = 'CALLS'").select("src_node_id", "dst_node_id")
    joined = calls.join(nodes.toDF("src_node_id", "src_file"), "src_node_id").join(nodes.toDF("dst_node_id", "dst_file"), "dst_node_id")
    return joined.groupBy((F.col("src_file") != F.col("dst_file")).alias("cross_file")).agg(F.count("*").alias("n"))


def fan_in_utility(spark, d):
    return G.fan_in(read(spark, d, "edges"))


def neighbours_in_out(spark, d):
    return G.neighbours(read(spark, d, "edges"), ["CALLS", "CALLS_EXTERNAL"])


def _hub(spark, d) -> DataFrame:
    """The symbol with most distinct callers, the smallest id of equals: one row."""
    called = G.fan_in(read(spark, d, "edges"))
    symbol = read(spark, d, "nodes").filter("kind = 'symbol'").select("node_id")
    return called.join(symbol, "node_id", "left_semi").orderBy(F.desc("fan_in"), "node_id").limit(1).select(F.col("node_id").alias("seed"))


def two_hop(spark, d):
    return G.two_hop(read(spark, d, "edges"), ["CALLS"], _hub(spark, d))


def shared_nodes(spark, d):
    edges = read(spark, d, "edges")
    seeds = edges.filter("type = 'READS_CONFIG'").agg(F.min("src_node_id").alias("seed"))
    return G.shared_nodes(edges, read(spark, d, "nodes"), seeds, ["config", "datastore"])


def shared_degrees(spark, d):
    """For everything that touches config or data: how many others touch each of it, for all seeds at once."""
    targets = read(spark, d, "nodes").filter("kind in ('config', 'datastore')").select(F.col("node_id").alias("dst_node_id"))
    touches = read(spark, d, "edges").join(targets, "dst_node_id", "left_semi").select("src_node_id", "dst_node_id").distinct()
    # Counted per target, so that no pair of users is spelt out.
    users = touches.groupBy("dst_node_id").agg(F.count("*").alias("n"))
    return touches.join(users, "dst_node_id").select(F.col("src_node_id").alias("seed"), F.col("dst_node_id").alias("shared_id"), (F.col("n") - 1).alias("n_others"))


def _spaces(spark, d):
    """Module namespaces: a closure reaches them but does not go on from them."""
    return read(spark, d, "nodes").filter("kind = 'symbol'").filter(S.symbol_kind(F.col("key")) == "namespace").select("node_id")


def reverse_closure(spark, d):
    return G.closure(_edges(spark, d, "confidence"), _hub(spark, d), G.IMPACT_TYPES, stop=_spaces(spark, d))


def _chain_seeds(spark, d):
    return read(spark, d, "route_chain").filter("symbol_node_id is not null").select(F.col("route_node_id").alias("seed"), F.col("symbol_node_id").alias("node_id")).distinct()


def reachable_per_route(spark, d):
    """Reachability of every route at once, as sizes."""
    symbols = read(spark, d, "nodes").filter("kind = 'symbol'").select("node_id")
    found = G.reach(read(spark, d, "edges"), _chain_seeds(spark, d), G.REACH_TYPES, expand=symbols)
    return found.groupBy("seed").agg(F.count("*").alias("n_reached"), F.sum("node_id").alias("id_sum"))


def _first_route(spark, d):
    return read(spark, d, "route_chain").filter("symbol_node_id is not null").agg(F.min("route_node_id").alias("route_node_id"))


def walk_forward(spark, d):
    """Paths of the first route's chain, with line scopes of its anonymous entries."""
    chain = read(spark, d, "route_chain").join(_first_route(spark, d), "route_node_id", "left_semi").filter("symbol_node_id is not null")
    anonymous = F.col("name").isNull() & F.col("line").isNotNull() & F.col("end_line").isNotNull()
    seeds = chain.select(F.concat_ws(":", "position", "phase").alias("position"), F.col("symbol_node_id").alias("node_id"), F.when(anonymous, F.col("line")).alias("low"), F.when(anonymous, F.col("end_line")).alias("high")).distinct()
    rows = G.walk(_edges(spark, d, "edge_id", "confidence"), read(spark, d, "nodes"), seeds)
    return rows.select("position", F.array_join(F.col("edge_path").cast("array<string>"), ">").alias("edges"), "node_id", "depth", "type", "line", "path_confidence", "cycle", "truncated")


def shortest_confidence(spark, d):
    """Weakest-edge confidence of every reverse path level of the hub, counted."""
    found = reverse_closure(spark, d)
    return found.groupBy("depth", "path_confidence").agg(F.count("*").alias("n"))


def bucket_truncate(spark, d):
    routes = read(spark, d, "routes").select("node_id", "method", "url")
    return G.truncate_buckets(routes, "method", [F.col("url").asc(), F.col("node_id").asc()], 25).select("node_id", "method", "total")


def co_changed(spark, d):
    return CC.co_changed(_commits(spark, d))


def _commits(spark, d):
    runs = read(spark, d, "runs").filter("commit_sha <> ''").select(F.col("run_id").alias("last_run_id"), F.col("commit_sha").alias("sha"))
    return read(spark, d, "files").select("last_run_id", F.concat_ws("/", "repo_id", "path").alias("file")).join(runs, "last_run_id").select("sha", "file")


def peers_of(spark, d):
    return CC.peers(CC.co_changed(_commits(spark, d)))


def wide_commits(spark, d):
    """Commits too wide to tell pairs, when all files of a language were once rewritten in one commit."""
    sweeps = read(spark, d, "files").filter("lang is not null").select(F.concat(F.lit("sweep of "), "lang").alias("sha"), F.concat_ws("/", "repo_id", "path").alias("file"))
    return CC.commit_files(_commits(spark, d).unionByName(sweeps))[1]


def cfg_error_only(spark, d):
    return C.error_only_blocks(read(spark, d, "function_cfg"))


def cfg_guard_join(spark, d):
    return C.guards(read(spark, d, "function_cfg"))


def cfg_counts(spark, d):
    cfg = read(spark, d, "function_cfg")
    return cfg.agg(F.countDistinct("symbol_node_id").alias("functions"), F.count("*").alias("blocks"), F.count_if(F.col("outcome") == "error_exit").alias("error_exits"), F.count_if(F.col("outcome") == "success").alias("success_exits"))


def edge_blocks(spark, d):
    return C.block_of_edges(read(spark, d, "edges"), read(spark, d, "function_cfg"))


def calls_on_error_path(spark, d):
    return C.calls_on_error_path(read(spark, d, "edges"), read(spark, d, "function_cfg"))


def _ranges(spark, d):
    return read(spark, d, "function_cfg").filter("file_id is not null and kind = 'root'").select("file_id", "symbol_node_id", "start_line", "end_line")


def symbol_at(spark, d):
    points = read(spark, d, "edges").filter("file_id is not null and line is not null").select("file_id", "line")
    named = points.withColumn("at_file", F.col("file_id")).withColumn("at_line", F.col("line"))
    found = innermost(named, _ranges(spark, d), "file_id", ["at_file", "at_line"], "line", "symbol_node_id", "start_line", "end_line")
    return found.select(F.col("at_file").alias("file_id"), F.col("at_line").alias("line"), "symbol_node_id")


def hunk_overlap(spark, d):
    """Line spans of chain entries as changed hunks: the smallest function each touches."""
    hunks = read(spark, d, "route_chain").filter("file_id is not null and line is not null").select("file_id", F.col("line").alias("first"), F.coalesce("end_line", "line").alias("last")).distinct()
    met = overlapping(hunks, _ranges(spark, d), "file_id", "first", "last", "start_line", "end_line")
    best = met.groupBy("file_id", "first", "last").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), F.col("symbol_node_id").alias("id"))).alias("b"), F.count("*").alias("n_overlapping"))
    return best.select("file_id", "first", "last", F.col("b.id").alias("symbol_node_id"), "n_overlapping")


def possibly_dead(spark, d):
    """Static edges nobody saw for 30 days before the last sight of any edge; never-seen first."""
    edges = _edges(spark, d, "edge_id", "last_observed_at").filter("evidence_kind in ('scip', 'treesitter')")
    last = read(spark, d, "edges").agg(F.max("last_observed_at").alias("as_of"))
    old = edges.crossJoin(F.broadcast(last)).filter(F.col("last_observed_at").isNull() | (F.col("last_observed_at") < F.col("as_of") - F.expr("interval 30 days")))
    return old.select("edge_id", "type", "last_observed_at").orderBy(F.asc_nulls_first("last_observed_at"), "edge_id").limit(50)


def possibly_dead_count(spark, d):
    edges = _edges(spark, d, "last_observed_at").filter("evidence_kind in ('scip', 'treesitter')")
    last = read(spark, d, "edges").agg(F.max("last_observed_at").alias("as_of"))
    dead = F.col("last_observed_at").isNull() | (F.col("last_observed_at") < F.col("as_of") - F.expr("interval 30 days"))
    return edges.crossJoin(F.broadcast(last)).agg(F.count_if(dead).alias("possibly_dead"), F.count("*").alias("static_edges"))


def path_confidence_fold(spark, d):
    """Weakest confidence over both links of every call through a route's handler."""
    e = _edges(spark, d, "confidence").select("src_node_id", "dst_node_id", "type", rank(F.col("confidence")).alias("r"))
    a = e.filter("type = 'HANDLES'").select(F.col("src_node_id").alias("a"), F.col("dst_node_id").alias("m"), F.col("r").alias("r1"))
    b = e.filter("type = 'CALLS'").select(F.col("src_node_id").alias("m"), F.col("dst_node_id").alias("b"), F.col("r").alias("r2"))
    return a.join(b, "m").groupBy(name_of(F.least("r1", "r2")).alias("confidence")).agg(F.count("*").alias("n"))


def systematic_sample(spark, d):
    """Every tenth route by key order, numbered without one task sorting all."""
    from spanloom.operators.ranged import range_totals, with_global

    routes = read(spark, d, "routes").select("node_id").withColumn("one", F.lit(1).cast("long"))
    numbered = with_global(range_totals(routes, [], ["node_id"], "one", "sample-order"), "place")
    return numbered.filter("(place - 1) % 10 = 0").select("node_id", "place")


def bucket_precedence(spark, d):
    """The surest edge into each route decides its bucket."""
    routes = read(spark, d, "routes").select(F.col("node_id").alias("dst_node_id"))
    e = _edges(spark, d, "confidence").join(routes, "dst_node_id", "left_semi")
    best = e.groupBy("dst_node_id").agg(F.max(rank(F.col("confidence"))).alias("r"))
    return best.select(F.col("dst_node_id").alias("route_node_id"), F.when(F.col("r") == 3, "certain").when(F.col("r") > 0, "inferred").otherwise("unknown").alias("bucket"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_identity_dedupe, edge_type_counts, cross_repo_edges, cross_file_calls, fan_in_utility, neighbours_in_out, two_hop, shared_nodes, shared_degrees, reverse_closure, reachable_per_route, walk_forward, shortest_confidence, bucket_truncate, co_changed, peers_of, wide_commits,
        cfg_error_only, cfg_guard_join, cfg_counts, edge_blocks, calls_on_error_path, symbol_at, hunk_overlap, possibly_dead, possibly_dead_count, path_confidence_fold, systematic_sample, bucket_precedence,
    )
}

_HUB = """hub as (select n.node_id as seed from (select dst_node_id as node_id, count(distinct src_node_id) as f from edges where type = 'CALLS' group by 1) c
  join nodes n using (node_id) where n.kind = 'symbol' order by f desc, n.node_id limit 1)"""
_CLOSURE = f"""with recursive e as {EDGES_SQL}, {_HUB},
  l as (select dst_node_id as a, src_node_id as b, max({RANK_SQL}) as r, dst_node_id in {SPACES_SQL} as halt from e where type in ('CALLS', 'HANDLES', 'REQUESTS') and src_node_id is not null and dst_node_id is not null group by 1, 2),
  c as (select seed, seed as node_id, 0 as depth, 3 as r from hub
        union select c.seed, l.b, c.depth + 1, least(c.r, l.r) from c join l on l.a = c.node_id where c.depth < {G.MAX_DEPTH} and (c.depth = 0 or not l.halt)),
  m as (select seed, node_id, min(depth) as depth from c where depth > 0 group by 1, 2),
  out as (select m.seed, m.node_id, m.depth, max(c.r) as r from m join c on c.seed = m.seed and c.node_id = m.node_id and c.depth = m.depth group by 1, 2, 3)"""
_COMMITS = """rows as (select distinct r.commit_sha as sha, concat_ws('/', f.repo_id, f.path) as file from files f join runs r on r.run_id = f.last_run_id where r.commit_sha <> ''),
  narrow as (select * from rows where sha in (select sha from rows group by sha having count(*) <= 30)),
  totals as (select file, count(*) as n from narrow group by file),
  pairs as (select a.file as file_a, b.file as file_b, count(*) as commits from narrow a join narrow b on a.sha = b.sha and a.file < b.file group by 1, 2),
  co as (select file_a, file_b, commits, commits / ta.n::double as support_a, commits / tb.n::double as support_b from pairs join totals ta on ta.file = file_a join totals tb on tb.file = file_b)"""
_CFG_WALK = """n as (select symbol_node_id as s, block_index as b, min(parent_index) as p from function_cfg group by 1, 2),
  up as (select n.s, n.b, q.b as parent from n left join n q on q.s = n.s and q.b = n.p),
  ok as (select s, b, parent from up where parent is null union all select u.s, u.b, u.parent from ok join up u on u.s = ok.s and u.parent = ok.b),
  anc as (select s, b, b as a from ok union all select anc.s, anc.b, ok.parent from anc join ok on ok.s = anc.s and ok.b = anc.a where ok.parent is not null),
  eo as (select anc.s as symbol_node_id, anc.a as block_index, count(*) as n_exits from anc join function_cfg c on c.symbol_node_id = anc.s and c.block_index = anc.b
         where c.kind = 'exit' group by 1, 2 having sum(case when coalesce(c.outcome, 'unknown') <> 'error_exit' then 1 else 0 end) = 0)"""
_BLOCKS = """pts as (select distinct edge_id, src_node_id as s, line from edges where line is not null and src_node_id in (select symbol_node_id from function_cfg)),
  blk as (select pts.edge_id, coalesce(arg_min(c.block_index, (c.end_line - c.start_line) * 100000::bigint + c.block_index), 0) as cfg_block_index
          from pts left join function_cfg c on c.symbol_node_id = pts.s and c.kind <> 'exit' and pts.line between c.start_line and c.end_line group by pts.edge_id)"""

def walk_sql(most: int) -> str:
    """x: the paths of the first route's chain, at most ``most`` links long."""
    return f"""with recursive e as {EDGES_SQL},
      l as (select edge_id, src_node_id as a, dst_node_id as b, type, line, {RANK_SQL} as r from e where type in ({', '.join(repr(t) for t in G.FLOW_TYPES)}) and src_node_id in (select node_id from nodes where kind = 'symbol')),
      s as (select distinct concat_ws(':', position, phase) as position, symbol_node_id as node_id, case when name is null and line is not null and end_line is not null then line end as low, case when name is null and line is not null and end_line is not null then end_line end as high
            from route_chain where symbol_node_id is not null and route_node_id = (select min(route_node_id) from route_chain where symbol_node_id is not null)),
      w as (select position, [node_id] as path, cast([] as bigint[]) as ep, node_id, 0 as depth, cast(null as varchar) as type, cast(null as int) as line, 3 as r, low, high from s
            union all select w.position, list_append(w.path, l.b), list_append(w.ep, l.edge_id), l.b, w.depth + 1, l.type, l.line, least(w.r, l.r), null, null
            from w join l on l.a = w.node_id where w.depth < {most} and not list_contains(w.path[2:], l.b) and (w.low is null or l.line between w.low and w.high)),
      x as (select *, list_contains(path[:-2], node_id) as cycle from w)"""


ORACLE = {
    "edge_identity_dedupe": f"select edge_id, src_node_id, dst_node_id, type, evidence_kind from {EDGES_SQL}",
    "edge_type_counts": f"select type, confidence, count(*) as n from {EDGES_SQL} group by 1, 2",
    "cross_repo_edges": f"select e.type, count(*) as n from {EDGES_SQL} e join nodes a on a.node_id = e.src_node_id join nodes b on b.node_id = e.dst_node_id where a.repo_id <> b.repo_id group by 1",
    "cross_file_calls": f"""with f as (select node_id, split_part(key, ' ', 3) || '/' || split_part(key, '`', 2) as file from nodes where kind = 'symbol')
      select a.file <> b.file as cross_file, count(*) as n from {EDGES_SQL} e join f a on a.node_id = e.src_node_id join f b on b.node_id = e.dst_node_id where e.type = 'CALLS' group by 1""",
    "fan_in_utility": f"select dst_node_id as node_id, count(distinct src_node_id) as fan_in, count(distinct src_node_id) >= {G.UTILITY_FAN_IN} as is_utility from edges where type = 'CALLS' group by 1",
    "neighbours_in_out": """with l as (select distinct src_node_id as a, dst_node_id as b from edges where type in ('CALLS', 'CALLS_EXTERNAL'))
      select a as node_id, 'out' as direction, b as other_id from l union all select b, 'in', a from l""",
    "two_hop": f"""with {_HUB}, l as (select distinct src_node_id as a, dst_node_id as b from edges where type = 'CALLS')
      select distinct seed, l2.b as node_id from hub join l l1 on l1.a = seed join l l2 on l2.a = l1.b where l2.b <> seed""",
    "shared_nodes": """with s as (select min(src_node_id) as seed from edges where type = 'READS_CONFIG'),
      t as (select distinct src_node_id as a, dst_node_id as b from edges where dst_node_id in (select node_id from nodes where kind in ('config', 'datastore')))
      select seed, x.b as shared_id, y.a as other_id from s join t x on x.a = seed join t y on y.b = x.b where y.a <> seed""",
    "shared_degrees": """with t as (select distinct src_node_id as a, dst_node_id as b from edges where dst_node_id in (select node_id from nodes where kind in ('config', 'datastore')))
      select a as seed, b as shared_id, count(*) over (partition by b) - 1 as n_others from t""",
    "reverse_closure": f"{_CLOSURE} select seed, node_id, depth, {NAME_SQL.format('r')} as path_confidence from out",
    "shortest_confidence": f"{_CLOSURE} select depth, {NAME_SQL.format('r')} as path_confidence, count(*) as n from out group by 1, 2",
    "reachable_per_route": f"""with recursive l as (select distinct src_node_id as a, dst_node_id as b from edges where type = 'CALLS' and src_node_id in (select node_id from nodes where kind = 'symbol')),
      r as (select distinct route_node_id as seed, symbol_node_id as node_id, 0 as depth from route_chain where symbol_node_id is not null
            union select r.seed, l.b, r.depth + 1 from r join l on l.a = r.node_id where r.depth < {G.MAX_DEPTH}),
      u as (select distinct seed, node_id from r)
      select seed, count(*) as n_reached, cast(sum(node_id) as bigint) as id_sum from u group by 1""",
    "walk_forward": f"""{walk_sql(G.MAX_DEPTH)}
      select position, array_to_string(ep, '>') as edges, node_id, depth, type, line, {NAME_SQL.format('r')} as path_confidence, cycle, depth = {G.MAX_DEPTH} and not cycle and node_id in (select a from l) as truncated from x""",
    "bucket_truncate": """with r as (select *, row_number() over (partition by method order by url, node_id) as place, count(*) over (partition by method) as n, count(*) over () as total from routes)
      select node_id, method, total from r where place <= case when total <= 25 then n else greatest(1, floor(25 * n / total::double + 0.5)) end""",
    "co_changed": f"with {_COMMITS} select * from co",
    "peers_of": f"""with {_COMMITS}, both_ as (select file_a as file, file_b as peer, commits, support_a as support from co union all select file_b, file_a, commits, support_b from co)
      select * from both_ qualify row_number() over (partition by file order by support desc, commits desc, peer) <= 10""",
    "wide_commits": f"""with {_COMMITS}, every as (select * from rows union select 'sweep of ' || lang, concat_ws('/', repo_id, path) from files where lang is not null)
      select sha, count(*) as n_files from every group by sha having count(*) > 30""",
    "cfg_error_only": f"with recursive {_CFG_WALK} select * from eo",
    "cfg_guard_join": """select c.symbol_node_id, c.block_index, c.exit_form, c.error_name, c.start_line, p.kind as parent_kind, p.condition_text as guard
      from function_cfg c left join function_cfg p on p.symbol_node_id = c.symbol_node_id and p.block_index = c.parent_index where c.kind = 'exit' and c.outcome = 'error_exit'""",
    "cfg_counts": "select count(distinct symbol_node_id) as functions, count(*) as blocks, count(*) filter (where outcome = 'error_exit') as error_exits, count(*) filter (where outcome = 'success') as success_exits from function_cfg",
    "edge_blocks": f"with {_BLOCKS} select * from blk",
    "calls_on_error_path": f"""with recursive {_CFG_WALK}, {_BLOCKS}
      select distinct e.edge_id, e.src_node_id, e.dst_node_id, blk.cfg_block_index from edges e join blk using (edge_id)
      join eo on eo.symbol_node_id = e.src_node_id and eo.block_index = blk.cfg_block_index where e.type in ('CALLS', 'CALLS_EXTERNAL')""",
    "symbol_at": """with p as (select distinct file_id, line from edges where file_id is not null and line is not null),
      r as (select file_id, symbol_node_id, start_line, end_line from function_cfg where kind = 'root' and start_line <= end_line)
      select p.file_id, p.line, r.symbol_node_id from p join r on r.file_id = p.file_id and p.line between r.start_line and r.end_line
      qualify row_number() over (partition by p.file_id, p.line order by r.end_line - r.start_line, r.symbol_node_id) = 1""",
    "hunk_overlap": """with h as (select distinct file_id, line as first, coalesce(end_line, line) as last from route_chain where file_id is not null and line is not null),
      r as (select file_id, symbol_node_id, start_line, end_line from function_cfg where kind = 'root' and start_line <= end_line)
      select h.file_id, h.first, h.last, r.symbol_node_id, count(*) over (partition by h.file_id, h.first, h.last) as n_overlapping from h join r on r.file_id = h.file_id and r.start_line <= h.last and r.end_line >= h.first and h.first <= h.last
      qualify row_number() over (partition by h.file_id, h.first, h.last order by r.end_line - r.start_line, r.symbol_node_id) = 1""",
    "possibly_dead": f"""select edge_id, type, last_observed_at from {EDGES_SQL} where evidence_kind in ('scip', 'treesitter')
      and (last_observed_at is null or last_observed_at < (select max(last_observed_at) from edges) - interval 30 day) order by last_observed_at asc nulls first, edge_id limit 50""",
    "possibly_dead_count": f"""select count(*) filter (where last_observed_at is null or last_observed_at < (select max(last_observed_at) from edges) - interval 30 day) as possibly_dead, count(*) as static_edges
      from {EDGES_SQL} where evidence_kind in ('scip', 'treesitter')""",
    "path_confidence_fold": f"""with e as (select src_node_id as a, dst_node_id as b, type, {RANK_SQL} as r from {EDGES_SQL})
      select {NAME_SQL.format('least(x.r, y.r)')} as confidence, count(*) as n from e x join e y on y.a = x.b where x.type = 'HANDLES' and y.type = 'CALLS' group by 1""",
    "systematic_sample": "select node_id, place from (select node_id, row_number() over (order by node_id) as place from routes) where (place - 1) % 10 = 0",
    "bucket_precedence": f"""select dst_node_id as route_node_id, case max({RANK_SQL}) when 3 then 'certain' when 0 then 'unknown' else 'inferred' end as bucket
      from {EDGES_SQL} where dst_node_id in (select node_id from routes) group by 1""",
}
