"""Queries of the general data-pipeline problems 3, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.heavy_keys import dense_key_stats
from spanloom.operators.hierarchy import ancestor_pairs, hierarchy
from spanloom.operators.orphans import orphan_references

HEAVY_SHARE = 0.03


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Problem 3


def _heavy(stats: DataFrame, field: str) -> DataFrame:
    total = stats.agg(F.sum("n_rows").alias("_all"))
    return stats.crossJoin(F.broadcast(total)).filter(F.col("key_value").isNotNull() & (F.col("n_rows") >= HEAVY_SHARE * F.col("_all"))).select(F.lit(field).alias("field_name"), F.col("key_value").cast("string").alias("key_value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spans = dense_key_stats(read(spark, d, "spans"), "service_name", "duration_us", "received_at")
    edges = dense_key_stats(read(spark, d, "edges"), "dst_node_id", None, "last_observed_at")
    return _heavy(spans, "spans.service_name").unionByName(_heavy(edges, "edges.dst_node_id"))


def p3_service_stats(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "spans").groupBy("trace_id", "span_id").agg(F.min("service_name").alias("service_name"), F.min("duration_us").alias("duration_us"), F.max("received_at").alias("received_at"))
    return dense_key_stats(spans, "service_name", "duration_us", "received_at")


def p3_target_stats(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "edges").groupBy("edge_id").agg(F.min("dst_node_id").alias("dst_node_id"), F.max("last_observed_at").alias("last_observed_at"))
    return dense_key_stats(edges, "dst_node_id", None, "last_observed_at").select("key_value", "n_rows", "last_observed")


# Problem 5


def span_forest(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "spans").select("trace_id", "span_id", F.expr("nullif(parent_span_id, '')").alias("parent_span_id"))
    return hierarchy(spans, "trace_id", "span_id", "parent_span_id")


def cfg_forest(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(read(spark, d, "function_cfg"), "symbol_node_id", "block_index", "parent_index")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    loops = lambda forest, name: forest.filter(F.col("status") == "cycle").select(F.lit(name).alias("forest"), "tree_key", "node_key")
    return loops(span_forest(spark, d), "spans").unionByName(loops(cfg_forest(spark, d), "function_cfg"))


def _flat(forest: DataFrame) -> DataFrame:
    return forest.select("tree_key", "node_key", "status", "depth", "root_key", F.array_join("path", ">").alias("path"), "loop_key")


def p5_span_paths(spark: SparkSession, d: str) -> DataFrame:
    return _flat(span_forest(spark, d))


def p5_cfg_paths(spark: SparkSession, d: str) -> DataFrame:
    return _flat(cfg_forest(spark, d))


def p5_span_descendants(spark: SparkSession, d: str) -> DataFrame:
    return ancestor_pairs(span_forest(spark, d))


def p5_cfg_descendants(spark: SparkSession, d: str) -> DataFrame:
    return ancestor_pairs(cfg_forest(spark, d))


# Problem 6

_SEP = "\u0001"


def _day(ts: F.Column) -> F.Column:
    return F.unix_date(ts.cast("date"))


def span_orphans(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "spans")
    refs = spans.filter((F.col("parent_span_id") != "") & F.col("trace_id").isNotNull()).select(
        F.concat("trace_id", F.lit(":"), "span_id").alias("row_key"), F.concat_ws(_SEP, "trace_id", "parent_span_id").alias("key"), F.expr("cast(floor(start_unix_us / 86400000000D) as int)").alias("period")
    )
    parents = spans.filter(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()).select(F.concat_ws(_SEP, "trace_id", "span_id").alias("key"))
    return orphan_references(refs, parents).withColumn("field_name", F.lit("spans.parent_span_id"))


def _run_days(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").groupBy("run_id").agg(_day(F.min("started_at")).alias("period"))


def edge_orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "edges").join(_run_days(spark, d), "run_id", "left")
    refs = edges.select(F.col("edge_id").cast("string").alias("row_key"), F.col("dst_node_id").alias("key"), "period")
    return orphan_references(refs, read(spark, d, "nodes").select(F.col("node_id").alias("key"))).withColumn("field_name", F.lit("edges.dst_node_id"))


def check_orphans(spark: SparkSession, d: str) -> DataFrame:
    checks = read(spark, d, "route_chain").filter("check_kind is not null and name is not null").join(_run_days(spark, d), "run_id", "left")
    refs = checks.select(F.concat_ws(":", "route_node_id", "phase", "position").alias("row_key"), F.col("name").alias("key"), "period")
    return orphan_references(refs, read(spark, d, "check_rules").select(F.col("helper").alias("key"))).withColumn("field_name", F.lit("route_chain.name"))


def all_orphans(spark: SparkSession, d: str) -> DataFrame:
    return span_orphans(spark, d).withColumn("key", F.col("key").cast("string")).unionByName(edge_orphans(spark, d).withColumn("key", F.col("key").cast("string"))).unionByName(check_orphans(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return all_orphans(spark, d).select("field_name", "row_key").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    rows = all_orphans(spark, d).groupBy("field_name", "row_key").agg(F.min("period").alias("period"))
    return rows.groupBy("field_name", F.date_from_unix_date("period").cast("string").alias("day")).agg(F.count("*").alias("n_orphans"))


QUERIES = {
    "p3_found": p3_found,
    "p3_service_stats": p3_service_stats,
    "p3_target_stats": p3_target_stats,
    "p5_found": p5_found,
    "p5_span_paths": p5_span_paths,
    "p5_cfg_paths": p5_cfg_paths,
    "p5_span_descendants": p5_span_descendants,
    "p5_cfg_descendants": p5_cfg_descendants,
    "p6_found": p6_found,
    "p6_report": p6_report,
}

_SPAN_TREE = """
  n as (select trace_id t, span_id s, min(nullif(parent_span_id, '')) p from spans group by 1, 2),
  up as (select n.t, n.s, n.p, q.s as parent from n left join n q on q.t = n.t and q.s = n.p)"""
_CFG_TREE = """
  n as (select cast(symbol_node_id as varchar) t, cast(block_index as varchar) s, min(cast(parent_index as varchar)) p from function_cfg group by 1, 2),
  up as (select n.t, n.s, n.p, q.s as parent from n left join n q on q.t = n.t and q.s = n.p)"""


def _cycles(tree: str, name: str) -> str:
    return f"""select '{name}' as forest, t as tree_key, s as node_key from (
      with recursive {tree}, walk as (select t, s, parent as a from up where parent is not null
        union select w.t, w.s, u.parent from walk w join up u on u.t = w.t and u.s = w.a where u.parent is not null and w.a <> w.s)
      select t, s from walk where a = s)"""


def _paths_sql(tree: str) -> str:
    return f"""with recursive {tree},
      walk as (select t, s, case when p is null then 'root' else 'orphan_root' end as status, 0 as depth, s as root_key, s as path from up where parent is null
        union all select u.t, u.s, 'node', w.depth + 1, w.root_key, w.path || '>' || u.s from walk w join up u on u.t = w.t and u.parent = w.s),
      lost as (select * from up where not exists (select 1 from walk w where w.t = up.t and w.s = up.s)),
      climb as (select t, s, parent as a from lost union select c.t, c.s, l.parent from climb c join lost l on l.t = c.t and l.s = c.a),
      loops as (select t, s, min(a) as loop_key from climb group by t, s having bool_or(a = s))
    select t as tree_key, s as node_key, status, cast(depth as int) as depth, root_key, path, cast(null as varchar) as loop_key from walk
    union all select l.t, l.s, case when o.s is null then 'below_cycle' else 'cycle' end, null, null, null, o.loop_key from lost l left join loops o on o.t = l.t and o.s = l.s"""


def _descendants_sql(tree: str) -> str:
    return f"""with recursive {tree},
      ok as (select t, s, parent from up where parent is null union all select u.t, u.s, u.parent from ok join up u on u.t = ok.t and u.parent = ok.s),
      pairs as (select t, parent as a, s as b, 1 as distance from ok where parent is not null
        union all select p.t, o.parent, p.b, p.distance + 1 from pairs p join ok o on o.t = p.t and o.s = p.a where o.parent is not null)
    select t as tree_key, a as ancestor_key, b as descendant_key, cast(distance as int) as distance from pairs"""


_ORPHANS = """
  r as (select run_id, cast(min(started_at) as date) as day from runs group by run_id),
  o as (
    select 'spans.parent_span_id' as field_name, trace_id || ':' || span_id as row_key, cast(epoch_ms(start_unix_us // 1000) as date) as day
    from spans s where parent_span_id <> '' and not exists (select 1 from spans p where p.trace_id = s.trace_id and p.span_id = s.parent_span_id)
    union all select 'edges.dst_node_id', cast(edge_id as varchar), r.day from edges left join r using (run_id)
    where dst_node_id is not null and dst_node_id not in (select node_id from nodes)
    union all select 'route_chain.name', concat_ws(':', route_node_id, phase, position), r.day from route_chain left join r using (run_id)
    where check_kind is not null and name is not null and name not in (select helper from check_rules))"""

ORACLE = {
    "p3_found": f"""select 'spans.service_name' as field_name, service_name as key_value from spans group by service_name
      having service_name is not null and count(*) >= {HEAVY_SHARE} * (select count(*) from spans)
      union all select 'edges.dst_node_id', cast(dst_node_id as varchar) from edges group by dst_node_id
      having dst_node_id is not null and count(*) >= {HEAVY_SHARE} * (select count(*) from edges)""",
    "p3_service_stats": """with s as (select min(service_name) k, min(duration_us) v, max(received_at) r from spans group by trace_id, span_id)
      select k as key_value, count(*) as n_rows, count(v) as n_values, cast(sum(v) as bigint) as sum_value, min(v) as min_value, max(v) as max_value, max(r) as last_observed from s group by k""",
    "p3_target_stats": """with e as (select min(dst_node_id) k, max(last_observed_at) r from edges group by edge_id)
      select k as key_value, count(*) as n_rows, max(r) as last_observed from e group by k""",
    "p5_found": f"{_cycles(_SPAN_TREE, 'spans')} union all {_cycles(_CFG_TREE, 'function_cfg')}",
    "p5_span_paths": _paths_sql(_SPAN_TREE),
    "p5_cfg_paths": _paths_sql(_CFG_TREE),
    "p5_span_descendants": _descendants_sql(_SPAN_TREE),
    "p5_cfg_descendants": _descendants_sql(_CFG_TREE),
    "p6_found": f"with {_ORPHANS} select distinct field_name, row_key from o",
    "p6_report": f"""with {_ORPHANS}, d as (select field_name, row_key, min(day) as day from o group by all)
      select field_name, cast(day as varchar) as day, count(*) as n_orphans from d group by all""",
}
