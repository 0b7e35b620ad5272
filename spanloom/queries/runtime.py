"""Queries over traces and routes: promotion, root causes, sampling, windows, security."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import normalise_path
from spanloom.operators import graph as G
from spanloom.operators import routing as R
from spanloom.operators import traces as TR
from spanloom.operators.intervals import containing
from spanloom.session import shared_dir, stage
from spanloom.queries.common import EDGES_SQL, RANK_SQL, read
from spanloom.streaming.sampler import service_sessions, tail_sample_stream, traffic_windows

SAMPLE_RATE, ERRORED_LIMIT, ROUTE_TRACES, LONGER = 0.1, 20, 10, 200
TRAFFIC = ["start_unix_us", "service_name", "http_route", "status", "duration_us"]


def span_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return TR.once(read(spark, d, "spans"), "service_name", "duration_us", "status").select("trace_id", "span_id", "service_name", "duration_us", "status")


def span_group_max(spark, d):
    spans = TR.once(read(spark, d, "spans"), "service_name", "http_route", "http_method", "start_unix_us")
    return spans.filter("http_route is not null").groupBy("service_name", "http_route", "http_method").agg(F.max("start_unix_us").alias("last_us"), F.count("*").alias("hits"))


def _named_clients(spans):
    """Spans whose client spans carry the route and method of the server span below them, as some
    instrumentations record; the given tables have none. Odd ports are reached by loopback."""
    below = spans.filter("kind = 'server' and http_route is not null and parent_span_id <> ''").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.min(F.struct("http_route", "http_method")).alias("_below"))
    client = F.col("kind") == "client"
    named = spans.join(below, ["trace_id", "span_id"], "left")
    for c in ("http_route", "http_method"):
        named = named.withColumn(c, F.when(client, F.coalesce(c, f"_below.{c}")).otherwise(F.col(c)))
    return named.withColumn("server_address", F.when(client & (F.col("server_port") % 2 == 1), "localhost").otherwise(F.col("server_address"))).drop("_below")


def _places(spark, d):
    """(hosts, ports): services by name and by their address, and by the port their spans are called at."""
    services = read(spark, d, "routes").select(F.col("service_name").alias("service")).distinct()
    hosts = services.select(F.col("service").alias("host"), "service").unionByName(services.select(F.concat("service", F.lit(".svc.example")).alias("host"), "service"))
    called = read(spark, d, "spans").filter("kind = 'client' and server_port is not null").select(F.col("server_port").alias("port"), F.split_part("server_address", F.lit("."), F.lit(1)).alias("service"))
    return hosts, called.groupBy("port").agg(F.min("service").alias("service"))


def client_parent_pairs(spark, d):
    return R.client_pairs(_named_clients(TR.once(read(spark, d, "spans"), *R.PAIR_COLUMNS)))


def path_normalise(spark, d):
    paths = read(spark, d, "spans").filter("url_path is not null").select("url_path").distinct()
    return paths.select("url_path", normalise_path(F.col("url_path")).alias("path"))


def template_match(spark, d):
    paths = read(spark, d, "spans").filter("url_path is not null").select("service_name", F.col("http_method").alias("method"), F.col("url_path").alias("path")).distinct()
    return R.match_templates(paths, read(spark, d, "routes"))


def promote_routes(spark, d):
    return R.route_hits(TR.once(read(spark, d, "spans"), *R.HIT_COLUMNS), read(spark, d, "routes"))


def _promote(spark, d):
    columns = {*R.PAIR_COLUMNS, *R.HIT_COLUMNS, "code_function", "code_filepath", "db_system", "db_name", "db_operation"}
    spans = stage(_named_clients(TR.once(read(spark, d, "spans"), *sorted(columns))), "promoted-spans")
    return R.promote(spans, read(spark, d, "routes"), read(spark, d, "nodes"), read(spark, d, "edges"), *_places(spark, d))


def promotion_report(spark, d):
    """Everything runtime confirms, counted in one row."""
    return _promote(spark, d)[1]


def promoted_edges(spark, d):
    """Edges after promotion, by type, confidence and evidence."""
    after = _promote(spark, d)[0]
    return after.groupBy("type", "confidence", "evidence_kind").agg(F.count("*").alias("n"), F.max("last_observed_at").alias("last"), F.count("last_observed_at").alias("n_seen"))


def promote_edges(spark, d):
    """Calls between routes that client spans show, against the edges that say so already."""
    spans = _named_clients(TR.once(read(spark, d, "spans"), *R.PAIR_COLUMNS))
    calls = R.request_calls(spans, read(spark, d, "routes"), *_places(spark, d)).filter("src_node_id is not null and dst_node_id is not null")
    seen = calls.select("src_node_id", "dst_node_id", F.lit("REQUESTS").alias("type"), F.timestamp_micros("last_us").cast("timestamp_ntz").alias("seen_at"))
    return R.confirm_edges(read(spark, d, "edges").filter("type = 'REQUESTS'"), seen)


def route_errored_traces(spark, d):
    """The newest errored traces of every route, by route or by concrete path."""
    spans = TR.once(read(spark, d, "spans"), "status", "service_name", "http_route", "url_path", "start_unix_us", "http_status")
    return R.errored_traces_of_routes(spans, read(spark, d, "routes"), ROUTE_TRACES)


def touch_forward_only(spark, d):
    hits = promote_routes(spark, d).filter("node_id is not null").select("node_id", F.timestamp_micros("last_us").cast("timestamp_ntz").alias("seen_at"))
    return R.touch_forward_only(G.edges_once(read(spark, d, "edges"), "edge_id", "last_observed_at"), hits).select("edge_id", "last_observed_at")


def errored_traces_topk(spark, d):
    return TR.errored_traces(TR.once(read(spark, d, "spans"), "status", "parent_span_id", "start_unix_us"), ERRORED_LIMIT)


def trace_root_cause(spark, d):
    return TR.root_causes(read(spark, d, "spans"))


def tail_sample(spark, d):
    return TR.tail_sample(TR.once(read(spark, d, "spans"), "status"), SAMPLE_RATE).select("trace_id", "span_id", "status")


def _stream_folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run_stream(stream, mode):
    """Run a stream to the end of its input and read what it wrote."""
    spark, out = stream.sparkSession, _stream_folder(stream.sparkSession)

    def write(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _span_stream(spark, d):
    """spans as a stream of files, whether the table is one file or a folder of them."""
    schema = read(spark, d, "spans").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{d}/spans.parquet*")


def stream_windows(spark, d):
    """Windows that a stream in four batches has closed behind its watermark of an hour.

    The batches are runs of start times, so nothing is late; the last window stays open.
    """
    spans = read(spark, d, "spans").select("trace_id", "span_id", "start_unix_us", "service_name", "http_route", "status", "duration_us")
    cuts = spans.select(F.percentile_approx("start_unix_us", [0.25, 0.5, 0.75])).first()[0] or []
    folder, low = f"{_stream_folder(spark)}/in", None
    for i, high in enumerate([*cuts, None]):
        part = spans.filter((F.lit(True) if low is None else F.col("start_unix_us") >= low) & (F.lit(True) if high is None else F.col("start_unix_us") < high))
        part.coalesce(1).write.parquet(f"{folder}/{i}")
        low = high
    stream = spark.readStream.schema(spans.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    once = stream.withColumn("at", F.timestamp_micros("start_unix_us")).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["trace_id", "span_id"])
    return _run_stream(traffic_windows(once, "6 hours", delay="1 hour"), "append").select(_plain("window_start"), "service_name", "http_route", "n_spans", "n_errors", "duration_us")


def stream_tail_sample(spark, d):
    """Whole-trace sampling as a stream with keyed state; equals the batch sampler."""
    columns = ["trace_id", "span_id", "parent_span_id", "status"]
    kept = _run_stream(tail_sample_stream(_span_stream(spark, d).select(*columns), SAMPLE_RATE, 0), "append")
    return kept.select("trace_id", "span_id", "status").distinct()


def _plain(column):
    return F.col(column).cast("timestamp_ntz").alias(column)


def window_tumbling(spark, d):
    return traffic_windows(TR.once(read(spark, d, "spans"), *TRAFFIC), "6 hours").select(_plain("window_start"), "service_name", "http_route", "n_spans", "n_errors", "duration_us")


def window_sliding(spark, d):
    return traffic_windows(TR.once(read(spark, d, "spans"), *TRAFFIC), "1 day", "6 hours").groupBy(_plain("window_start")).agg(F.sum("n_spans").alias("n_spans"))


def window_session(spark, d):
    return service_sessions(TR.once(read(spark, d, "spans"), "start_unix_us", "service_name"), "10 minutes").select("service_name", _plain("session_start"), _plain("session_end"), "n_spans")


# Security and routes


def _chain(spark, d):
    return read(spark, d, "route_chain").dropDuplicates(["route_node_id", "phase", "position"])


def ordered_chain(spark, d):
    """Each route's chain in order: boot phases first, inline checks last."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct((F.col("phase") == "handler_inline").alias("inline"), "position", "phase", F.coalesce("name", F.lit("?")).alias("name")))), lambda x: F.concat_ws(":", x["position"], x["phase"], x["name"]))
    return _chain(spark, d).groupBy("route_node_id").agg(F.array_join(entries, ">").alias("chain"))


def read_chain(spark, d):
    nodes = read(spark, d, "nodes").select(F.col("node_id").alias("symbol_node_id"), F.col("key").alias("symbol"))
    channel = F.when(F.col("evidence_kind") == "boot", "boot").otherwise("inline")
    return _chain(spark, d).join(nodes, "symbol_node_id", "left").select("route_node_id", "position", "phase", "name", "check_kind", channel.alias("channel"), "confidence", "symbol")


def coverage_matrix(spark, d):
    channel = F.when(F.col("evidence_kind") == "boot", "boot").otherwise("inline")
    checks = _chain(spark, d).filter("check_kind is not null").withColumn("channel", channel)
    channels = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(F.col("check_kind") == k, F.col("channel")))), "+")
    routes = read(spark, d, "routes").select(F.col("node_id").alias("route_node_id"))
    return routes.join(checks, "route_node_id", "left").groupBy("route_node_id").agg(*(channels(k).alias(k) for k in ("auth", "tenant", "rbac", "ratelimit")), F.count("check_kind").alias("n_checks"))


def coverage_rollup(spark, d):
    checks = _chain(spark, d).filter("check_kind is not null")
    return checks.rollup("check_kind", "phase").agg(F.count("*").alias("n"), F.countDistinct("route_node_id").alias("n_routes"))


def check_kind_lookup(spark, d):
    """Checks whose recorded kind is not the one the rules give their helper."""
    rules = read(spark, d, "check_rules").select(F.col("helper").alias("name"), F.col("check_kind").alias("rule_kind"))
    return _chain(spark, d).filter("name is not null").join(rules, "name", "left").groupBy("check_kind", "rule_kind").agg(F.count("*").alias("n"))


def blind_spots(spark, d):
    keys = read(spark, d, "nodes").select(F.col("node_id").alias("route_node_id"), F.col("key").alias("route_key"))
    unseen = _chain(spark, d).filter("symbol_node_id is null and origin not in ('framework', 'handler')")
    return unseen.join(keys, "route_node_id").select("route_key", "phase", "position", F.col("key").alias("entry_key"))


def _writes(spark, d):
    """Datastores each route can write, by call closure."""
    nodes, edges = read(spark, d, "nodes"), read(spark, d, "edges")
    symbols = nodes.filter("kind = 'symbol'").select("node_id")
    seeds = _chain(spark, d).filter("symbol_node_id is not null").select(F.col("route_node_id").alias("seed"), F.col("symbol_node_id").alias("node_id"))
    reached = G.reach(edges, seeds, G.REACH_TYPES, expand=symbols)
    stores = nodes.filter("kind = 'datastore'").select(F.col("node_id").alias("dst_node_id"), F.col("key").alias("datastore"))
    writes = edges.filter("type = 'WRITES'").join(stores, "dst_node_id").select(F.col("src_node_id").alias("node_id"), "datastore").distinct()
    return reached.join(writes, "node_id").select(F.col("seed").alias("route_node_id"), "datastore").distinct()


def _write_lines(spark, d, longer=0):
    """Writes to a datastore on a line inside a route's handler, by file and line span."""
    handlers = _chain(spark, d).filter("phase in ('handler', 'handler_inline') and line is not null and file_id is not null").select("route_node_id", "file_id", F.col("line").alias("low"), (F.coalesce("end_line", "line") + longer).alias("high")).distinct()
    stores = read(spark, d, "nodes").filter("kind = 'datastore'").select(F.col("node_id").alias("dst_node_id"), F.col("key").alias("datastore"))
    writes = read(spark, d, "edges").filter("type = 'WRITES' and file_id is not null and line is not null").join(stores, "dst_node_id").select("file_id", F.col("line").alias("at"), "datastore").distinct()
    return containing(writes, handlers, "file_id", "at", "low", "high").select("route_node_id", "datastore").distinct()


def write_span_join(spark, d):
    """The same with every handler taken as LONGER lines longer: those of the tables are few lines long and hold next to no write."""
    return _write_lines(spark, d, LONGER)


def security_path(spark, d):
    """Per route: checks, kinds, writes reached by call or by handler lines, and the anomaly."""
    chain = _chain(spark, d)
    routes = read(spark, d, "routes").select(F.col("node_id").alias("route_node_id"), "service_name", "method", "url")
    checks = chain.filter("check_kind is not null").groupBy("route_node_id").agg(F.count("*").alias("n_checks"), F.array_join(F.array_sort(F.collect_set("check_kind")), ",").alias("kinds"), F.max((F.col("check_kind") == "tenant").cast("int")).alias("_tenant"))
    writes = _writes(spark, d).unionByName(_write_lines(spark, d)).distinct().groupBy("route_node_id").agg(F.count("*").alias("n_writes"))
    out = routes.join(checks, "route_node_id", "left").join(writes, "route_node_id", "left")
    n, w = F.coalesce("n_checks", F.lit(0)), F.coalesce("n_writes", F.lit(0))
    return out.select("route_node_id", "service_name", "method", "url", n.alias("n_checks"), F.coalesce("kinds", F.lit("")).alias("kinds"), w.alias("n_writes"), ((w > 0) & (F.coalesce("_tenant", F.lit(0)) == 0)).alias("writes_without_tenant"), (n == 0).alias("unprotected"))


def write_without_check(spark, d):
    return security_path(spark, d).filter("writes_without_tenant").select("route_node_id", "service_name", "n_writes", "kinds")


def route_listing(spark, d):
    checks = _chain(spark, d).groupBy(F.col("route_node_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("check_kind")), ",").alias("checks"), F.count("*").alias("n_entries"))
    return read(spark, d, "routes").join(checks, "node_id", "left").select("node_id", "service_name", "method", "url", "has_schema", F.coalesce("checks", F.lit("")).alias("checks"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


def error_surface(spark, d):
    """Error exits and thrown errors of the functions each route reaches, per route."""
    symbols = read(spark, d, "nodes").filter("kind = 'symbol'").select("node_id")
    seeds = _chain(spark, d).filter("symbol_node_id is not null").select(F.col("route_node_id").alias("seed"), F.col("symbol_node_id").alias("node_id"))
    reached = G.reach(read(spark, d, "edges"), seeds, G.REACH_TYPES, expand=symbols)
    exits = read(spark, d, "function_cfg").filter("outcome = 'error_exit'").groupBy(F.col("symbol_node_id").alias("node_id")).agg(F.count("*").alias("exits"), F.collect_set("start_line").alias("lines"))
    throws = G.edges_once(read(spark, d, "edges"), "edge_id").filter("type = 'THROWS'").select(F.col("src_node_id").alias("node_id"), "line")
    # A throw on a line that control flow already reports is that exit, not another.
    fresh = throws.join(exits.select("node_id", "lines"), "node_id", "left").filter("lines is null or line is null or not array_contains(lines, line)").groupBy("node_id").agg(F.count("*").alias("throws"))
    return reached.join(exits.select("node_id", "exits"), "node_id", "left").join(fresh, "node_id", "left").groupBy(F.col("seed").alias("route_node_id")).agg(F.coalesce(F.sum("exits"), F.lit(0)).alias("error_exits"), F.coalesce(F.sum("throws"), F.lit(0)).alias("throws"))


def error_correlation(spark, d):
    """Observed errors per route beside its static ones: neither pass filters the other."""
    observed = TR.once(read(spark, d, "spans"), "status", "http_route", "service_name").filter("status = 'error' and http_route is not null").groupBy("service_name", F.col("http_route").alias("url")).agg(F.count("*").alias("n_errors"), F.countDistinct("trace_id").alias("n_traces"))
    static = read(spark, d, "routes").join(error_surface(spark, d), F.col("node_id") == F.col("route_node_id"), "left").groupBy("service_name", "url").agg(F.coalesce(F.sum(F.col("error_exits") + F.col("throws")), F.lit(0)).alias("n_static"))
    return observed.join(static, ["service_name", "url"], "full").select("service_name", "url", "n_errors", "n_traces", "n_static")


QUERIES = {
    f.__name__: f
    for f in (
        span_dedupe, span_group_max, client_parent_pairs, path_normalise, template_match, promote_routes, promotion_report, promoted_edges, promote_edges, route_errored_traces, touch_forward_only, errored_traces_topk, trace_root_cause, tail_sample, stream_windows, stream_tail_sample, window_tumbling, window_sliding, window_session,
        ordered_chain, read_chain, coverage_matrix, coverage_rollup, check_kind_lookup, blind_spots, write_span_join, security_path, write_without_check, route_listing, error_surface, error_correlation,
    )
}

_ONCE = "s as (select * from spans qualify row_number() over (partition by trace_id, span_id order by received_at) = 1)"
_CHAIN = "ch as (select * from route_chain qualify row_number() over (partition by route_node_id, phase, position) = 1)"
_NORM = "case when regexp_replace(regexp_replace({0}, '[?#].*$', '', 's'), '/+$', '') = '' then '/' else regexp_replace(regexp_replace({0}, '[?#].*$', '', 's'), '/+$', '') end"
_FITS = """len(string_split(p, '/')) = len(string_split(t, '/')) and len(list_filter(list_zip(string_split(p, '/'), string_split(t, '/')),
  lambda z: not (starts_with(z[2], ':') or z[2] = '*' or (starts_with(z[2], '{') and ends_with(z[2], '}')) or z[1] = z[2]))) = 0"""


def _match(source: str) -> str:
    return f"""mp as (select distinct service_name, method, path, {_NORM.format('path')} as p from ({source})),
  mt as (select node_id, service_name as s2, method as m2, {_NORM.format('url')} as t from routes),
  mc as (select * from mp join mt on service_name = s2 and (method is null or method = m2) where {_FITS}),
  mm as (select service_name, method, path, case when count(*) filter (where p = t) = 1 then min(node_id) filter (where p = t) when count(*) = 1 then min(node_id) end as node_id from mc group by 1, 2, 3)"""


_HITS = f"""{_ONCE},
  g as (select service_name, http_route, url_path, http_method, max(start_unix_us) as last_us, count(*) as hits from s
        where (http_route is not null or url_path is not null) and (kind is null or kind = 'server') group by 1, 2, 3, 4),
  g2 as (select g.*, (select min(node_id) from routes r where r.service_name = g.service_name and r.url = g.http_route and (g.http_method is null or r.method = g.http_method)) as direct from g),
  {_match("select service_name, http_method as method, url_path as path from g2 where direct is null and url_path is not null")},
  hits as (select g2.service_name, g2.http_route, g2.url_path, g2.http_method, g2.last_us, g2.hits, coalesce(g2.direct, mm.node_id) as node_id,
           case when g2.direct is not null then 'route' when mm.node_id is not null then 'template' end as matched_by
           from g2 left join mm on g2.direct is null and mm.service_name = g2.service_name and mm.method is not distinct from g2.http_method and mm.path = g2.url_path)"""
_PAIRS = """cp as (select c.service_name, c.http_route, c.http_method, c.server_address, c.server_port, p.http_route as caller_route, p.service_name as parent_service, max(c.start_unix_us) as last_us, count(*) as calls
  from s c left join s p on p.trace_id = c.trace_id and p.span_id = c.parent_span_id where c.kind = 'client' and c.http_route is not null group by 1, 2, 3, 4, 5, 6, 7)"""
_NAMED = f"""{_ONCE.replace('s as', 's0 as')},
  bl as (select trace_id, parent_span_id as span_id, arg_min(http_route, http_route || chr(0) || coalesce(http_method, '')) as r, arg_min(http_method, http_route || chr(0) || coalesce(http_method, '')) as m from s0 where kind = 'server' and http_route is not null and parent_span_id <> '' group by 1, 2),
  s as (select s0.* replace (case when kind = 'client' then coalesce(http_route, bl.r) else http_route end as http_route, case when kind = 'client' then coalesce(http_method, bl.m) else http_method end as http_method,
        case when kind = 'client' and server_port % 2 = 1 then 'localhost' else server_address end as server_address) from s0 left join bl on bl.trace_id = s0.trace_id and bl.span_id = s0.span_id)"""
_CALLS = """pt as (select server_port as port, min(split_part(server_address, '.', 1)) as service from spans where kind = 'client' and server_port is not null group by 1),
  sv as (select distinct service_name as service from routes),
  cl as (select cp.*, coalesce((select min(service) from sv where cp.server_address in (service, service || '.svc.example')), case when server_address = 'localhost' then (select service from pt where port = cp.server_port) end) as callee_service from cp),
  rq as (select cl.*, (select min(node_id) from routes r where r.service_name = callee_service and r.url = cl.http_route and r.method = coalesce(cl.http_method, 'GET')) as dst_node_id,
         (select min(node_id) from routes r where r.service_name = cl.parent_service and r.url = cl.caller_route) as src_node_id from cl)"""
_SYMBOLS = "(select node_id from nodes where kind = 'symbol')"
_REACH = f"""l as (select distinct src_node_id as a, dst_node_id as b from edges where type = 'CALLS' and src_node_id in {_SYMBOLS}),
  rr as (select distinct route_node_id as seed, symbol_node_id as node_id, 0 as depth from route_chain where symbol_node_id is not null
         union select rr.seed, l.b, rr.depth + 1 from rr join l on l.a = rr.node_id where rr.depth < {G.MAX_DEPTH}),
  reached as (select distinct seed, node_id from rr)"""
_WRITE_LINES = """h as (select distinct route_node_id, file_id, line as low, coalesce(end_line, line) as high from ch where phase in ('handler', 'handler_inline') and line is not null and file_id is not null),
  wl as (select distinct h.route_node_id, n.key as datastore from h join edges e on e.file_id = h.file_id and e.line between h.low and h.high join nodes n on n.node_id = e.dst_node_id where e.type = 'WRITES' and n.kind = 'datastore')"""
_SECURITY = f"""{_REACH}, {_CHAIN}, {_WRITE_LINES},
  wc as (select distinct r.seed as route_node_id, n.key as datastore from reached r join edges e on e.src_node_id = r.node_id join nodes n on n.node_id = e.dst_node_id where e.type = 'WRITES' and n.kind = 'datastore'),
  ws as (select route_node_id, count(*) as n_writes from (select * from wc union select * from wl) group by 1),
  ck as (select route_node_id, count(*) as n_checks, string_agg(distinct check_kind, ',' order by check_kind) as kinds, bool_or(check_kind = 'tenant') as tenant from ch where check_kind is not null group by 1),
  sec as (select r.node_id as route_node_id, r.service_name, r.method, r.url, coalesce(n_checks, 0) as n_checks, coalesce(kinds, '') as kinds, coalesce(n_writes, 0) as n_writes,
          coalesce(n_writes, 0) > 0 and not coalesce(tenant, false) as writes_without_tenant, coalesce(n_checks, 0) = 0 as unprotected
          from routes r left join ck on ck.route_node_id = r.node_id left join ws on ws.route_node_id = r.node_id)"""
_SURFACE = f"""{_REACH},
  ex as (select symbol_node_id as node_id, count(*) as exits, list(start_line) as lines from function_cfg where outcome = 'error_exit' group by 1),
  th as (select src_node_id as node_id, line from {EDGES_SQL} where type = 'THROWS'),
  tf as (select th.node_id, count(*) as throws from th left join ex using (node_id) where ex.lines is null or th.line is null or not list_contains(ex.lines, th.line) group by 1),
  surf as (select seed as route_node_id, cast(coalesce(sum(exits), 0) as bigint) as error_exits, cast(coalesce(sum(throws), 0) as bigint) as throws from reached left join ex using (node_id) left join tf using (node_id) group by 1)"""
_OBSERVED = f"""{_NAMED}, {_PAIRS}, {_CALLS},
  seen as (select src_node_id, dst_node_id, make_timestamp(max(last_us)) as seen from rq where src_node_id is not null and dst_node_id is not null group by 1, 2),
  have as (select src_node_id, dst_node_id, arg_max(confidence, {RANK_SQL}::varchar || evidence_kind) as confidence, arg_max(evidence_kind, {RANK_SQL}::varchar || evidence_kind) as evidence_kind, max(last_observed_at) as last from edges where type = 'REQUESTS' group by 1, 2),
  oc as (select coalesce(h.src_node_id, o.src_node_id) as src_node_id, coalesce(h.dst_node_id, o.dst_node_id) as dst_node_id, 'REQUESTS' as type,
      case when o.seen is not null and (h.confidence is null or h.confidence = 'inferred') then 'observed' else h.confidence end as confidence, coalesce(h.evidence_kind, 'otel') as evidence_kind, coalesce(o.seen, h.last) as last_observed_at,
      case when o.seen is null then 'unseen' when h.confidence is null then 'added' when h.confidence = 'inferred' then 'promoted' else 'confirmed' end as outcome
      from have h full join seen o on o.src_node_id = h.src_node_id and o.dst_node_id = h.dst_node_id)"""
_SYMBOL_NAME = r"coalesce(nullif(regexp_extract(key, '(?:`([^`]*)`|([^\s`/#.:!()\[\]]+))(?:\([^)]*\)\.|/|#|\.|:)$', 2), ''), regexp_extract(key, '(?:`([^`]*)`|([^\s`/#.:!()\[\]]+))(?:\([^)]*\)\.|/|#|\.|:)$', 1))"
_PROMOTED = f"""{_OBSERVED}, {_HITS.split(_ONCE + ',')[1].strip()},
  sy as (select node_id, {_SYMBOL_NAME} as name, regexp_extract(key, '`([^`]*)`', 1) as file from nodes where kind = 'symbol'),
  ch as (select code_function, code_filepath, max(start_unix_us) as last_us from s where code_function is not null group by 1, 2),
  cs as (select ch.code_function, ch.code_filepath, ch.last_us, min(sy.node_id) as node_id from ch left join sy on sy.name = code_function and (code_filepath is null or ends_with(file, code_filepath)) group by 1, 2, 3),
  ds as (select node_id, lower(regexp_extract(key, '^(.*?)://', 1)) as engine from nodes where kind = 'datastore'),
  dh as (select db_system, db_name, db_operation, service_name, max(start_unix_us) as last_us from s where db_system is not null group by 1, 2, 3, 4),
  dc as (select dh.*, (select count(*) from ds where engine = lower(db_system)) as n from dh),
  tc as (select node_id, make_timestamp(max(last_us)) as seen from (select node_id, last_us from hits union all select node_id, last_us from cs union all select ds.node_id, last_us from dh join ds on engine = lower(db_system)) where node_id is not null group by 1),
  e1 as (select e.src_node_id, e.dst_node_id, e.type, e.evidence_kind, case when o.outcome = 'promoted' and e.confidence = 'inferred' then 'observed' else e.confidence end as confidence, greatest(e.last_observed_at, a.seen, b.seen, o.last_observed_at) as last_observed_at
         from {EDGES_SQL} e left join tc a on a.node_id = e.src_node_id left join tc b on b.node_id = e.dst_node_id left join (select * from oc where outcome in ('promoted', 'confirmed')) o on o.src_node_id = e.src_node_id and o.dst_node_id = e.dst_node_id and o.type = e.type
         union all select src_node_id, dst_node_id, type, 'otel', 'observed', last_observed_at from oc where outcome = 'added')"""

ORACLE = {
    "span_dedupe": f"with {_ONCE} select trace_id, span_id, service_name, duration_us, status from s",
    "span_group_max": f"with {_ONCE} select service_name, http_route, http_method, max(start_unix_us) as last_us, count(*) as hits from s where http_route is not null group by 1, 2, 3",
    "client_parent_pairs": f"with {_NAMED}, {_PAIRS} select * from cp",
    "path_normalise": f"select distinct url_path, {_NORM.format('url_path')} as path from spans where url_path is not null",
    "template_match": f"with {_match('select service_name, http_method as method, url_path as path from spans where url_path is not null')} select * from mm where node_id is not null",
    "promote_routes": f"with {_HITS} select * from hits",
    "promotion_report": f"""with {_PROMOTED} select (select count(*) from hits where matched_by = 'route') as matched_routes, (select count(*) from hits where matched_by = 'template') as routes_by_template,
      (select count(*) from oc where outcome = 'promoted') as promoted, (select count(*) from oc where outcome = 'added') as added, (select count(node_id) from cs) as matched_symbols, (select cast(sum(n) as bigint) from dc) as matched_datastores,
      (select count(*) from e1 where evidence_kind in ('scip', 'treesitter') and (last_observed_at is null or last_observed_at < (select max(last_observed_at) from e1) - interval 30 day)) as possibly_dead,
      (select count(*) from hits where matched_by is null) + (select count(*) from rq where src_node_id is null or dst_node_id is null) + (select count(*) from cs where node_id is null) + (select count(*) from dc where n = 0) as unmatched""",
    "promoted_edges": f"with {_PROMOTED} select type, confidence, evidence_kind, count(*) as n, max(last_observed_at) as last, count(last_observed_at) as n_seen from e1 group by 1, 2, 3",
    "promote_edges": f"with {_OBSERVED} select * from oc",
    "route_errored_traces": f"""with {_ONCE}, b as (select distinct trace_id from s where status = 'error'),
      mp as (select distinct service_name, url_path, {_NORM.format('url_path')} as p from s where url_path is not null), mt as (select node_id, service_name as s2, {_NORM.format('url')} as t from routes),
      ft as (select distinct service_name, url_path, node_id from mp join mt on service_name = s2 where {_FITS}),
      x as (select r.node_id, s.trace_id, start_unix_us, http_status from s join routes r on r.service_name = s.service_name and r.url = s.http_route where s.trace_id in (select trace_id from b)
        union select ft.node_id, s.trace_id, start_unix_us, http_status from s join ft on ft.service_name = s.service_name and ft.url_path = s.url_path where s.trace_id in (select trace_id from b))
      select * from x qualify row_number() over (partition by node_id order by start_unix_us desc, trace_id, http_status nulls first) <= {ROUTE_TRACES}""",
    "touch_forward_only": f"""with {_HITS}, t as (select node_id, make_timestamp(max(last_us)) as seen from hits where node_id is not null group by 1)
      select e.edge_id, greatest(e.last_observed_at, a.seen, b.seen) as last_observed_at from {EDGES_SQL} e left join t a on a.node_id = e.src_node_id left join t b on b.node_id = e.dst_node_id""",
    "errored_traces_topk": f"""with {_ONCE} select distinct trace_id, start_unix_us, status from s where coalesce(parent_span_id, '') = '' and trace_id in (select trace_id from s where status = 'error')
      order by start_unix_us desc, trace_id, status limit {ERRORED_LIMIT}""",
    "trace_root_cause": """with recursive n as (select trace_id t, span_id s, arg_min(nullif(parent_span_id, ''), received_at) p, arg_min(status, received_at) st, arg_min(start_unix_us, received_at) us from spans group by 1, 2),
      up as (select n.*, q.s as parent from n left join n q on q.t = n.t and q.s = n.p),
      w as (select t, s, st, us, case when p is null then 0 else 1 end as depth, s as chain from up where parent is null
            union all select u.t, u.s, u.st, u.us, w.depth + 1, u.s || '>' || w.chain from w join up u on u.t = w.t and u.parent = w.s),
      lost as (select t, s, st, us, -1 as depth, s as chain from up where not exists (select 1 from w where w.t = up.t and w.s = up.s)),
      e as (select * from w where st = 'error' union all select * from lost where st = 'error')
      select t as trace_id, s as origin_span, depth, chain from e qualify row_number() over (partition by t order by depth desc, us, s) = 1""",
    "tail_sample": f"""with {_ONCE}, b as (select trace_id, bool_or(status = 'error') as bad from s group by 1),
      k as (select trace_id from b where bad or list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(trace_id, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 10000 / 10000.0 < {SAMPLE_RATE})
      select trace_id, span_id, status from s where trace_id in (select trace_id from k)""",
    "window_tumbling": f"""with {_ONCE} select time_bucket(interval 6 hours, make_timestamp(start_unix_us), timestamp '1970-01-01') as window_start, service_name, http_route, count(*) as n_spans, count(*) filter (where status = 'error') as n_errors, cast(sum(duration_us) as bigint) as duration_us from s group by 1, 2, 3""",
    "window_sliding": f"""with {_ONCE}, b as (select time_bucket(interval 6 hours, make_timestamp(start_unix_us), timestamp '1970-01-01') as b from s)
      select b - k * interval 6 hours as window_start, count(*) as n_spans from b, (select unnest([0, 1, 2, 3]) as k) group by 1""",
    "window_session": f"""with {_ONCE}, t as (select service_name, make_timestamp(start_unix_us) as ts from s),
      g as (select *, case when ts > lag(ts) over (partition by service_name order by ts) + interval 10 minutes then 1 else 0 end as cut from t),
      n as (select *, sum(cut) over (partition by service_name order by ts rows unbounded preceding) as k from g)
      select service_name, min(ts) as session_start, max(ts) + interval 10 minutes as session_end, count(*) as n_spans from n group by service_name, k""",
    "ordered_chain": f"""with {_CHAIN} select route_node_id, string_agg(concat_ws(':', position, phase, coalesce(name, '?')), '>' order by phase = 'handler_inline', position, phase, coalesce(name, '?')) as chain from ch group by 1""",
    "read_chain": f"""with {_CHAIN} select route_node_id, position, phase, name, check_kind, case when evidence_kind = 'boot' then 'boot' else 'inline' end as channel, confidence, n.key as symbol from ch left join nodes n on n.node_id = ch.symbol_node_id""",
    "coverage_matrix": f"""with {_CHAIN} select r.node_id as route_node_id, """
    + ", ".join(f"coalesce(string_agg(distinct case when evidence_kind = 'boot' then 'boot' else 'inline' end, '+' order by case when evidence_kind = 'boot' then 'boot' else 'inline' end) filter (where check_kind = '{k}'), '') as {k}" for k in ("auth", "tenant", "rbac", "ratelimit"))
    + ", count(check_kind) as n_checks from routes r left join ch on ch.route_node_id = r.node_id and check_kind is not null group by 1",
    "coverage_rollup": f"with {_CHAIN} select check_kind, phase, count(*) as n, count(distinct route_node_id) as n_routes from ch where check_kind is not null group by rollup (check_kind, phase)",
    "check_kind_lookup": f"with {_CHAIN} select ch.check_kind, r.check_kind as rule_kind, count(*) as n from ch left join check_rules r on r.helper = ch.name where ch.name is not null group by 1, 2",
    "blind_spots": f"with {_CHAIN} select n.key as route_key, phase, position, ch.key as entry_key from ch join nodes n on n.node_id = ch.route_node_id where symbol_node_id is null and origin not in ('framework', 'handler')",
    "write_span_join": f"with {_CHAIN}, {_WRITE_LINES.replace('coalesce(end_line, line) as high', f'coalesce(end_line, line) + {LONGER} as high')} select * from wl",
    "security_path": f"with recursive {_SECURITY} select * from sec",
    "write_without_check": f"with recursive {_SECURITY} select route_node_id, service_name, n_writes, kinds from sec where writes_without_tenant",
    "route_listing": f"""with {_CHAIN}, k as (select route_node_id, coalesce(string_agg(distinct check_kind, ',' order by check_kind), '') as checks, count(*) as n_entries from ch group by 1)
      select node_id, service_name, method, url, has_schema, coalesce(checks, '') as checks, coalesce(n_entries, 0) as n_entries from routes left join k on route_node_id = node_id""",
    "error_surface": f"with recursive {_SURFACE} select * from surf",
    "error_correlation": f"""with recursive {_ONCE}, {_SURFACE},
      o as (select service_name, http_route as url, count(*) as n_errors, count(distinct trace_id) as n_traces from s where status = 'error' and http_route is not null group by 1, 2),
      st as (select service_name, url, cast(coalesce(sum(error_exits + throws), 0) as bigint) as n_static from routes left join surf on surf.route_node_id = node_id group by 1, 2)
      select coalesce(o.service_name, st.service_name) as service_name, coalesce(o.url, st.url) as url, n_errors, n_traces, n_static from o full join st on st.service_name = o.service_name and st.url = o.url""",
}

ORACLE["stream_windows"] = f"select * from ({ORACLE['window_tumbling']}) where window_start + interval 6 hours <= (select make_timestamp(max(start_unix_us)) from spans) - interval 1 hour"
ORACLE["stream_tail_sample"] = ORACLE["tail_sample"]
