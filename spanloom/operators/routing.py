"""Joining what was seen at runtime with what is declared: templates, addresses, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.functions.text import is_wildcard, normalise_path
from spanloom.session import stage

# Hosts that name this machine.
LOOPBACK = ["localhost", "127.0.0.1", "::1", "0.0.0.0"]
#: Columns of spans that client pairs and route hits are made from.
PAIR_COLUMNS = ["parent_span_id", "service_name", "kind", "http_route", "http_method", "server_address", "server_port", "start_unix_us"]
HIT_COLUMNS = ["service_name", "kind", "http_route", "url_path", "http_method", "start_unix_us"]


def fitting_templates(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """(service_name, method, path, node_id, exact) of every template that a concrete path fits.

    ``paths`` has service_name, method (null: any) and path; ``routes`` has node_id,
    service_name, method and url. Candidates meet on service, number of segments, and first
    segment: a template that begins with a wildcard is met by the empty string, which every
    path is laid out under as well.
    """
    keyed = paths.select("service_name", "method", "path").distinct().withColumn("_p", normalise_path(F.col("path"))).withColumn("_a", F.split("_p", "/")).withColumn("_n", F.size("_a"))
    # Segment 1, as paths begin with a slash; both keys of a path differ, so no template meets it twice.
    keyed = keyed.withColumn("_head", F.explode(F.array_distinct(F.array(_segment("_a"), F.lit("")))))
    templates = routes.select("node_id", F.col("service_name").alias("_service"), F.col("method").alias("_method"), normalise_path(F.col("url")).alias("_t")).withColumn("_b", F.split("_t", "/")).withColumn("_m", F.size("_b"))
    templates = templates.withColumn("_head_t", F.when(is_wildcard(_segment("_b")), F.lit("")).otherwise(_segment("_b")))
    met = keyed.join(templates, (F.col("service_name") == F.col("_service")) & (F.col("_n") == F.col("_m")) & (F.col("_head") == F.col("_head_t")) & (F.col("method").isNull() | (F.col("method") == F.col("_method"))))
    fits = F.forall(F.zip_with("_a", "_b", lambda a, b: is_wildcard(b) | (a == b)), lambda x: x)
    return met.filter(fits).select("service_name", "method", "path", "node_id", (F.col("_p") == F.col("_t")).cast("int").alias("exact"))


def match_templates(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """(service_name, method, path, node_id) of concrete paths that mean exactly one route.

    A template equal to the path wins if it is the only one; otherwise a path counts only if
    exactly one template fits.
    """
    found = fitting_templates(paths, routes).groupBy("service_name", "method", "path").agg(F.count("*").alias("_fit"), F.sum("exact").alias("_exact"), F.min("node_id").alias("_any"), F.min(F.when(F.col("exact") == 1, F.col("node_id"))).alias("_same"))
    pick = F.when(F.col("_exact") == 1, F.col("_same")).when(F.col("_fit") == 1, F.col("_any"))
    return found.select("service_name", "method", "path", pick.alias("node_id")).filter("node_id is not null")


def errored_traces_of_routes(spans: DataFrame, routes: DataFrame, limit: int) -> DataFrame:
    """(node_id, trace_id, start_unix_us, http_status): the newest errored traces that touch each route.

    A span touches a route of its service by http_route, or by a concrete path that fits the
    route's template, as http_route is not always there. ``spans`` are deduplicated; of one
    trace every start counts.
    """
    bad = spans.filter("status = 'error'").select("trace_id").distinct()
    seen = spans.join(bad, "trace_id", "left_semi").select("trace_id", "service_name", "http_route", "url_path", "start_unix_us", "http_status")
    named = routes.select("node_id", "service_name", F.col("url").alias("http_route"))
    by_route = seen.join(named, ["service_name", "http_route"])
    paths = spans.filter("url_path is not null").select("service_name", F.lit(None).cast("string").alias("method"), F.col("url_path").alias("path"))
    fitting = fitting_templates(paths, routes).select("service_name", F.col("path").alias("url_path"), "node_id").distinct()
    by_path = seen.join(fitting, ["service_name", "url_path"])
    rows = [x.select("node_id", "trace_id", "start_unix_us", "http_status") for x in (by_route, by_path)]
    # The literal limit lets every task cut its rows to it before the shuffle.
    order = Window.partitionBy("node_id").orderBy(F.desc("start_unix_us"), "trace_id", F.asc_nulls_first("http_status"))
    return rows[0].unionByName(rows[1]).distinct().withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= limit).drop("_at")


def _segment(parts: str) -> F.Column:
    return F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def service_at(addresses: DataFrame, services: DataFrame, ports: DataFrame) -> DataFrame:
    """``addresses`` (server_address, server_port) with callee_service, null if unknown.

    ``services`` has (host, service); ``ports`` has (port, service) for loopback addresses.
    """
    host = F.regexp_replace(F.regexp_replace(F.col("server_address"), "^https?://", ""), "/.*$", "")
    rows = addresses.withColumn("_host", F.split_part(host, F.lit(":"), F.lit(1))).withColumn("_port", F.coalesce(F.regexp_extract(host, r":(\d+)$", 1).try_cast("int"), F.col("server_port")))
    named = rows.join(services.select(F.col("host").alias("_host"), F.col("service").alias("_by_name")), "_host", "left")
    local = named.join(ports.select(F.col("port").alias("_port"), F.col("service").alias("_by_port")), "_port", "left")
    return local.withColumn("callee_service", F.coalesce("_by_name", F.when(F.col("_host").isin(*LOOPBACK), F.col("_by_port")))).drop("_host", "_port", "_by_name", "_by_port")


def route_hits(spans: DataFrame, routes: DataFrame) -> DataFrame:
    """Server traffic joined to routes: (service_name, http_route, url_path, http_method, last_us, hits, node_id, matched_by).

    The template on the span is the join where there is one; else the concrete path is
    matched against templates. matched_by is ``route``, ``template`` or null (unmatched).
    """
    seen = spans.filter("(http_route is not null or url_path is not null) and (kind is null or kind = 'server')")
    groups = seen.groupBy("service_name", "http_route", "url_path", "http_method").agg(F.max("start_unix_us").alias("last_us"), F.count("*").alias("hits"))
    exact = routes.groupBy(F.col("service_name").alias("_s"), F.col("url").alias("_u"), F.col("method").alias("_m")).agg(F.min("node_id").alias("_exact"))
    any_method = routes.groupBy(F.col("service_name").alias("_s2"), F.col("url").alias("_u2")).agg(F.min("node_id").alias("_any"))
    g = groups.join(exact, (F.col("service_name") == F.col("_s")) & (F.col("http_route") == F.col("_u")) & (F.col("http_method") == F.col("_m")), "left")
    g = g.join(any_method, (F.col("service_name") == F.col("_s2")) & (F.col("http_route") == F.col("_u2")) & F.col("http_method").isNull(), "left")
    g = g.withColumn("_direct", F.coalesce("_exact", "_any"))
    fallback = match_templates(g.filter("_direct is null and url_path is not null").select("service_name", F.col("http_method").alias("method"), F.col("url_path").alias("path")), routes)
    fallback = fallback.select(F.col("service_name").alias("_fs"), F.col("method").alias("_fm"), F.col("path").alias("_fp"), F.col("node_id").alias("_template"))
    out = g.join(fallback, (F.col("service_name") == F.col("_fs")) & F.col("http_method").eqNullSafe(F.col("_fm")) & (F.col("url_path") == F.col("_fp")) & F.col("_direct").isNull(), "left")
    return out.select(
        "service_name", "http_route", "url_path", "http_method", "last_us", "hits", F.coalesce("_direct", "_template").alias("node_id"), F.when(F.col("_direct").isNotNull(), "route").when(F.col("_template").isNotNull(), "template").alias("matched_by")
    )


def client_pairs(spans: DataFrame) -> DataFrame:
    """Calls from client spans with the route of the span above them, grouped."""
    child = spans.filter("kind = 'client' and http_route is not null")
    parent = spans.groupBy(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s")).agg(F.min("http_route").alias("caller_route"), F.min("service_name").alias("parent_service"))
    joined = child.join(parent, (F.col("trace_id") == F.col("_t")) & (F.col("parent_span_id") == F.col("_s")), "left")
    keys = ["service_name", "http_route", "http_method", "server_address", "server_port", "caller_route", "parent_service"]
    return joined.groupBy(*keys).agg(F.max("start_unix_us").alias("last_us"), F.count("*").alias("calls"))


def touch_forward_only(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """``edges`` with last_observed_at moved forward, never back, by (node_id, seen_at) rows."""
    last = touched.groupBy("node_id").agg(F.max("seen_at").alias("_seen"))
    a = last.select(F.col("node_id").alias("src_node_id"), F.col("_seen").alias("_a"))
    b = last.select(F.col("node_id").alias("dst_node_id"), F.col("_seen").alias("_b"))
    return edges.join(a, "src_node_id", "left").join(b, "dst_node_id", "left").withColumn("last_observed_at", F.greatest("last_observed_at", "_a", "_b")).select(*edges.columns)


def confirm_edges(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed (src_node_id, dst_node_id, type, seen_at) against the edges that exist.

    Returns src_node_id, dst_node_id, type, confidence, evidence_kind, last_observed_at and
    outcome: an inferred edge is ``promoted`` to observed, any other is ``confirmed`` as it
    is, a missing one is ``added`` as observed by otel, the rest are ``unseen``. Of several
    evidences of one edge the surest stands for it. Nothing is downgraded or removed.
    """
    from spanloom.functions.confidence import rank

    keys = ["src_node_id", "dst_node_id", "type"]
    have = edges.groupBy(*keys).agg(F.max_by(F.struct("confidence", "evidence_kind"), F.struct(rank(F.col("confidence")), F.col("evidence_kind"))).alias("_e"), F.max("last_observed_at").alias("_last"))
    seen = observed.groupBy(*keys).agg(F.max("seen_at").alias("_seen"))
    both = have.join(seen, keys, "full")
    outcome = F.when(F.col("_seen").isNull(), "unseen").when(F.col("_e").isNull(), "added").when(F.col("_e.confidence") == "inferred", "promoted").otherwise("confirmed")
    return both.select(
        *keys, F.when(outcome.isin("added", "promoted"), "observed").otherwise(F.col("_e.confidence")).alias("confidence"), F.coalesce("_e.evidence_kind", F.lit("otel")).alias("evidence_kind"), F.coalesce("_seen", "_last").alias("last_observed_at"), outcome.alias("outcome")
    )


def request_calls(spans: DataFrame, routes: DataFrame, hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Client calls, grouped, with src_node_id and dst_node_id: null where a side is no known route.

    The address names the callee's service, the parent span the caller's route; without a
    method the call is a GET.
    """
    pairs = service_at(client_pairs(spans), hosts, ports)
    callee = routes.groupBy(F.col("service_name").alias("callee_service"), F.col("url").alias("http_route"), F.col("method").alias("_m")).agg(F.min("node_id").alias("dst_node_id"))
    caller = routes.groupBy(F.col("service_name").alias("parent_service"), F.col("url").alias("caller_route")).agg(F.min("node_id").alias("src_node_id"))
    return pairs.withColumn("_m", F.coalesce("http_method", F.lit("GET"))).join(callee, ["callee_service", "http_route", "_m"], "left").join(caller, ["parent_service", "caller_route"], "left").drop("_m")


def symbol_hits(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code_function, code_filepath, last_us, node_id): functions that ran, and the symbol they name.

    A symbol is named by its display name; a path on the span must be its file or a suffix of
    it. Of several the smallest id stands; null where none fits.
    """
    hits = spans.filter("code_function is not null").groupBy("code_function", "code_filepath").agg(F.max("start_unix_us").alias("last_us"))
    file = F.try_element_at(S.descriptors(F.col("key")), F.lit(1))["name"]
    symbols = nodes.filter("kind = 'symbol'").select(F.col("node_id").alias("_id"), S.display_name(F.col("key")).alias("_name"), file.alias("_file"))
    met = hits.join(symbols, F.col("code_function") == F.col("_name"), "left").withColumn("_id", F.when(F.col("code_filepath").isNull() | F.col("_file").endswith(F.col("code_filepath")), F.col("_id")))
    return met.groupBy("code_function", "code_filepath").agg(F.max("last_us").alias("last_us"), F.min("_id").alias("node_id"))


def datastore_hits(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(db_system, db_name, db_operation, service_name, last_us, node_ids): all datastores of the engine seen."""
    hits = spans.filter("db_system is not null").groupBy("db_system", "db_name", "db_operation", "service_name").agg(F.max("start_unix_us").alias("last_us"))
    engine = F.lower(F.regexp_extract("key", "^(.*?)://", 1))
    stores = nodes.filter("kind = 'datastore'").groupBy(engine.alias("_engine")).agg(F.collect_list("node_id").alias("node_ids"))
    return hits.join(stores, F.lower("db_system") == F.col("_engine"), "left").drop("_engine")


def promote(spans: DataFrame, routes: DataFrame, nodes: DataFrame, edges: DataFrame, hosts: DataFrame, ports: DataFrame, dead_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(edges after promotion, report of one row): everything runtime confirms, in one answer.

    Routes by template or path, calls between services, functions and datastores that ran move
    last_observed_at forward on the edges at them; calls that were inferred become observed,
    calls nobody knew are added. The report counts each, what matched nothing, and static
    edges not seen for ``dead_days`` before the last sight of any.
    """
    from spanloom.operators.graph import edges_once

    # Each is read for the edges and for the report.
    by_route, by_call = stage(route_hits(spans, routes), "route-hits"), stage(request_calls(spans, routes, hosts, ports), "request-calls")
    by_symbol, by_store = stage(symbol_hits(spans, nodes), "symbol-hits"), stage(datastore_hits(spans, nodes), "datastore-hits")
    when = F.timestamp_micros("last_us").cast("timestamp_ntz").alias("seen_at")
    touched = by_route.select("node_id", when).unionByName(by_symbol.select("node_id", when)).filter("node_id is not null").unionByName(by_store.filter("node_ids is not null").select(F.explode("node_ids").alias("node_id"), when))
    once = edges_once(edges, "edge_id", "confidence", "last_observed_at")
    known = by_call.filter("src_node_id is not null and dst_node_id is not null").select("src_node_id", "dst_node_id", F.lit("REQUESTS").alias("type"), when)
    outcome = stage(confirm_edges(once.filter("type = 'REQUESTS'"), known).filter("outcome <> 'unseen'"), "confirmed-edges")
    seen = outcome.select("src_node_id", "dst_node_id", "type", "outcome", F.col("last_observed_at").alias("_seen"))
    after = touch_forward_only(once, touched).join(seen.filter("outcome <> 'added'"), ["src_node_id", "dst_node_id", "type"], "left")
    after = after.withColumn("confidence", F.when((F.col("outcome") == "promoted") & (F.col("confidence") == "inferred"), "observed").otherwise(F.col("confidence"))).withColumn("last_observed_at", F.greatest("last_observed_at", "_seen")).select(*once.columns)
    added = seen.filter("outcome = 'added'").select(*(F.lit("observed").alias(c) if c == "confidence" else F.lit("otel").alias(c) if c == "evidence_kind" else F.col("_seen").alias(c) if c == "last_observed_at" else F.col(c) if c in ("src_node_id", "dst_node_id", "type") else F.lit(None).cast(once.schema[c].dataType).alias(c) for c in once.columns))
    after = after.unionByName(added)
    lost = F.count_if(F.col("node_id").isNull()).alias("unmatched")
    n_routes = by_route.agg(F.count_if(F.col("matched_by") == "route").alias("matched_routes"), F.count_if(F.col("matched_by") == "template").alias("routes_by_template"), F.count_if(F.col("matched_by").isNull()).alias("u1"))
    n_calls = by_call.agg(F.count_if(F.col("src_node_id").isNull() | F.col("dst_node_id").isNull()).alias("u2"))
    n_edges = outcome.agg(F.count_if(F.col("outcome") == "promoted").alias("promoted"), F.count_if(F.col("outcome") == "added").alias("added"))
    n_symbols = by_symbol.agg(F.count("node_id").alias("matched_symbols"), lost.alias("u3"))
    n_stores = by_store.agg(F.coalesce(F.sum(F.greatest(F.size("node_ids"), F.lit(0))), F.lit(0)).alias("matched_datastores"), F.count_if(F.col("node_ids").isNull()).alias("u4"))
    last = after.agg(F.max("last_observed_at").alias("_as_of"))
    static = after.filter("evidence_kind in ('scip', 'treesitter')")
    dead = static.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("last_observed_at").isNull() | (F.col("last_observed_at") < F.col("_as_of") - F.make_dt_interval(F.lit(dead_days)))).alias("possibly_dead"))
    report = n_routes
    for one in (n_calls, n_edges, n_symbols, n_stores, dead):  # one row each
        report = report.crossJoin(one)
    return after, report.withColumn("unmatched", F.col("u1") + F.col("u2") + F.col("u3") + F.col("u4")).drop("u1", "u2", "u3", "u4")
