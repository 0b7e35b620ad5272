"""Facts of one repository as rows of the store's tables: symbols, calls, routes, inline checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.extract import frames
from spanloom.functions import keys as K
from spanloom.functions import symbols as S
from spanloom.operators.intervals import innermost
from spanloom.schema import TABLES
from spanloom.sources.boot import expand_chain
from spanloom.sources.scip import definitions


@dataclass
class Run:
    """Who writes: the run, its repository and the packages that are its own."""

    run_id: int
    repo_id: int
    repo: str
    service: str

    @property
    def packages(self) -> list[str]:
        return sorted({self.repo, self.service})


def shaped(table: str, rows: DataFrame) -> DataFrame:
    """``rows`` with exactly the columns of ``table``; those it lacks are null."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].schema))


def node(kind: str, key: Column) -> Column:
    return K.node_id(F.lit(kind), key)


def _edge_rows(rows: DataFrame, run: Run) -> DataFrame:
    """Edges with an id of their identity, so that a second run finds the same ones."""
    identity = F.xxhash64("src_node_id", "dst_node_id", "type", "evidence_kind", F.coalesce("file_id", F.lit(-1).cast("long")), F.coalesce("line", F.lit(-1)))
    return shaped("edges", rows.withColumn("edge_id", identity).withColumn("run_id", F.lit(run.run_id)))


def _nodes(rows: DataFrame, kind: str, key: str, run: Run | None) -> DataFrame:
    """Node rows of distinct keys; nodes that belong to no repository have no run."""
    distinct = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    return shaped("nodes", distinct.select(node(kind, F.col("key")).alias("node_id"), F.lit(kind).alias("kind"), "key", F.lit(run.repo_id if run else None).alias("repo_id")))


def symbol_facts(index: DataFrame, files: DataFrame, run: Run) -> dict[str, DataFrame]:
    """nodes and symbols of every definition; the first documentation line stands in for a signature."""
    docs = index.select("path", F.explode("symbols").alias("s")).select(F.col("s.symbol").alias("symbol"), F.nullif("s.display_name", F.lit("")).alias("_display"), F.nullif("s.enclosing_symbol", F.lit("")).alias("_outer"), F.col("s.documentation").alias("_docs"))
    docs = docs.groupBy("symbol").agg(F.first("_display", True).alias("_display"), F.first("_outer", True).alias("_outer"), F.first("_docs", True).alias("_docs"))
    at = definitions(index).groupBy("symbol").agg(F.min(F.struct("path", "start_line", "end_line")).alias("_at")).select("symbol", "_at.*")
    rows = at.join(docs, "symbol", "left").join(files.select("path", "file_id"), "path", "left")
    key = F.col("symbol")
    table = rows.select(node("symbol", key).alias("node_id"), "file_id", F.coalesce("_display", S.display_name(key)).alias("display_name"), S.symbol_kind(key).alias("symbol_kind"), F.get("_docs", F.lit(0)).alias("signature"), F.array_join(F.slice("_docs", 2, 1000), "\n").alias("doc"), "start_line", "end_line", F.when(F.col("_outer").isNotNull(), node("symbol", F.col("_outer"))).alias("enclosing_node_id"), F.col("path").rlike(r"(^|/)tests?/|[._]test\.").alias("is_test"))
    return {"nodes": _nodes(rows, "symbol", "symbol", run), "symbols": shaped("symbols", table)}


def call_facts(calls: DataFrame, files: DataFrame, run: Run) -> dict[str, DataFrame]:
    """nodes and edges of derived calls.

    A call into a package that is not one of the run's own goes to the package's node, by
    CALLS_EXTERNAL; a name in no package stays what the calls made of it.
    """
    package = S.package_of(F.col("dst_symbol"))
    head = r"^(\S+) (\S+) (\S+) (\S+) (.*)$"
    part = lambda i: F.regexp_extract("dst_symbol", head, i)
    rows = calls.join(files.select("path", "file_id"), "path", "left").withColumn("_far", (package != "") & ~package.isin(*run.packages) & (F.col("confidence") != "certain"))
    rows = rows.withColumn("_package", F.when(F.col("_far"), K.package_key(part(2), part(3), F.when(part(4) != ".", part(4)))))
    src = F.when(F.col("src_symbol") == F.col("path"), node("file", K.file_key(F.lit(run.repo), F.col("path")))).otherwise(node("symbol", F.col("src_symbol")))
    dst = F.when(F.col("_far"), node("external", F.col("_package"))).otherwise(node("symbol", F.col("dst_symbol")))
    edges = rows.select(src.alias("src_node_id"), dst.alias("dst_node_id"), F.when(F.col("_far"), "CALLS_EXTERNAL").otherwise("CALLS").alias("type"), "confidence", F.lit("scip").alias("evidence_kind"), "file_id", "line", F.when(F.col("_far"), F.col("dst_symbol")).alias("detail"))
    own = rows.filter("src_symbol <> path").select(F.col("src_symbol").alias("symbol")).unionByName(rows.filter("not _far").select(F.col("dst_symbol").alias("symbol")))
    return {"nodes": _nodes(own, "symbol", "symbol", run).unionByName(_nodes(rows, "external", "_package", None)), "edges": _edge_rows(edges.dropDuplicates(["src_node_id", "dst_node_id", "type", "file_id", "line"]), run)}


def route_facts(routes: DataFrame, index: DataFrame | None, files: DataFrame, run: Run) -> dict[str, DataFrame]:
    """nodes, routes, route_chain and edges of a boot dump (rows of ``read_boot``).

    A service CONTAINS its routes, a route HANDLES by every step of its chain that the index
    has a symbol for; steps of the framework itself are joined to none.
    """
    route_id = node("route", F.col("route_key"))
    steps = expand_chain(routes).join(files.select(F.col("path").alias("file"), "file_id"), "file", "left")
    if index is not None:
        bodies = definitions(index).select("path", "symbol", "start_line", "end_line")
        points = steps.filter("origin <> 'framework' and line is not null").select(F.col("file").alias("path"), F.col("file").alias("at_file"), F.col("line").alias("at_line"), "line").distinct()
        found = innermost(points, bodies, "path", ["at_file", "at_line"], "line", "symbol", "start_line", "end_line")
        steps = steps.join(found, (F.col("file") == F.col("at_file")) & (F.col("line") == F.col("at_line")) & (F.col("origin") != "framework"), "left").drop("at_file", "at_line")
    else:
        steps = steps.withColumn("symbol", F.lit(None).cast("string"))
    symbol = F.when(F.col("symbol").isNotNull(), node("symbol", F.col("symbol")))
    chain = steps.select(route_id.alias("route_node_id"), "position", "phase", symbol.alias("symbol_node_id"), "key", "name", "origin", "inherited_from", F.lit("certain").alias("confidence"), F.lit("boot").alias("evidence_kind"), "file_id", "line", "end_line", "detail", F.lit(run.run_id).alias("run_id"))
    handler = steps.filter("phase = 'handler'").groupBy("route_key").agg(F.max_by(symbol, "position").alias("handler_node_id"))
    table = routes.join(handler, "route_key", "left").select(route_id.alias("node_id"), F.lit(run.repo_id).alias("repo_id"), F.col("service").alias("service_name"), "method", "url", "prefix", "handler_node_id", "has_schema", F.lit("boot").alias("source"), F.lit(run.run_id).alias("run_id"))
    contains = routes.select(node("service", F.col("service")).alias("src_node_id"), route_id.alias("dst_node_id"), F.lit("CONTAINS").alias("type"), F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("detail"))
    handles = steps.filter("symbol is not null").select(route_id.alias("src_node_id"), symbol.alias("dst_node_id"), F.lit("HANDLES").alias("type"), "file_id", "line", "detail")
    edges = contains.unionByName(handles).withColumn("confidence", F.lit("certain")).withColumn("evidence_kind", F.lit("boot")).dropDuplicates(["src_node_id", "dst_node_id", "type", "file_id", "line"])
    nodes = _nodes(routes, "route", "route_key", run).unionByName(_nodes(routes, "service", "service", run)).unionByName(_nodes(steps, "symbol", "symbol", run))
    return {"nodes": nodes, "routes": shaped("routes", table), "route_chain": shaped("route_chain", chain), "edges": _edge_rows(edges, run)}


def inline_facts(routes: DataFrame, sources: DataFrame, files: DataFrame, rules: dict[str, str], run: Run) -> DataFrame:
    """route_chain rows of the checks inside each route's handler, numbered in order of lines.

    The handler is the function around the line of the dump's handler step, else around the
    line after it. Only the first handler step of a route counts.
    """
    steps = expand_chain(routes).filter("phase = 'handler' and file is not null and line is not null")
    steps = steps.groupBy("route_key").agg(F.min(F.struct("position", "file", "line")).alias("_h")).select("route_key", F.col("_h.file").alias("path"), F.col("_h.line").alias("line"))
    bodies = frames.functions(sources).filter("problem is null").select("path", F.col("start_line").alias("function_line"), "start_line", "end_line")
    probes = steps.select("route_key", "path", F.explode(F.array(F.struct(F.lit(0).alias("after"), F.col("line").alias("at")), F.struct(F.lit(1).alias("after"), (F.col("line") + 1).alias("at")))).alias("p")).select("route_key", F.col("path").alias("in_path"), "path", "p.after", "p.at")
    met = innermost(probes, bodies, "path", ["route_key", "in_path", "after"], "at", "function_line", "start_line", "end_line")
    handler = met.groupBy("route_key").agg(F.min(F.struct("after", "function_line")).alias("_f"), F.first("in_path").alias("path")).select("route_key", "path", F.col("_f.function_line").alias("function_line"))
    checks = frames.inline_checks(sources, rules).filter("problem is null")
    rows = handler.join(checks, ["path", "function_line"]).join(files.select("path", "file_id"), "path", "left")
    # As many rows per route as its handler has checks.
    ordered = rows.groupBy("route_key").agg(F.array_sort(F.collect_list(F.struct("line", "name", "check_kind", "detail", "path", "file_id"))).alias("_c")).select("route_key", F.posexplode("_c").alias("position", "c"))
    out = ordered.select(node("route", F.col("route_key")).alias("route_node_id"), "position", F.lit("handler_inline").alias("phase"), F.concat_ws(":", "c.path", "c.line").alias("key"), "c.name", "c.check_kind", F.lit("handler").alias("origin"), F.lit("inferred").alias("confidence"), F.lit("treesitter").alias("evidence_kind"), "c.file_id", "c.line", "c.detail", F.lit(run.run_id).alias("run_id"))
    return shaped("route_chain", out)
