"""One index run of a repository, in order: files, purge, index, findings, control flow, boot, inline checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.extract import frames, ingest
from spanloom.extract.calls import derive_calls
from spanloom.functions import keys as K
from spanloom.functions import symbols as S
from spanloom.operators import mutations as M
from spanloom.operators.cfg import block_of_edges
from spanloom.session import stage
from spanloom.sources.scip import definitions
from spanloom.store import Store

#: Findings that make an edge.
_KINDS = ["throw", "config", "sql"]


@dataclass
class Report:
    """What a run did; ``missing`` names the artifacts that were not there."""

    changes: dict[str, int]
    derived: list[str]
    rows: dict[str, int] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)

    @property
    def skipped(self) -> bool:
        return not self.derived


def index_repository(store: Store, run: ingest.Run, sources: DataFrame, index: DataFrame | None = None, boot: DataFrame | None = None, rules: dict[str, str] | None = None, error_builders: set[str] = frozenset(), has_routes: bool = True, force: bool = False) -> Report:
    """Bring the facts of one repository up to ``sources`` (path, lang, content_sha256, content), in one commit.

    Nothing touched and no ``force``: nothing is derived. Else the static facts of changed
    files go first, every fact of deleted ones, and all channels are derived again. A channel
    whose artifact is None derives nothing and is named as missing.
    """
    files = stage(sources.select(F.xxhash64(F.lit(run.repo), F.col("path")).alias("file_id"), F.lit(run.repo_id).alias("repo_id"), "path", "lang", "content_sha256", F.lit(run.run_id).alias("last_run_id")), "run-files")
    before = store.read("files").filter(F.col("repo_id") == run.repo_id)
    change = stage(M.diff_files(before, files, ["repo_id", "path"], "content_sha256"), "run-changes")
    counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
    steps = M.plan_derivations(sum(n for c, n in counts.items() if c != "unchanged"), force)
    report = Report(counts, steps)
    if not steps:
        return report
    base = store.snapshot
    tables = {t: store.read(t, base) for t in ("nodes", "symbols", "edges", "routes", "route_chain", "unresolved_calls", "function_cfg", "files")}
    ids = before.select("file_id", "repo_id", "path").join(change, ["repo_id", "path"])
    doomed = before.select("file_id") if force else ids.filter("change in ('changed', 'deleted')").select("file_id")
    tables = M.purge(tables, doomed)
    tables = M.forget_files(tables, ids.filter("change = 'deleted'")) | {"files": tables["files"]}
    others = tables["files"].filter(F.col("repo_id") != run.repo_id)
    tables["files"] = others.unionByName(ingest.shaped("files", files))
    found: dict[str, list[DataFrame]] = {}

    def add(**rows: DataFrame) -> None:
        for name, new in rows.items():
            found.setdefault(name, []).append(stage(new, f"run-{name}"))

    add(nodes=_file_nodes(files, run), edges=_contained_files(files, run))
    if index is not None:
        index = stage(index, "run-index")
        add(**ingest.symbol_facts(index, files, run))
        add(**ingest.call_facts(derive_calls(index, sources.select("path", "content"), run.packages)[0], files, run))
    else:
        report.missing.append("index")
    known = _bodies(index) if index is not None else store.spark.createDataFrame([], "path string, symbol string, symbol_kind string, start_line int, end_line int")
    add(**_finding_facts(frames.attribute(frames.findings(sources).filter("problem is null"), known), files, run))
    keyed, unkeyed = frames.key_blocks(frames.control_flow(sources, set(error_builders)), known)
    blocks = keyed.join(files.select("path", "file_id"), "path").withColumn("symbol_node_id", ingest.node("symbol", F.col("symbol"))).withColumn("run_id", F.lit(run.run_id))
    add(function_cfg=ingest.shaped("function_cfg", blocks))
    report.rows["unkeyed"] = unkeyed.count()
    if boot is not None:
        boot = stage(boot, "run-boot")
        add(**ingest.route_facts(boot, index, files, run))
        add(route_chain=ingest.inline_facts(boot, sources, files, rules or {}, run))
        routes = boot.select(ingest.node("route", F.col("route_key")).alias("route_node_id")).distinct()
        # Both channels of a route's chain are replaced wholesale: what is gone must not persist.
        tables["route_chain"] = tables["route_chain"].join(routes, "route_node_id", "left_anti")
    elif has_routes:
        report.missing.append("boot dump")
    for name, parts in found.items():
        new = parts[0]
        for part in parts[1:]:
            new = new.unionByName(part)
        report.rows[name] = new.count()
        merge = M.latest_wins if name in ("symbols", "routes") else M.first_wins
        keys = {"symbols": ["node_id"], "routes": ["node_id"]}.get(name) or list(M.TABLES[name].identity)
        tables[name] = M.replace_group(tables[name], new, ["symbol_node_id"]) if name == "function_cfg" else merge(tables[name], new, keys)
    # Calls say which block of their function they are in.
    blocks = stage(block_of_edges(tables["edges"], tables["function_cfg"]), "run-blocks")
    report.rows["attributed"] = blocks.count()
    tables["edges"] = tables["edges"].drop("cfg_block_index").join(blocks, "edge_id", "left").select(*tables["edges"].columns)
    store.commit(tables, base)
    return report


def _file_nodes(files: DataFrame, run: ingest.Run) -> DataFrame:
    key = K.file_key(F.lit(run.repo), F.col("path"))
    rows = files.select(ingest.node("file", key).alias("node_id"), F.lit("file").alias("kind"), key.alias("key"), "repo_id")
    service = files.limit(1).select(ingest.node("service", F.lit(run.service)).alias("node_id"), F.lit("service").alias("kind"), F.lit(run.service).alias("key"), "repo_id")
    return ingest.shaped("nodes", rows.unionByName(service))


def _contained_files(files: DataFrame, run: ingest.Run) -> DataFrame:
    rows = files.select(ingest.node("service", F.lit(run.service)).alias("src_node_id"), ingest.node("file", K.file_key(F.lit(run.repo), F.col("path"))).alias("dst_node_id"), F.lit("CONTAINS").alias("type"), F.lit("certain").alias("confidence"), F.lit("manual").alias("evidence_kind"), "file_id", F.lit(None).cast("int").alias("line"))
    return ingest._edge_rows(rows, run)


def _bodies(index: DataFrame) -> DataFrame:
    return stage(definitions(index).withColumn("symbol_kind", S.symbol_kind(F.col("symbol"))).select("path", "symbol", "symbol_kind", "start_line", "end_line"), "run-bodies")


def _finding_facts(found: DataFrame, files: DataFrame, run: ingest.Run) -> dict[str, DataFrame]:
    """THROWS, READS_CONFIG, READS and WRITES edges from whatever owns the line of a finding."""
    rows = found.filter(F.col("kind").isin(*_KINDS)).join(files.select("path", "file_id"), "path")
    key = F.when(F.col("kind") == "throw", K.error_key(F.col("name"))).when(F.col("kind") == "config", K.config_key(F.col("name"))).otherwise(K.datastore_key(F.lit("postgres"), F.lit(None).cast("string"), F.col("name")))
    kind = F.when(F.col("kind") == "throw", "external").when(F.col("kind") == "config", "config").otherwise("datastore")
    type_ = F.when(F.col("kind") == "throw", "THROWS").when(F.col("kind") == "config", "READS_CONFIG").when(F.col("detail").endswith("write"), "WRITES").otherwise("READS")
    rows = rows.withColumn("_key", key).withColumn("_kind", kind).withColumn("_type", type_).filter("_key is not null")
    owner = F.when(F.col("owner_kind") == "symbol", ingest.node("symbol", F.col("owner"))).otherwise(ingest.node("file", K.file_key(F.lit(run.repo), F.col("path"))))
    edges = rows.select(owner.alias("src_node_id"), K.node_id(F.col("_kind"), F.col("_key")).alias("dst_node_id"), F.col("_type").alias("type"), F.lit("inferred").alias("confidence"), F.lit("treesitter").alias("evidence_kind"), "file_id", "line", "detail").dropDuplicates(["src_node_id", "dst_node_id", "type", "file_id", "line"])
    nodes = rows.select(K.node_id(F.col("_kind"), F.col("_key")).alias("node_id"), F.col("_kind").alias("kind"), F.col("_key").alias("key"), F.lit(None).cast("long").alias("repo_id")).distinct()
    return {"nodes": ingest.shaped("nodes", nodes), "edges": ingest._edge_rows(edges, run)}
