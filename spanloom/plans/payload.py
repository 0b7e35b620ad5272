"""The picture of a route as data: nodes in lanes, links, control flow, unknowns, and what the signs mean."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.functions.confidence import name_of, rank
from spanloom.plans.engine import Answer

#: Travels with the picture, so that nobody has to be told apart what a dash means.
LEGEND = {
    "line": {"certain": "drawn through: resolved by the compiler or framework", "observed": "bold: seen in a trace", "inferred": "dashed: concluded from source text", "unresolved": "dotted: known to be there, target unknown"},
    "colour": {"success": "green: this way ends well", "error_exit": "red: this way ends in an error", "unknown": "grey: cannot be told, which is not success"},
    "badge": {"boot": "filled: the framework named the check", "inline": "hollow: the check was read in the handler"},
}


def graph_payload(answer: Answer, nodes: DataFrame, symbols: DataFrame, files: DataFrame, cfg: DataFrame) -> dict[str, DataFrame]:
    """Tables nodes, links, lanes, cfg and unknowns of an endpoint flow.

    Each node and link is there once, a link as sure as its surest sight, with the weakest
    sign of the surest way to it. lanes are services in the order a walk first enters them.
    """
    steps, chain = answer["steps"], answer["chain"]
    badge = F.when(F.col("evidence_kind") == "boot", "boot").otherwise("inline")
    entry = chain.filter("symbol_node_id is not null").groupBy(F.col("symbol_node_id").alias("node_id")).agg(F.min(F.struct("position", "phase", "check_kind", badge.alias("channel"), "confidence", "detail")).alias("chain"))
    outcome = F.when(F.max((F.col("outcome") == "error_exit").cast("int")) == 1, "error_exit").when(F.max((F.col("outcome") == "success").cast("int")) == 1, "success").otherwise("unknown")
    ends = cfg.filter("kind = 'exit'").groupBy(F.col("symbol_node_id").alias("node_id")).agg(outcome.alias("outcome"))
    at = symbols.select("node_id", "file_id", F.col("start_line").alias("line")).join(files.select("file_id", F.col("path").alias("file")), "file_id", "left").drop("file_id")
    service = F.when(F.col("kind") == "symbol", S.package_of(F.col("key"))).when(F.col("kind") == "route", F.split_part("key", F.lit(" "), F.lit(1)))
    label = F.when(F.col("kind") == "symbol", S.display_name(F.col("key"))).otherwise(F.col("key"))
    seen = steps.groupBy("node_id", "kind", "key").agg(F.min("depth").alias("depth"), F.min(F.struct("position", "depth")).alias("_first"), F.max("cycle").alias("cycle"), F.max("truncated").alias("truncated"))
    shown = seen.join(entry, "node_id", "left").join(ends, "node_id", "left").join(at, "node_id", "left").withColumn("service", F.nullif(service, F.lit(""))).withColumn("label", label)
    lanes = shown.filter("service is not null").groupBy("service").agg(F.min("_first").alias("first")).orderBy("first", "service")
    hop = steps.filter("depth > 0").select(F.element_at("path", -2).alias("source"), F.col("node_id").alias("target"), "type", "line", F.element_at("edge_path", -1).alias("edge_id"), rank(F.col("path_confidence")).alias("_r"))
    links = hop.groupBy("source", "target", "type").agg(name_of(F.max("_r")).alias("path_confidence"), F.min("line").alias("line"), F.min("edge_id").alias("edge_id"))
    on_path = seen.select(F.col("node_id").alias("symbol_node_id"))
    blocks = cfg.join(on_path, "symbol_node_id", "left_semi").select("symbol_node_id", "block_index", "parent_index", "kind", "condition_text", "outcome", "exit_form", "error_name", "start_line", "end_line")
    unknown = answer["unknown"].join(nodes.select(F.col("node_id").alias("src_node_id"), F.col("key").alias("symbol")), "src_node_id", "left").select("symbol", F.col("target_hint").alias("target"), "reason", "line")
    return {"nodes": shown.drop("_first"), "links": links, "lanes": lanes.select("service"), "cfg": blocks, "unknowns": unknown}


def payload_json(tables: dict[str, DataFrame], route: dict[str, str], most: int = 5000) -> str:
    """The picture of one route as JSON; one with more than ``most`` nodes is too large to draw and says so."""
    shown = tables["nodes"].orderBy("depth", "node_id").limit(most + 1).collect()
    if len(shown) > most:
        raise ValueError(f"more than {most} nodes: too many to draw")
    rows = lambda name, *order: [r.asDict(True) for r in tables[name].orderBy(*order).collect()]
    cfg: dict[str, list] = {}
    for block in rows("cfg", "symbol_node_id", "block_index"):
        cfg.setdefault(str(block.pop("symbol_node_id")), []).append(block)
    return json.dumps({"route": route, "nodes": [r.asDict(True) for r in shown], "edges": rows("links", "source", "target", "type"), "services": [r["service"] for r in tables["lanes"].collect()], "unknowns": rows("unknowns", "symbol", "line"), "cfg": cfg, "legend": LEGEND}, ensure_ascii=False, default=str)
