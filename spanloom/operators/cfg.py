"""Control-flow blocks: guards, error-only blocks, and what lies on error paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.hierarchy import hierarchy
from spanloom.operators.intervals import innermost


def guards(cfg: DataFrame) -> DataFrame:
    """Error exits with the condition of the block above them."""
    above = cfg.select(F.col("symbol_node_id").alias("_s"), F.col("block_index").alias("_b"), F.col("condition_text").alias("guard"), F.col("kind").alias("parent_kind"))
    exits = cfg.filter("kind = 'exit' and outcome = 'error_exit'")
    return exits.join(above, (F.col("symbol_node_id") == F.col("_s")) & (F.col("parent_index") == F.col("_b")), "left").select("symbol_node_id", "block_index", "exit_form", "error_name", "start_line", "parent_kind", "guard")


def error_only_blocks(cfg: DataFrame) -> DataFrame:
    """(symbol_node_id, block_index, n_exits) of blocks all of whose exits below are errors."""
    placed = hierarchy(cfg, "symbol_node_id", "block_index", "parent_index")
    exits = cfg.filter("kind = 'exit'").select(F.col("symbol_node_id").cast("string").alias("tree_key"), F.col("block_index").cast("string").alias("node_key"), (F.coalesce(F.col("outcome"), F.lit("unknown")) != "error_exit").cast("int").alias("_fine"))
    up = placed.filter("path is not null").join(exits, ["tree_key", "node_key"]).select("tree_key", F.explode("path").alias("block"), "_fine")
    found = up.groupBy("tree_key", "block").agg(F.count("*").alias("n_exits"), F.sum("_fine").alias("_fine")).filter("_fine = 0")
    return found.select(F.col("tree_key").cast("long").alias("symbol_node_id"), F.col("block").cast("int").alias("block_index"), "n_exits")


def block_of_edges(edges: DataFrame, cfg: DataFrame) -> DataFrame:
    """(edge_id, cfg_block_index): the innermost block, exits aside, around each edge's line.

    An edge of a function with blocks that lies in none of them belongs to its root, 0.
    """
    at = edges.filter("line is not null").select("edge_id", F.col("src_node_id").alias("symbol_node_id"), "line").distinct()
    blocks = cfg.filter("kind <> 'exit'").select("symbol_node_id", "block_index", "start_line", "end_line")
    inner = innermost(at, blocks, "symbol_node_id", ["edge_id", "line"], "line", "block_index", "start_line", "end_line")
    known = at.join(cfg.select("symbol_node_id").distinct(), "symbol_node_id", "left_semi")
    return known.join(inner, ["edge_id", "line"], "left").select("edge_id", F.coalesce("block_index", F.lit(0)).alias("cfg_block_index"))


def calls_on_error_path(edges: DataFrame, cfg: DataFrame) -> DataFrame:
    """(edge_id, src_node_id, dst_node_id, cfg_block_index) of calls inside error-only blocks."""
    calls = edges.filter("type in ('CALLS', 'CALLS_EXTERNAL')").dropDuplicates(["edge_id"])
    at = block_of_edges(calls, cfg)
    only = error_only_blocks(cfg).select("symbol_node_id", "block_index")
    joined = calls.select("edge_id", "src_node_id", "dst_node_id").join(at, "edge_id")
    return joined.join(only, (F.col("src_node_id") == F.col("symbol_node_id")) & (F.col("cfg_block_index") == F.col("block_index")), "left_semi")
