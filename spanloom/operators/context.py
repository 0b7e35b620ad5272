"""Context for editing one symbol: tiers of facts, packed greedily into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.functions.text import estimate_tokens, utf16_length

# Tiers in the order they are tried; gaps are always in.
TIERS = ["seed", "callees", "callers", "routes", "config", "datastores", "errors", "siblings", "control_flow"]
BUDGET = 4000


def tiers(nodes: DataFrame, edges: DataFrame, cfg: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, tier, ordinal, item): what to know about each seed (seed = node id), tier by tier."""
    keys = nodes.select(F.col("node_id").alias("_n"), "key", "kind")
    links = edges.select("src_node_id", "dst_node_id", "type").distinct()
    label = F.when(F.col("kind") == "symbol", S.display_name(F.col("key"))).otherwise(F.col("key"))
    out = seeds.join(links, F.col("seed") == F.col("src_node_id")).join(keys, F.col("dst_node_id") == F.col("_n")).select("seed", "type", "kind", label.alias("item"))
    into = seeds.join(links, F.col("seed") == F.col("dst_node_id")).join(keys, F.col("src_node_id") == F.col("_n")).select("seed", "type", "kind", label.alias("item"))
    tier_out = (
        F.when(F.col("type").isin("CALLS", "CALLS_EXTERNAL"), "callees").when(F.col("type") == "READS_CONFIG", "config").when(F.col("type").isin("READS", "WRITES"), "datastores").when(F.col("type") == "THROWS", "errors").when(F.col("type") == "REQUESTS", "routes")
    )
    tier_in = F.when(F.col("type") == "CALLS", "callers").when(F.col("type") == "HANDLES", "routes").when(F.col("type") == "CONTAINS", "siblings")
    own = seeds.join(keys, F.col("seed") == F.col("_n")).select("seed", F.lit("seed").alias("tier"), F.col("key").alias("item"))
    flow = seeds.join(cfg, F.col("seed") == F.col("symbol_node_id")).select("seed", F.lit("control_flow").alias("tier"), F.concat_ws(" ", "block_index", "kind", F.coalesce("condition_text", "error_name", "outcome")).alias("item"))
    rows = own.unionByName(out.select("seed", tier_out.alias("tier"), "item")).unionByName(into.select("seed", tier_in.alias("tier"), "item")).unionByName(flow)
    return rows.filter("tier is not null and item is not null").distinct()


def pack(rows: DataFrame, seeds: DataFrame, budget: int = BUDGET, reserved: int = 0) -> DataFrame:
    """(seed, tier, n_items, cost, included): tiers that fit, tried in order.

    A tier that does not fit is skipped and later, smaller ones are still tried; an empty
    tier is included at no cost. The cost of a tier is its text in estimated tokens.
    """
    sizes = rows.groupBy("seed", "tier").agg(F.count("*").alias("n_items"), F.ceil(F.sum(utf16_length(F.col("item")) + 3) / 4).cast("long").alias("cost"))
    order = seeds.select("seed").distinct().withColumn("t", F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(t).alias("tier")) for i, t in enumerate(TIERS))))).select("seed", "t.at", "t.tier")
    full = order.join(sizes, ["seed", "tier"], "left").select("seed", "at", "tier", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("cost", F.lit(0)).alias("cost"))
    listed = full.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("at", "tier", "n_items", "cost"))).alias("ts"))
    start = F.struct(F.lit(reserved).cast("long").alias("spent"), F.array().cast("array<struct<tier:string,n_items:bigint,cost:bigint,included:boolean>>").alias("out"))

    def step(state, t):
        fits = state["spent"] + t["cost"] <= budget
        row = F.struct(t["tier"].alias("tier"), t["n_items"].alias("n_items"), t["cost"].alias("cost"), fits.alias("included"))
        return F.struct((state["spent"] + F.when(fits, t["cost"]).otherwise(0)).alias("spent"), F.concat(state["out"], F.array(row)).alias("out"))

    packed = listed.select("seed", F.explode(F.aggregate("ts", start, step, lambda s: s["out"])).alias("x"))
    return packed.select("seed", "x.tier", "x.n_items", "x.cost", "x.included")


def source_of(seeds: DataFrame, symbols: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(seed, path, text, tokens): the lines of each seed's own definition."""
    at = seeds.join(symbols.select("node_id", "file_id", "start_line", "end_line"), F.col("seed") == F.col("node_id")).join(files.select("file_id", "path"), "file_id").join(sources.select("path", "content"), "path")
    lines = F.slice(F.split("content", "\r\n|\r|\n"), F.greatest(F.lit(1), F.col("start_line")), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1))
    return at.select("seed", "path", F.array_join(lines, "\n").alias("text")).withColumn("tokens", estimate_tokens(F.col("text")))


def touched_files(seeds: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(seed, dump_tokens): the size of all files that hold a seed or a symbol next to it."""
    links = edges.select("src_node_id", "dst_node_id")
    near = seeds.select("seed", F.col("seed").alias("node_id")).unionByName(seeds.join(links, F.col("seed") == F.col("src_node_id")).select("seed", F.col("dst_node_id").alias("node_id"))).unionByName(seeds.join(links, F.col("seed") == F.col("dst_node_id")).select("seed", F.col("src_node_id").alias("node_id")))
    held = near.join(symbols.select("node_id", "file_id"), "node_id").select("seed", "file_id").distinct()
    sizes = files.select("file_id", "path").join(sources.select("path", estimate_tokens(F.col("content")).alias("_t")), "path")
    return held.join(sizes, "file_id").groupBy("seed").agg(F.sum("_t").alias("dump_tokens"))


def token_delta(packed: DataFrame, file_tokens: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """(seed, packed_tokens, dump_tokens, ratio): the pack against dumping the seed's files whole."""
    parts = packed.filter("included").select("seed", F.col("cost").alias("_t"))
    if source is not None:
        parts = parts.unionByName(source.select("seed", F.col("tokens").alias("_t")))
    spent = parts.groupBy("seed").agg(F.sum("_t").alias("packed_tokens"))
    return spent.join(file_tokens, "seed", "left").withColumn("ratio", F.when(F.col("dump_tokens") > 0, F.col("packed_tokens") / F.col("dump_tokens")))
