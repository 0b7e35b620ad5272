"""Summaries: what to generate, from which facts, and what the cache already holds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.schema import TABLES

# The order of generation, details before what sums them up.
STAGES = ["function", "module", "service"]


def inputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(stage, node_key, kind, input, input_sha256) bottom-up: functions, their modules, services.

    Inputs list facts only: names, callees and children, sorted, so that equal facts have
    equal digests whatever the order they were found in.
    """
    symbols = nodes.filter("kind = 'symbol'").select("node_id", "key", S.display_name(F.col("key")).alias("name"), S.package_of(F.col("key")).alias("service"), F.coalesce(F.try_element_at(S.descriptors(F.col("key")), F.lit(1))["name"], F.lit("")).alias("module"))
    callee = nodes.select(F.col("node_id").alias("dst_node_id"), F.col("key").alias("callee"))
    calls = edges.filter("type in ('CALLS', 'CALLS_EXTERNAL')").select("src_node_id", "dst_node_id").distinct().join(callee, "dst_node_id").groupBy(F.col("src_node_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("callee")), "\n").alias("callees"))
    functions = symbols.join(calls, "node_id", "left").select(F.lit(0).alias("stage"), F.col("key").alias("node_key"), F.lit("function").alias("kind"), F.concat_ws("\n", "name", "callees").alias("input"))
    modules = symbols.groupBy("service", "module").agg(F.array_join(F.array_sort(F.collect_set("name")), "\n").alias("input")).select(F.lit(1).alias("stage"), F.concat_ws("/", "service", "module").alias("node_key"), F.lit("module").alias("kind"), "input")
    services = symbols.groupBy("service").agg(F.array_join(F.array_sort(F.collect_set("module")), "\n").alias("input")).select(F.lit(2).alias("stage"), F.col("service").alias("node_key"), F.lit("service").alias("kind"), "input")
    return functions.unionByName(modules).unionByName(services).withColumn("input_sha256", F.sha2("input", 256))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Inputs that no cached summary was made from."""
    return wanted.join(cache.select("node_key", "kind", "input_sha256"), ["node_key", "kind", "input_sha256"], "left_anti")


def generate(misses: DataFrame, complete: Callable[[list[str]], list[str]], model: str, provider: str) -> DataFrame:
    """Rows for the summary table; ``complete`` turns a batch of inputs into texts, on executors."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = complete(part["input"].tolist())
            yield pd.DataFrame({"node_key": part["node_key"], "kind": part["kind"], "input_sha256": part["input_sha256"], "summary": texts, "model": model, "provider": provider, "tokens_in": [-(-len(x) // 4) for x in part["input"]], "tokens_out": [-(-len(x) // 4) for x in texts]})

    return misses.mapInPandas(work, "node_key string, kind string, input_sha256 string, summary string, model string, provider string, tokens_in int, tokens_out int")


def containment(modules: dict[str, str]) -> dict[str, list[str]]:
    """What breaks the rule that made-up text stays apart: nothing may refer to summaries, nor they to facts.

    ``modules`` has the source of each query module by name. ``keys`` lists references between
    summaries and other tables, ``readers`` the modules that name the table. Both must be empty.
    """
    keys = [f"summaries.{c}" for c in TABLES["summaries"].references]
    keys += [f"{name}.{c}" for name, table in TABLES.items() for c, (target, _) in table.references.items() if target == "summaries"]
    return {"keys": keys, "readers": sorted(name for name, source in modules.items() if re.search(r"\bsummaries\b", source))}


def plan_generation(wanted: DataFrame, scope: str, seed: str = "") -> DataFrame:
    """The part of ``wanted`` (rows of ``inputs``) that a scope means, in the order to make it.

    ``function`` and ``module`` mean the seed's own row, a module with its functions first;
    ``service`` one service with all below it; ``all`` everything, service by service.
    """
    service = F.when(F.col("kind") == "function", S.package_of(F.col("node_key"))).when(F.col("kind") == "module", F.split_part("node_key", F.lit("/"), F.lit(1))).otherwise(F.col("node_key"))
    module = F.when(F.col("kind") == "function", F.concat_ws("/", service, F.coalesce(F.try_element_at(S.descriptors(F.col("node_key")), F.lit(1))["name"], F.lit("")))).when(F.col("kind") == "module", F.col("node_key"))
    rows = wanted.withColumn("service", service).withColumn("module", module)
    if scope not in ("function", "module", "service", "all"):
        raise ValueError(f"scope {scope!r} is none of function, module, service, all")
    which = {"function": (F.col("kind") == "function") & (F.col("node_key") == seed), "module": F.col("module") == seed, "service": F.col("service") == seed, "all": F.lit(True)}[scope]
    return rows.filter(which).orderBy("service", "stage", "node_key")
