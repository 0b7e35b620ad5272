"""The questions the engine answers, each one set-based plan over the fact tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.functions.confidence import name_of, rank
from spanloom.functions.text import collated, path_fits
from spanloom.operators import context as CX
from spanloom.operators import graph as G
from spanloom.operators import search as SE
from spanloom.operators import traces as TR
from spanloom.operators.cochange import peers
from spanloom.operators.intervals import overlapping

ROUTE_LIMIT = 25


class NotFound(LookupError):
    """The seed or route does not exist; ``candidates`` names what comes near."""

    def __init__(self, what: str, candidates: list[str]):
        super().__init__(f"{what} is not known" + (f"; did you mean {', '.join(candidates[:5])}" if candidates else ""))
        self.candidates = candidates


class Ambiguous(LookupError):
    """Several symbols fit the seed."""

    def __init__(self, what: str, candidates: list[str]):
        super().__init__(f"{what} means several symbols: {', '.join(candidates[:5])}")
        self.candidates = candidates


@dataclass
class Answer:
    """Named tables of an answer; gaps are data and always among them."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


class Engine:
    """Questions over tables given by name; missing optional tables count as empty."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.spark = next(iter(tables.values())).sparkSession

    def table(self, name: str) -> DataFrame:
        from spanloom.schema import TABLES

        if name in self.tables:
            return self.tables[name]
        return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].schema))

    def _ids(self, name: str, values: list[int]) -> DataFrame:
        return self.spark.range(1).select(F.explode(F.array(*(F.lit(v).cast("long") for v in values))).alias(name))

    # Seeds

    def route(self, service: str, method: str, url: str) -> int:
        """Node id of a route; NotFound lists the service's routes."""
        routes = self.table("routes")
        found = routes.filter((F.col("service_name") == service) & (F.col("method") == method.upper()) & (F.col("url") == url)).select("node_id").orderBy("node_id").first()
        if found:
            return found[0]
        near = routes.filter(F.col("service_name") == service).select(F.concat_ws(" ", "method", "url").alias("k")).distinct().orderBy("k").limit(20)
        raise NotFound(f"{service} {method.upper()} {url}", [r.k for r in near.collect()])

    def seed(self, text: str) -> tuple[int, str]:
        """(node id, how) of a seed: an exact key, a file's path suffix, or a symbol's name."""
        nodes = self.table("nodes")
        exact = nodes.filter(F.col("key") == text).orderBy("node_id").first()
        if exact:
            return exact["node_id"], "key"
        file = nodes.filter((F.col("kind") == "file") & F.col("key").endswith(f"/{text}")).orderBy("node_id").limit(6).collect()
        if file:
            if len(file) > 1:
                raise Ambiguous(text, [r["key"] for r in file])
            return file[0]["node_id"], "file"
        named = nodes.filter((F.col("kind") == "symbol") & F.col("key").contains(text) & (S.display_name(F.col("key")) == text)).orderBy("key").limit(6).collect()
        if len(named) > 1:
            raise Ambiguous(text, [r["key"] for r in named])
        if not named:
            raise NotFound(text, [])
        return named[0]["node_id"], "name"

    # What executes on an endpoint

    def chain(self, route_ids: DataFrame) -> DataFrame:
        """Chain rows of the routes (node_id), once per position, in order: inline checks last."""
        rows = self.table("route_chain").dropDuplicates(["route_node_id", "phase", "position"])
        return rows.join(route_ids.select(F.col("node_id").alias("route_node_id")), "route_node_id", "left_semi").orderBy("route_node_id", F.col("phase") == "handler_inline", "position")

    def endpoint_flow(self, service: str, method: str, url: str, max_depth: int = G.MAX_DEPTH, follow_remote: bool = True) -> Answer:
        """chain, steps (paths), visited routes in order, unknown branches, unjoined entries.

        A route that a path ends in is entered once: its chain is walked in the next round,
        and later sights of it stay boundaries.
        """
        edges, nodes = G.edges_once(self.table("edges"), "edge_id", "confidence"), self.table("nodes")
        first = self.route(service, method, url)
        frontier, seen = [first], [first]
        chains, steps = [], []
        while frontier:
            ids = self._ids("node_id", frontier)
            chain = self.chain(ids)
            chains.append(chain)
            anonymous = F.col("name").isNull() & F.col("line").isNotNull() & F.col("end_line").isNotNull()
            seeds = chain.filter("symbol_node_id is not null").select(F.concat_ws(":", "route_node_id", "position", "phase").alias("position"), F.col("symbol_node_id").alias("node_id"), F.when(anonymous, F.col("line")).alias("low"), F.when(anonymous, F.col("end_line")).alias("high"))
            walked = G.walk(edges, nodes, seeds, max_depth)
            steps.append(walked)
            frontier = []
            if follow_remote:
                remote = walked.join(nodes.filter("kind = 'route'").select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.min(F.struct("position", "depth")).alias("at")).orderBy("at", "node_id")
                frontier = [r.node_id for r in remote.collect() if r.node_id not in seen]  # one row per route of the estate at most
                seen += frontier
        all_steps, all_chains = steps[0], chains[0]
        for more in steps[1:]:
            all_steps = all_steps.unionByName(more)
        for more in chains[1:]:
            all_chains = all_chains.unionByName(more)
        keys = nodes.select("node_id", "kind", "key")
        on_path = all_steps.select("node_id").distinct()
        unknown = self.table("unresolved_calls").join(on_path.select(F.col("node_id").alias("src_node_id")), "src_node_id", "left_semi")
        unjoined = all_chains.filter("symbol_node_id is null and origin not in ('framework', 'handler')")
        return Answer({"chain": all_chains, "steps": all_steps.join(keys, "node_id", "left"), "unknown": unknown, "unjoined": unjoined}, {"visited": seen})

    # What a change breaks

    def impact(self, seed: str | int, max_depth: int = G.MAX_DEPTH, route_limit: int = ROUTE_LIMIT) -> Answer:
        """closure, routes by bucket, shared config and data, gaps; fan-in and utility as facts.

        Routes are those reached over edges, and those whose chain names a reached symbol;
        of both the surer evidence stands.
        """
        edges, nodes = G.edges_once(self.table("edges"), "edge_id", "confidence"), self.table("nodes")
        node, how = self.seed(seed) if isinstance(seed, str) else (seed, "id")
        seeds = self._ids("seed", [node])
        spaces = nodes.filter("kind = 'symbol'").filter(S.symbol_kind(F.col("key")) == "namespace").select("node_id")
        closure = G.closure(edges, seeds, G.IMPACT_TYPES, True, max_depth, spaces)
        routes = self.impacted_routes(closure.unionByName(seeds.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth"), F.lit("certain").alias("path_confidence"))))
        shown = G.truncate_buckets(routes, "bucket", [collated("service_name"), collated("url"), collated("method"), F.col("node_id")], route_limit)
        coupling = G.shared_nodes(edges, nodes, seeds, ["config", "datastore"])
        fan_in = G.fan_in(edges).filter(F.col("node_id") == node).first()
        gaps = self.table("unresolved_calls").join(closure.select(F.col("node_id").alias("src_node_id")).distinct().unionByName(seeds.select(F.col("seed").alias("src_node_id"))).distinct(), "src_node_id", "left_semi")
        return Answer({"closure": closure, "routes": shown, "coupling": coupling, "gaps": gaps}, {"node_id": node, "resolved_by": how, "fan_in": fan_in["fan_in"] if fan_in else 0, "is_utility": bool(fan_in and fan_in["is_utility"])})

    def impacted_routes(self, closure: DataFrame) -> DataFrame:
        """(seed, node_id, service_name, method, url, bucket) of the routes a closure touches."""
        routes = self.table("routes").select("node_id", "service_name", "method", "url")
        by_edge = closure.join(routes.select("node_id"), "node_id", "left_semi").select("seed", "node_id", rank(F.col("path_confidence")).alias("r"))
        chain = self.table("route_chain").filter("symbol_node_id is not null").select("route_node_id", "symbol_node_id", rank(F.col("confidence")).alias("_c")).distinct()
        by_chain = closure.join(chain, F.col("node_id") == F.col("symbol_node_id")).select("seed", F.col("route_node_id").alias("node_id"), F.least(rank(F.col("path_confidence")), F.col("_c")).alias("r"))
        best = by_edge.unionByName(by_chain).groupBy("seed", "node_id").agg(F.max("r").alias("r"))
        return best.join(routes, "node_id").select("seed", "node_id", "service_name", "method", "url", F.when(F.col("r") == 3, "certain").when(F.col("r") > 0, "inferred").otherwise("unknown").alias("bucket"))

    def pr_impact(self, hunks: DataFrame, symbols: DataFrame, max_depth: int = G.MAX_DEPTH) -> Answer:
        """Routes a change can break: hunks (file, first, last) to symbols to routes, all seeds at once.

        ``symbols`` has node_id, path, symbol_kind, start_line, end_line. A hunk means the method
        it touches, else the smallest symbol; parameters never count. Hunks without a symbol
        and files without any are listed.
        """
        edges, nodes = G.edges_once(self.table("edges"), "edge_id", "confidence"), self.table("nodes")
        usable = symbols.filter("symbol_kind not in ('parameter', 'meta', 'typeParameter', 'namespace')").select(F.col("path").alias("file"), "node_id", "symbol_kind", "start_line", "end_line")
        met = overlapping(hunks, usable, "file", "first", "last", "start_line", "end_line")
        best = met.groupBy("file", "first", "last").agg(F.min(F.struct((F.col("symbol_kind") != "method").alias("other"), (F.col("end_line") - F.col("start_line")).alias("size"), "node_id")).alias("b"))
        seeds = best.select(F.col("b.node_id").alias("seed")).distinct()
        unmapped = hunks.join(best, ["file", "first", "last"], "left_anti")
        unindexed = hunks.select("file").distinct().join(symbols.select(F.col("path").alias("file")), "file", "left_anti")
        spaces = nodes.filter("kind = 'symbol'").filter(S.symbol_kind(F.col("key")) == "namespace").select("node_id")
        closure = G.closure(edges, seeds, G.IMPACT_TYPES, True, max_depth, spaces)
        own = seeds.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth"), F.lit("certain").alias("path_confidence"))
        routes = self.impacted_routes(closure.unionByName(own))
        order = F.when(F.col("bucket") == "certain", 2).when(F.col("bucket") == "inferred", 1).otherwise(0)
        merged = routes.groupBy("node_id", "service_name", "method", "url").agg(F.max_by("bucket", order).alias("bucket"), F.countDistinct("seed").alias("n_seeds"))
        utilities = G.fan_in(edges).filter("is_utility").join(seeds.select(F.col("seed").alias("node_id")), "node_id", "left_semi")
        return Answer({"routes": merged, "seeds": best.select("file", "first", "last", F.col("b.node_id").alias("node_id")), "unmapped": unmapped, "unindexed": unindexed, "utilities": utilities})

    # What can and did fail

    def error_paths(self, service: str, method: str, url: str, limit: int = 20, max_depth: int = G.MAX_DEPTH) -> Answer:
        """observed (root causes of errored traces) and surface (static exits), independently; unknowns."""
        from spanloom.operators.cfg import guards

        node = self.route(service, method, url)
        chain = self.chain(self._ids("node_id", [node]))
        symbols = self.table("nodes").filter("kind = 'symbol'").select("node_id")
        reached = G.reach(self.table("edges"), chain.filter("symbol_node_id is not null").select(F.col("route_node_id").alias("seed"), F.col("symbol_node_id").alias("node_id")), G.REACH_TYPES, max_depth, symbols).select("node_id").distinct()
        surface = guards(self.table("function_cfg").join(reached.select(F.col("node_id").alias("symbol_node_id")), "symbol_node_id", "left_semi"))
        known = surface.select(F.col("symbol_node_id").alias("src_node_id"), F.col("start_line").alias("line"))
        throws = G.edges_once(self.table("edges"), "edge_id").filter("type = 'THROWS'").join(reached.select(F.col("node_id").alias("src_node_id")), "src_node_id", "left_semi").join(known, ["src_node_id", "line"], "left_anti")
        # Spans without a route count by the concrete path they name.
        of_route = (F.col("http_route") == url) | F.col("http_route").isNull() & F.coalesce(path_fits(F.col("url_path"), F.lit(url)), F.lit(False))
        hit = self.table("spans").filter((F.col("service_name") == service) & of_route & (F.col("http_method").isNull() | (F.col("http_method") == method.upper())))
        mine = self.table("spans").join(hit.select("trace_id").distinct(), "trace_id", "left_semi")
        observed = TR.root_causes(mine)
        newest = TR.errored_traces(TR.once(mine), limit)
        unknown = self.table("unresolved_calls").join(reached.select(F.col("node_id").alias("src_node_id")), "src_node_id", "left_semi")
        opaque = self.table("function_cfg").filter("outcome = 'unknown'").join(reached.select(F.col("node_id").alias("symbol_node_id")), "symbol_node_id", "left_semi")
        return Answer({"observed": observed, "newest": newest, "surface": surface, "throws": throws, "unknown": unknown, "opaque_exits": opaque})

    # Context for one symbol

    def context_pack(self, seed: str, budget: int = CX.BUDGET, sources: DataFrame | None = None) -> Answer:
        """tiers, what was packed of them, and the gaps that are always included.

        With ``sources`` (path, content) the pack begins with the seed's own lines, which count
        first, and ``delta`` compares it with dumping whole the files its items come from.
        """
        node, how = self.seed(seed)
        seeds = self._ids("seed", [node])
        gaps = self.table("unresolved_calls").filter(F.col("src_node_id") == node)
        reserved = gaps.agg(F.coalesce(F.sum(F.ceil(F.length(F.concat_ws(" ", "kind", "target_hint", "reason")) / 4)), F.lit(0)).cast("long")).first()[0]
        rows = CX.tiers(self.table("nodes"), self.table("edges"), self.table("function_cfg"), seeds)
        tables = {"gaps": gaps}
        if sources is not None:
            tables["source"] = source = CX.source_of(seeds, self.table("symbols"), self.table("files"), sources)
            reserved += source.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")).first()[0]
        packed = CX.pack(rows, seeds, budget, reserved)
        if sources is not None:
            touched = CX.touched_files(seeds, self.table("edges"), self.table("symbols"), self.table("files"), sources)
            tables["delta"] = CX.token_delta(packed, touched, source)
        return Answer({"packed": packed, "items": rows.join(packed.filter("included").select("seed", "tier"), ["seed", "tier"], "left_semi"), **tables}, {"node_id": node, "resolved_by": how, "reserved": reserved})

    # Search

    def search(self, phrase: str, index: SE.SearchIndex, query_vector: list[float] | None = None, top_k: int = 8, corrected: str | None = None) -> Answer:
        """Best keys for a phrase: the lexical ranking of the index and its vectors', fused.

        A hit is a seed, not an answer; ``reason`` tells why there is none. A ``corrected`` key
        that exists is taken as it is.
        """
        none = self.spark.createDataFrame([], "node_key string, score double, n_sources long")
        if corrected is not None and self.table("nodes").filter(F.col("key") == corrected).take(1):
            return Answer({"hits": self.spark.range(1).select(F.lit(corrected).alias("node_key"), F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("n_sources"))}, {"reason": None, "corrected": True})
        if not SE.words_of(phrase):
            return Answer({"hits": none}, {"reason": "the phrase has no words"})
        if index.meta() is None:
            return Answer({"hits": none}, {"reason": "the index is not built"})
        lexical = index.lexical(phrase, top_k * 4)
        ranked = _ranked(lexical).withColumn("source", F.lit("lexical"))
        vectors = index.vectors()
        if vectors is not None and query_vector is not None:
            near = SE.vector_top_k(vectors, "node_key", "vector", query_vector, top_k * 4)
            ranked = ranked.unionByName(_ranked(near).withColumn("source", F.lit("vector")))
        fused = SE.reciprocal_rank_fusion(ranked, [], "node_key", "rank").orderBy(F.desc("score"), F.desc("n_sources"), "node_key").limit(top_k)
        return Answer({"hits": fused, "lexical": lexical}, {"reason": None})

    # Files that change together

    def peers_of(self, file: str) -> DataFrame:
        return peers(self.table("co_changed").select("file_a", "file_b", "commits", "support_a", "support_b")).filter(F.col("file") == file)

    # What to ask next of a search hit

    def follow(self, node_key: str) -> Answer:
        """The question a hit leads to: the flow of a route, the impact of anything else."""
        row = self.table("nodes").filter(F.col("key") == node_key).orderBy("node_id").first()
        if row is None:
            raise NotFound(node_key, [])
        if row["kind"] != "route":
            return self.impact(row["node_id"])
        route = self.table("routes").filter(F.col("node_id") == row["node_id"]).first()
        if route is None:
            raise NotFound(node_key, [])
        return self.endpoint_flow(route["service_name"], route["method"], route["url"])

    # The flow of a route from its artifacts alone

    def artifact_flow(self, chain: DataFrame, calls: DataFrame, packages: list[str] | None = None, unresolved: DataFrame | None = None, max_depth: int = G.MAX_DEPTH) -> Answer:
        """chain and steps (``call_tree``) of a boot dump's chain and derived calls, without a store.

        ``chain`` has position, phase, symbol, name, line, col, end_line. An anonymous step has
        only the calls on its own lines.
        """
        anonymous = F.col("name").isNull() & F.col("line").isNotNull() & F.col("end_line").isNotNull()
        bound = lambda c: F.when(anonymous, F.col(c))
        own = F.array(*(F.lit(p) for p in packages)) if packages else F.lit(None).cast("array<string>")
        roots = chain.filter("symbol is not null").select(F.concat_ws(":", "position", "phase").alias("position"), "symbol", own.alias("packages"), bound("line").alias("low"), bound("col").alias("low_col"), bound("end_line").alias("high"))
        return Answer({"chain": chain, "steps": G.call_tree(calls, roots, unresolved, max_depth), "unjoined": chain.filter("symbol is null")})

    # The picture of a route

    def route_graph(self, answer: Answer) -> tuple[DataFrame, DataFrame]:
        """(nodes, links) of a flow: each node and link once, a link as sure as its surest sight."""
        steps = answer["steps"]
        nodes = steps.groupBy("node_id", "kind", "key").agg(F.min("depth").alias("depth"), F.max("cycle").alias("cycle"), F.max("truncated").alias("truncated"))
        ends = steps.filter("depth > 0").select(F.element_at("path", -2).alias("src"), F.col("node_id").alias("dst"), "type", rank(F.col("path_confidence")).alias("r"))
        return nodes, ends.groupBy("src", "dst", "type").agg(name_of(F.max("r")).alias("confidence"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Ranks of a top-k result, already cut to k rows."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "node_key"))).select("node_key", "rank")
