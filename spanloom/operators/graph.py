"""Graph traversal on edge tables: path enumeration, shortest closures, reachability.

Two kernels. ``walk`` enumerates paths (every call site is its own branch) and is meant for
few seeds. ``closure`` and ``reach`` keep one row per (seed, node): a level is one join with
the links and one aggregation. Levels are staged every few, so plans stay short however far
the walk goes.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.functions.confidence import name_of, rank
from spanloom.session import stage, stage_counting

# The edge types each question follows; they differ on purpose.
FLOW_TYPES = ["CALLS", "CALLS_EXTERNAL", "REQUESTS", "READS", "WRITES", "READS_CONFIG", "THROWS"]
IMPACT_TYPES = ["CALLS", "HANDLES", "REQUESTS"]
REACH_TYPES = ["CALLS"]
MAX_DEPTH = 12
UTILITY_FAN_IN = 10
#: Links of a node that one share of a join holds at most, about.
HUB_LINKS = 100_000
#: Levels of a closure that one job grows.
STRIDE = 4


def edges_once(edges: DataFrame, *columns: str) -> DataFrame:
    """One row per edge identity (source, target, type, evidence, file, line): the first by id.

    With ``columns`` only identity and those are read, shuffled and returned.
    """
    identity = ["src_node_id", "dst_node_id", "type", "evidence_kind", "file_id", "line"]
    kept = [c for c in edges.columns if not columns or c in columns or c in identity]
    keys = [*identity[:4], *(F.coalesce(c, F.lit(-1)).alias(f"_{c}") for c in identity[4:])]
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*kept), "edge_id").alias("_e")).select("_e.*")


def fan_in(edges: DataFrame, threshold: int = UTILITY_FAN_IN) -> DataFrame:
    """(node_id, fan_in, is_utility): distinct callers of each called node."""
    calls = edges.filter(F.col("type") == "CALLS").select("src_node_id", "dst_node_id").distinct()
    return calls.groupBy(F.col("dst_node_id").alias("node_id")).agg(F.count("*").alias("fan_in")).withColumn("is_utility", F.col("fan_in") >= threshold)


def neighbours(edges: DataFrame, types: list[str]) -> DataFrame:
    """(node_id, direction, other_id) of every distinct link of the given types."""
    links = edges.filter(F.col("type").isin(*types)).select("src_node_id", "dst_node_id").distinct()
    out = links.select(F.col("src_node_id").alias("node_id"), F.lit("out").alias("direction"), F.col("dst_node_id").alias("other_id"))
    return out.unionByName(links.select(F.col("dst_node_id").alias("node_id"), F.lit("in").alias("direction"), F.col("src_node_id").alias("other_id")))


def two_hop(edges: DataFrame, types: list[str], seeds: DataFrame) -> DataFrame:
    """(seed, node_id) two links away from each seed, the seed itself excluded."""
    links = edges.filter(F.col("type").isin(*types)).select("src_node_id", "dst_node_id").distinct()
    one = seeds.join(links, F.col("seed") == F.col("src_node_id")).select("seed", F.col("dst_node_id").alias("_mid")).distinct()
    return one.join(links, F.col("_mid") == F.col("src_node_id")).select("seed", F.col("dst_node_id").alias("node_id")).filter("node_id <> seed").distinct()


def shared_nodes(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, kinds: list[str]) -> DataFrame:
    """(seed, shared_id, other_id): who else touches the config or data a seed touches."""
    targets = nodes.filter(F.col("kind").isin(*kinds)).select(F.col("node_id").alias("_n"))
    touches = edges.join(targets, F.col("dst_node_id") == F.col("_n"), "left_semi").select("src_node_id", "dst_node_id").distinct()
    mine = seeds.join(touches, F.col("seed") == F.col("src_node_id")).select("seed", F.col("dst_node_id").alias("shared_id"))
    return mine.join(touches, F.col("shared_id") == F.col("dst_node_id")).filter("src_node_id <> seed").select("seed", "shared_id", F.col("src_node_id").alias("other_id"))


def walk(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, types: list[str] | None = None) -> DataFrame:
    """All paths from the seeds: (position, path, node_id, depth, type, line, path_confidence, cycle, truncated).

    ``seeds`` has position (any id of the seed), node_id, and the lines low and high that
    bound the first step (null: unbounded). Only symbols are expanded. No node repeats on a
    path except the seed, which may be entered once more; a row that returns to a node of its
    path has cycle, one that stops at ``max_depth`` although its symbol has links has
    truncated. Links on different lines are different branches.
    """
    symbols = nodes.filter("kind = 'symbol'").select(F.col("node_id").alias("_sym"))
    links = edges.filter(F.col("type").isin(*(types or FLOW_TYPES))).select("edge_id", "src_node_id", "dst_node_id", "type", "line", rank(F.col("confidence")).alias("_r"))
    links = stage(links.join(symbols, F.col("src_node_id") == F.col("_sym"), "left_semi"), "walk-links")
    none = lambda kind: F.lit(None).cast(kind)
    level = seeds.select("position", F.array("node_id").alias("path"), F.array().cast("array<long>").alias("edge_path"), "node_id", F.lit(0).alias("depth"), none("string").alias("type"), none("int").alias("line"), F.lit(3).alias("_rank"), F.col("low").cast("int").alias("_low"), F.col("high").cast("int").alias("_high"))
    levels = [stage(level, "walk-level")]
    for depth in range(1, max_depth + 1):
        at = levels[-1]
        on_path = F.array_contains(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))), F.col("dst_node_id"))
        in_scope = F.col("_low").isNull() | (F.col("_line") >= F.col("_low")) & (F.col("_line") <= F.col("_high"))
        step = links.select("edge_id", "src_node_id", "dst_node_id", F.col("type").alias("_type"), F.col("line").alias("_line"), "_r")
        grown = at.join(step, F.col("node_id") == F.col("src_node_id")).filter(~on_path & in_scope)
        nxt = stage(
            grown.select(
                "position", F.concat("path", F.array("dst_node_id")).alias("path"), F.concat("edge_path", F.array("edge_id")).alias("edge_path"), F.col("dst_node_id").alias("node_id"), F.lit(depth).alias("depth"), F.col("_type").alias("type"), F.col("_line").alias("line"), F.least("_rank", "_r").alias("_rank"), none("int").alias("_low"), none("int").alias("_high")
            ),
            "walk-level",
        )
        if not nxt.take(1):
            break
        levels.append(nxt)
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    cycle = F.array_contains(F.slice("path", F.lit(1), F.size("path") - 1), F.col("node_id"))
    expandable = links.select(F.col("src_node_id").alias("_x")).distinct()
    rows = rows.join(expandable, F.col("node_id") == F.col("_x"), "left")
    return rows.select("position", "path", "edge_path", "node_id", "depth", "type", "line", name_of(F.col("_rank")).alias("path_confidence"), cycle.alias("cycle"), ((F.col("depth") == max_depth) & F.col("_x").isNotNull() & ~cycle).alias("truncated"))


def call_tree(calls: DataFrame, roots: DataFrame, unresolved: DataFrame | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Call trees over derived calls alone, as from an index without a store.

    ``calls`` has src_symbol, dst_symbol, path, line, col, confidence; ``roots`` has position,
    symbol, packages (those that are not a boundary; null: none is) and the start low, low_col
    and end high of the lines that bound the root's own calls (null: unbounded).
    ``unresolved`` has src_symbol, target, reason, path, line, col.

    Rows: position, way (the lines on the way down, for order), symbols (root to node), symbol,
    depth, edge, path_confidence, path, line, reason, external, cycle, truncated. A caller
    has one branch per callee, the first by line. Externals, cycles and ``max_depth`` end a
    branch, each marked; a call without a target is a branch of its own with its reason.
    """
    local = F.col("packages").isNull() | F.array_contains("packages", S.package_of(F.col("symbol")))
    start = roots.select("position", F.array().cast("array<int>").alias("way"), F.array("symbol").alias("symbols"), "symbol", F.lit(0).alias("depth"), F.lit("certain").alias("edge"), F.lit(3).alias("_rank"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("reason"), "packages", F.col("low").cast("int").alias("_low"), F.col("low_col").cast("int").alias("_col"), F.col("high").cast("int").alias("_high"))
    targets = calls.select(F.col("src_symbol").alias("_src"), F.col("dst_symbol").alias("_dst"), F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("col").alias("_at"), F.col("confidence").alias("_sure"), F.lit(None).cast("string").alias("_why"))
    if unresolved is not None:
        gaps = unresolved.select(F.col("src_symbol").alias("_src"), F.col("target").alias("_dst"), F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("col").alias("_at"), F.lit("unresolved").alias("_sure"), F.coalesce("reason", F.lit("unresolved")).alias("_why"))
        targets = targets.unionByName(gaps)
    targets = stage(targets.distinct(), "tree-calls")
    in_scope = F.col("_low").isNull() | (F.col("_line") <= F.col("_high")) & ((F.col("_line") > F.col("_low")) | (F.col("_line") == F.col("_low")) & (F.col("_at") >= F.coalesce("_col", F.lit(0))))
    marked = lambda rows: rows.withColumn("external", ~local | F.col("reason").isNotNull()).withColumn("cycle", F.array_contains(F.slice("symbols", F.lit(1), F.size("symbols") - 1), F.col("symbol")) & F.col("reason").isNull())
    frontier, n = stage_counting(marked(start), "tree-level")
    levels = [frontier]
    for depth in range(1, max_depth + 1):
        met = frontier.filter("not external and not cycle").join(targets, F.col("symbol") == F.col("_src")).filter(in_scope)
        # One branch per callee; gaps are not merged.
        best = met.groupBy("position", "way", "symbols", "packages", "_rank", "_dst", F.when(F.col("_why").isNotNull(), F.struct("_line", "_at", "_why")).alias("_gap")).agg(F.min(F.struct("_line", "_at", "_path", "_sure", "_why")).alias("_b"))
        grown = best.select(
            "position", F.concat("way", F.array("_b._line")).alias("way"), F.concat("symbols", F.array("_dst")).alias("symbols"), F.col("_dst").alias("symbol"), F.lit(depth).alias("depth"), F.col("_b._sure").alias("edge"), F.least("_rank", rank(F.col("_b._sure"))).alias("_rank"), F.col("_b._path").alias("path"), F.col("_b._line").alias("line"), F.col("_b._why").alias("reason"), "packages",
            *(F.lit(None).cast("int").alias(c) for c in ("_low", "_col", "_high")),
        )
        frontier, n = stage_counting(marked(grown), "tree-level")
        if not n:
            break
        levels.append(frontier)
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    callers = targets.filter("_why is null").select(F.col("_src").alias("_x")).distinct()
    rows = rows.join(callers, F.col("symbol") == F.col("_x"), "left")
    cut = (F.col("depth") == max_depth) & F.col("_x").isNotNull() & ~F.col("external") & ~F.col("cycle")
    return rows.select("position", "way", "symbols", "symbol", "depth", "edge", name_of(F.col("_rank")).alias("path_confidence"), "path", "line", "reason", "external", "cycle", cut.alias("truncated"))


def closure(edges: DataFrame, seeds: DataFrame, types: list[str], reverse: bool = True, max_depth: int | None = MAX_DEPTH, stop: DataFrame | None = None) -> DataFrame:
    """(seed, node_id, depth, path_confidence) of all nodes linked to each seed.

    depth is that of the shortest path; path_confidence is the weakest edge of a shortest
    path, the surest of them. With ``reverse`` edges are followed from target to source.
    Nodes of ``stop`` are reached but not left, unless they are the seed. A seed that lies on
    a loop is a row of its own closure. Without ``max_depth`` it ends when no node is new.
    """
    at, to = ("dst_node_id", "src_node_id") if reverse else ("src_node_id", "dst_node_id")
    links = edges.filter(F.col("type").isin(*types)).groupBy(F.col(at).alias("_at"), F.col(to).alias("_to")).agg(F.max(rank(F.col("confidence"))).alias("_r"))
    start = seeds.select("seed", F.col("seed").alias("node_id"), F.lit(True).alias("_start"))
    found = _grow(links.filter("_at is not null and _to is not null"), start, max_depth, stop).filter("not _start")
    return found.select("seed", "node_id", _depth(F.col("_code")).alias("depth"), name_of(_rank(F.col("_code"))).alias("path_confidence"))


def reach(edges: DataFrame, seeds: DataFrame, types: list[str], max_depth: int | None = MAX_DEPTH, expand: DataFrame | None = None) -> DataFrame:
    """(seed, node_id) of all nodes reached from the nodes of each seed, those included.

    ``seeds`` has (seed, node_id), many nodes each; only nodes of ``expand`` are left.
    """
    links = reach_links(edges, types, expand)
    start = seeds.select("seed", "node_id", F.lit(False).alias("_start"))
    return _grow(links.withColumn("_r", F.lit(3)), start, max_depth, None).select("seed", "node_id")


def reach_links(edges: DataFrame, types: list[str], expand: DataFrame | None = None) -> DataFrame:
    """(_at, _to) of the distinct links of the given types, those that leave nodes of ``expand`` if given."""
    links = edges.filter(F.col("type").isin(*types)).select(F.col("src_node_id").alias("_at"), F.col("dst_node_id").alias("_to")).dropna().distinct()
    return links if expand is None else links.join(expand.select(F.col("node_id").alias("_at")), "_at", "left_semi")


def remote(edges: DataFrame, chain: DataFrame, symbols: DataFrame, routes: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, types: list[str] | None = None) -> DataFrame:
    """(seed, node_id, depth) of the routes each seed route leads to, whatever the number of hops.

    ``chain`` has (route_node_id, symbol_node_id). A hop walks the chains of the routes that
    the last one found, at most ``max_depth`` links far; depth counts hops. A route is entered
    once per seed, and the seed itself is none of its own.
    """
    edges, types = stage(edges, "remote-edges"), types or FLOW_TYPES
    frontier = stage(seeds.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth")).distinct(), "remote-level")
    known = frontier
    for depth in count(1):
        start = frontier.join(chain, F.col("node_id") == F.col("route_node_id")).select("seed", F.col("symbol_node_id").alias("node_id")).distinct()
        found = reach(edges, start, types, max_depth, symbols).join(routes.select("node_id"), "node_id", "left_semi").select("seed", "node_id").distinct()
        frontier, n = stage_counting(found.join(known, ["seed", "node_id"], "left_anti").withColumn("depth", F.lit(depth)), "remote-level")
        if not n:
            return known.filter("depth > 0")
        known = known.unionByName(frontier)


def _code(depth: Column | int, best: Column) -> Column:
    """Depth and rank in one number: the highest is the surest of the nearest."""
    return best.cast("long") - F.lit(4).cast("long") * depth


def _depth(code: Column) -> Column:
    return (-F.shiftright(code, 2)).cast("int")


def _rank(code: Column) -> Column:
    return code.bitwiseAND(F.lit(3).cast("long")).cast("int")


def _grow(links: DataFrame, start: DataFrame, max_depth: int | None, stop: DataFrame | None) -> DataFrame:
    """(seed, node_id, _start, _code) grown from ``start`` over links (_at, _to, _r).

    A level is one join and one aggregation: every row passes on, rows of the last level
    also pass what they link to, and of equal (seed, node) the nearest, surest one stays.
    STRIDE levels make one job, whose result is staged. The links of a node with more than
    HUB_LINKS of them are dealt over shares, and rows at that node are repeated for each.
    """
    links = links.withColumn("_halt", F.lit(False))
    if stop is not None:
        halt = stop.select(F.col("node_id").alias("_at"), F.lit(True).alias("_halt")).distinct()
        links = links.drop("_halt").join(halt, "_at", "left").withColumn("_halt", F.coalesce("_halt", F.lit(False)))
    dealt, hubs, n_hubs = _deal(links)
    first, dealt = dealt, dealt.filter("not _halt")
    state = start.select("seed", "node_id", "_start", _code(0, F.lit(3)).alias("_code")).distinct()
    depth = 0
    while max_depth is None or depth < max_depth:
        for _ in range(STRIDE if max_depth is None else min(STRIDE, max_depth - depth)):
            state = _level(state, first if depth == 0 else dealt, hubs if n_hubs else None, depth)
            depth += 1
        state, last = stage_counting(state, "levels", _depth(F.col("_code")) == depth)
        if not last:
            break
    return state


def _level(state: DataFrame, links: DataFrame, hubs: DataFrame | None, depth: int) -> DataFrame:
    newest = _depth(F.col("_code")) == depth
    # Rows that only pass on meet no link: their share is negative, and spread by seed.
    aside = -1 - F.pmod(F.xxhash64("seed"), F.lit(1024)).cast("int")
    if hubs is None:
        at = state.withColumn("_share", F.when(newest, F.lit(0)).otherwise(aside))
    else:
        shares = F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)
        at = state.join(hubs, newest & (F.col("node_id") == F.col("_hub")), "left").withColumn("_share", F.explode(F.when(newest, shares).otherwise(F.array(aside)))).drop("_hub", "_shares")
    met = at.join(links, (F.col("node_id") == F.col("_at")) & (F.col("_share") == F.col("_of")), "left")
    own = F.struct("node_id", "_start", "_code")
    other = F.struct(F.col("_to").alias("node_id"), F.lit(False).alias("_start"), _code(depth + 1, F.least(_rank(F.col("_code")), F.col("_r"))).alias("_code"))
    passed = met.select("seed", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("_x"))
    return passed.groupBy("seed", F.col("_x.node_id").alias("node_id"), F.col("_x._start").alias("_start")).agg(F.max("_x._code").alias("_code"))


def _deal(links: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(links with _of, hubs (_hub, _shares), number of hubs): no share of a node much over ``most`` links."""
    most = most or HUB_LINKS
    links, n_links = stage_counting(links, "links")
    hubs = links.groupBy(F.col("_at").alias("_hub")).agg(F.ceil(F.count("*") / most).cast("int").alias("_shares")).filter("_shares > 1")
    # Fewer links in all than a share holds: no node can have too many.
    hubs, n_hubs = stage_counting(hubs, "hubs") if n_links > most else (hubs, 0)
    if not n_hubs:
        return links.withColumn("_of", F.lit(0)), hubs, 0
    of = F.pmod(F.xxhash64("_to"), F.coalesce("_shares", F.lit(1))).cast("int")
    return stage(links.join(hubs, F.col("_at") == F.col("_hub"), "left").select(*links.columns, of.alias("_of")), "dealt-links"), hubs, n_hubs


def truncate_buckets(rows: DataFrame, bucket: str, order: list[Column], limit: int) -> DataFrame:
    """Beyond ``limit`` rows each bucket keeps its share, one row at least; total stays known."""
    from pyspark.sql import Window

    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    kept = rows.join(sizes, bucket).crossJoin(F.broadcast(total))
    keep = F.when(F.col("_total") <= limit, F.col("_n")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(limit) * F.col("_n") / F.col("_total") + 0.5)))
    # No bucket keeps more than ``limit``: said as a literal, tasks cut their rows before the shuffle.
    numbered = kept.withColumn("_at", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("_at") <= limit)
    return numbered.filter(F.col("_at") <= keep).withColumn("total", F.col("_total")).drop("_n", "_total", "_at")
