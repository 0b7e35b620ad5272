"""Parent-child links to full hierarchies: level-wise frontier joins.

Trees never cross their tree key, so rows are laid out by tree key once and all trees of a
run of rows grow together, one frontier join per level, on integer row numbers. Trees too
large for one task take the same joins as distributed DataFrame joins. Rows the frontier
never reaches hang on a cycle; peeling childless rows level by level leaves the cycles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import stage

#: Rows of one tree beyond which its joins run distributed.
GIANT_ROWS = 1_000_000
#: Rows that grow together in one run, and path elements emitted at once.
RUN_ROWS, RUN_PATH = 150_000, 1_500_000
SALTS = 16

SCHEMA = T.StructType(
    [
        T.StructField("tree_key", T.StringType()),
        T.StructField("node_key", T.StringType()),
        T.StructField("parent_key", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("root_key", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("loop_key", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [("tree_key", pa.string()), ("node_key", pa.string()), ("parent_key", pa.string()), ("status", pa.string()), ("depth", pa.int32()), ("root_key", pa.string()), ("path", pa.list_(pa.string())), ("loop_key", pa.string())]
)


def _children(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child rows sorted by parent row, and where each parent's run of them starts."""
    order = np.argsort(parent, kind="stable")
    order = order[np.searchsorted(parent[order], 0) :]
    starts = np.searchsorted(parent[order], np.arange(len(parent) + 1))
    return order, starts


def _join_frontier(frontier: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All children of the frontier."""
    first, count = starts[frontier], starts[frontier + 1] - starts[frontier]
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)
    return order[at]


def grow(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, root, on_cycle, loop) of rows linked by parent row number, -1 for roots.

    depth and root are -1 where no root leads; loop is the smallest row of the row's own
    cycle, -1 elsewhere.
    """
    n = len(parent)
    depth, root = np.full(n, -1, np.int32), np.full(n, -1, np.int64)
    order, starts = _children(parent)
    frontier = np.flatnonzero(parent < 0)
    depth[frontier], root[frontier] = 0, frontier
    level = 0
    while len(frontier):
        level += 1
        frontier = _join_frontier(frontier, order, starts)
        depth[frontier] = level
        root[frontier] = root[parent[frontier]]
    left = depth < 0
    on_cycle, loop = left.copy(), np.full(n, -1, np.int64)
    if left.any():
        pending = np.bincount(parent[left], minlength=n)
        bare = np.flatnonzero(left & (pending == 0))
        while len(bare):
            on_cycle[bare] = False
            above = parent[bare]
            np.subtract.at(pending, above, 1)
            above = np.unique(above)
            bare = above[pending[above] == 0]
        rows = np.flatnonzero(on_cycle)
        place = np.full(n, -1, np.int64)
        place[rows] = np.arange(len(rows))
        label, jump = rows.copy(), place[parent[rows]]
        for _ in range(max(1, int(len(rows)).bit_length())):
            label, jump = np.minimum(label, label[jump]), jump[jump]
        loop[rows] = label
    return depth, root, on_cycle, loop


def _paths(nodes: pa.Array, rows: np.ndarray, depth: np.ndarray, parent: np.ndarray) -> pa.Array:
    """Root-to-row node keys of ``rows``; null where there is no root."""
    length = np.maximum(depth[rows] + 1, 0).astype(np.int64)
    ends = np.cumsum(length)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    at, slot = rows[length > 0], (ends - 1)[length > 0]
    while len(at):
        flat[slot] = at
        up = parent[at]
        more = up >= 0
        at, slot = up[more], slot[more] - 1
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, nodes.take(pa.array(flat)))
    return pc.if_else(pa.array(length > 0), lists, pa.scalar(None, lists.type))


def _run(table: pa.Table, with_paths: bool, run_path: int) -> Iterator[pa.RecordBatch]:
    """Hierarchy rows of whole trees, sorted by (tree, node, parent)."""
    tree, node, up = (table.column(c).combine_chunks() for c in ("_tree", "_node", "_parent"))
    # Trees are numbered, so that no character of a key can make two keys one.
    new = np.ones(len(tree), np.int64)
    if len(tree) > 1:
        new[1:] = pc.not_equal(tree.slice(1), tree.slice(0, len(tree) - 1)).to_numpy(zero_copy_only=False)
    number = pa.array(np.cumsum(new)).cast(pa.string())
    key = pc.binary_join_element_wise(number, node, ":")
    keep = np.ones(len(key), bool)
    if len(key) > 1:
        keep[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    if not keep.all():
        mask = pa.array(keep)
        tree, node, up, key, number = (x.filter(mask) for x in (tree, node, up, key, number))
    parent = pc.index_in(pc.binary_join_element_wise(number, up, ":"), value_set=key)
    parent = pc.if_else(up.is_valid(), parent, pa.scalar(None, pa.int32())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    depth, root, on_cycle, loop = grow(parent)
    orphan = (parent < 0) & up.is_valid().to_numpy(zero_copy_only=False)
    status = np.select([on_cycle, depth < 0, orphan, depth == 0], [2, 3, 1, 0], 4)
    names = pa.array(["root", "orphan_root", "cycle", "below_cycle", "node"])
    take = lambda at: node.take(pa.array(at, mask=at < 0))
    step = np.cumsum(np.maximum(depth + 1, 1)) if with_paths else np.arange(1, len(depth) + 1) * max(1, run_path // 50_000)
    cuts = np.flatnonzero(np.diff(step // run_path)) + 1
    for rows in np.split(np.arange(len(depth)), cuts):
        pick = pa.array(rows)
        paths = _paths(node, rows, depth, parent) if with_paths else pa.nulls(len(rows), pa.list_(pa.string()))
        columns = [tree.take(pick), node.take(pick), up.take(pick), names.take(pa.array(status[rows])), pa.array(depth[rows], mask=depth[rows] < 0), take(root[rows]), paths, take(loop[rows])]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _grow_runs(with_paths: bool, run_rows: int, run_path: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < run_rows:
                continue
            # Only whole trees grow; the last one may go on in the next batch.
            table = pa.Table.from_batches(held)
            trees = table.column("_tree").combine_chunks()
            starts = pc.not_equal(trees.slice(1), trees.slice(0, len(trees) - 1)).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(starts)
            if not len(ends):
                continue
            cut = int(ends[-1]) + 1
            yield from _run(table.slice(0, cut), with_paths, run_path)
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
        if held:
            yield from _run(pa.Table.from_batches(held), with_paths, run_path)

    return work


def _links(df: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    return df.select(F.col(tree).cast("string").alias("_tree"), F.col(node).cast("string").alias("_node"), F.col(parent).cast("string").alias("_parent"))


def hierarchy(df: DataFrame, tree: str, node: str, parent: str, with_paths: bool = True, giant_rows: int = GIANT_ROWS, run_rows: int = RUN_ROWS, run_path: int = RUN_PATH) -> DataFrame:
    """Place every row of a forest: status, depth, root, path and loop.

    A row is (``tree``, ``node``); ``parent`` names a node of the same tree. status is
    ``root`` (null parent), ``orphan_root`` (parent missing, treated as a root), ``node``,
    ``cycle`` (its own ancestor; loop_key names the smallest row of the loop),
    ``below_cycle`` (only leads to a loop; depth, root and path null) or ``no_key`` (null
    tree or node, which nothing can refer to). Repeated rows count once; rows of one key
    with different parents keep the smallest parent, null first. Keys come out as strings.
    An empty input gives no rows; further columns are ignored.
    """
    links = _links(df, tree, node, parent)
    keyed = links.filter(F.col("_tree").isNotNull() & F.col("_node").isNotNull())
    giants = keyed.groupBy("_tree").count().filter(F.col("count") > giant_rows).select("_tree")
    n_giants = len(giants.take(1))
    small = keyed.join(giants, "_tree", "left_anti") if n_giants else keyed
    out = small.repartition("_tree").sortWithinPartitions("_tree", "_node", "_parent").mapInArrow(_grow_runs(with_paths, run_rows, run_path), SCHEMA)
    if n_giants:
        out = out.unionByName(_grow_giants(keyed.join(giants, "_tree", "left_semi"), with_paths))
    null = lambda kind: F.lit(None).cast(kind)
    unkeyed = links.filter(F.col("_tree").isNull() | F.col("_node").isNull()).distinct()
    return out.unionByName(
        unkeyed.select(F.col("_tree").alias("tree_key"), F.col("_node").alias("node_key"), F.col("_parent").alias("parent_key"), F.lit("no_key").alias("status"), null("int").alias("depth"), null("string").alias("root_key"), null("array<string>").alias("path"), null("string").alias("loop_key"))
    )


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _grow_giants(links: DataFrame, with_paths: bool) -> DataFrame:
    """The same level-wise joins, distributed; every level is staged.

    Children of one parent spread over SALTS shares, so a parent with most rows of a tree
    is no single task.
    """
    spark = links.sparkSession
    nodes = stage(links.groupBy("_tree", "_node").agg(F.min(F.struct(F.col("_parent").isNotNull().alias("has"), "_parent")).alias("p")).select("_tree", "_node", F.col("p._parent").alias("_parent")), "giant-nodes")
    there = nodes.select("_tree", F.col("_node").alias("_parent"))
    children = nodes.filter(F.col("_parent").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("_node"), F.lit(SALTS)).cast("int"))
    linked = stage(children.join(_salted(there), ["_tree", "_parent", "_salt"], "left_semi"), "giant-links")
    first = nodes.join(linked.select("_tree", "_node"), ["_tree", "_node"], "left_anti")
    path = F.array("_node") if with_paths else F.lit(None).cast("array<string>")
    level = stage(first.select("_tree", "_node", "_parent", F.lit(0).alias("depth"), F.col("_node").alias("root_key"), path.alias("path")), "giant-level")
    levels = []
    while level.take(1):
        levels.append(level)
        up = _salted(level.select("_tree", F.col("_node").alias("_parent"), F.col("depth").alias("_d"), "root_key", F.col("path").alias("_path")))
        longer = F.concat("_path", F.array("_node")) if with_paths else F.col("_path")
        level = stage(linked.join(up, ["_tree", "_parent", "_salt"]).select("_tree", "_node", "_parent", (F.col("_d") + 1).alias("depth"), "root_key", longer.alias("path")), "giant-level")
    schema = level.schema
    reached = levels[0] if levels else spark.createDataFrame([], schema)
    for more in levels[1:]:
        reached = reached.unionByName(more)
    null = lambda kind: F.lit(None).cast(kind)
    status = F.when(F.col("depth") > 0, "node").when(F.col("_parent").isNull(), "root").otherwise("orphan_root")
    placed = reached.select(F.col("_tree").alias("tree_key"), F.col("_node").alias("node_key"), F.col("_parent").alias("parent_key"), status.alias("status"), "depth", "root_key", "path", null("string").alias("loop_key"))
    left = stage(linked.join(reached.select("_tree", "_node"), ["_tree", "_node"], "left_anti").drop("_salt"), "giant-left")
    if not left.take(1):
        return placed
    ring = left
    while True:  # peel rows without children
        parents = ring.select("_tree", F.col("_parent").alias("_node")).distinct()
        rest = stage(ring.join(parents, ["_tree", "_node"], "left_semi"), "giant-ring")
        if rest.count() == ring.count():
            break
        ring = rest
    # Pointer doubling gives each ring row the smallest row of its loop.
    walk = ring.select("_tree", "_node", F.col("_parent").alias("_to"), F.least("_node", "_parent").alias("_least"))
    size, reach = ring.count(), 1
    while reach < size:
        nxt = walk.select("_tree", F.col("_node").alias("_to"), F.col("_to").alias("_to2"), F.col("_least").alias("_least2"))
        walk = stage(walk.join(nxt, ["_tree", "_to"]).select("_tree", "_node", F.col("_to2").alias("_to"), F.least("_least", "_least2").alias("_least")), "giant-walk")
        reach *= 2
    loops = left.join(walk.select("_tree", "_node", "_least"), ["_tree", "_node"], "left")
    return placed.unionByName(
        loops.select(F.col("_tree").alias("tree_key"), F.col("_node").alias("node_key"), F.col("_parent").alias("parent_key"), F.when(F.col("_least").isNull(), "below_cycle").otherwise("cycle").alias("status"), null("int").alias("depth"), null("string").alias("root_key"), null("array<string>").alias("path"), F.col("_least").alias("loop_key"))
    )


def ancestor_pairs(placed: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of rows with a path, distance 1 and up.

    Grouped by ancestor they are its descendants. Rows on or below a cycle have no pairs.
    """
    pairs = placed.filter(F.col("depth") > 0).select("tree_key", F.col("node_key").alias("descendant_key"), "depth", F.posexplode("path").alias("at", "ancestor_key"))
    return pairs.filter(F.col("at") < F.col("depth")).select("tree_key", "ancestor_key", "descendant_key", (F.col("depth") - F.col("at")).alias("distance"))
