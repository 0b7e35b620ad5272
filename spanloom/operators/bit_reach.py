"""How many of some nodes each seed reaches, without a row for each pair.

Where most seeds reach most nodes, pairs grow as the square of the graph. Here the graph is
sent to every task once, and a task takes its seeds in blocks: a node holds one bit per seed of
the block, a level is an OR over the links, and only sums per seed leave the task. Graphs of
more than ``MEMORY_LINKS`` links are grown as pairs by ``graph.reach``, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.session import shuffle_partitions, stage_counting

#: Links that are sent to every task at most.
MEMORY_LINKS = 8_000_000
#: Words of 64 seeds in a block at most, and bytes of the bits of all nodes, about.
BLOCK_WORDS, BLOCK_BYTES = 16, 96 << 20
#: Links of a node that are taken side by side with those of others; its further ones are reduced.
ROUNDS = 32
#: Links taken at once.
CHUNK = 1 << 15
#: As long as the nodes new in a level have under a FEW-th of all links, only their links are followed.
FEW = 16
#: Nodes summed at once, and bits of their ids: such sums are exact in 32-bit floats.
SUM_ROWS, SUM_BITS = 1 << 9, 11


class _Links(NamedTuple):
    """Links by the node they lead to: rounds[k] has the origin of the k-th link of nodes 0, 1, ...; rest (origins, where a node begins, nodes)."""

    rounds: list[np.ndarray]
    rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


class _Graph(NamedTuple):
    """inner: ids of nodes that have links, ends: ids of targets that links lead to; both sorted, with the place of each in the bits."""

    inner: np.ndarray
    inner_at: np.ndarray
    ends: np.ndarray
    ends_at: np.ndarray
    steps: _Links
    last: _Links
    #: The links of steps by the node they leave: those of place k are next_to[next_from[k] : next_from[k + 1]].
    next_from: np.ndarray
    next_to: np.ndarray


def reach_sums(edges: DataFrame, seeds: DataFrame, types: list[str], targets: DataFrame, max_depth: int | None = G.MAX_DEPTH, expand: DataFrame | None = None) -> DataFrame:
    """(seed, n, id_sum): how many of ``targets`` (node_id) but the seed ``graph.reach`` finds for each seed, and the sum of their ids.

    Seeds that find none have no row.
    """
    ends = targets.select("node_id").distinct()
    links = G.reach_links(edges, types, expand).join(ends.select(F.col("node_id").alias("_to"), F.lit(True).alias("_end")), "_to", "left")
    links, n_links = stage_counting(links.select("_at", "_to", F.coalesce("_end", F.lit(False)).alias("_end")), "reach-links")
    if n_links > MEMORY_LINKS:
        found = G.reach(edges, seeds, types, max_depth, expand).join(ends, "node_id", "left_semi").filter("node_id <> seed")
        return found.groupBy("seed").agg(F.count("*").alias("n"), F.sum("node_id").alias("id_sum"))
    kind = dict(seeds.dtypes)["seed"]
    start = seeds.select("seed", "node_id").dropna().distinct().join(ends.withColumn("_end", F.lit(True)), "node_id", "left")
    start = start.select(*(F.col(c).cast("long") for c in ("seed", "node_id")), F.coalesce("_end", F.lit(False)).alias("_end"))
    context = edges.sparkSession.sparkContext
    shared = context.broadcast(_pack(*_columns(links.select(F.col("_at").cast("long"), F.col("_to").cast("long"), "_end"))))
    tasks = max(shuffle_partitions(edges.sparkSession), context.defaultParallelism)
    work = lambda batches: _work(batches, shared.value, max_depth)
    sums = start.repartition(tasks, "seed").sortWithinPartitions("seed").mapInArrow(work, "seed long, n long, id_sum long")
    return sums.withColumn("seed", F.col("seed").cast(kind))


def _columns(rows: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in rows.toArrow().columns]


def _pack(at: np.ndarray, to: np.ndarray, end: np.ndarray) -> _Graph:
    inner = np.unique(at)
    goes_on = _find(inner, to) >= 0
    steps, inner_at = _lay(_find(inner, at[goes_on]), _find(inner, to[goes_on]), len(inner))
    ends = np.unique(to[end])
    last, ends_at = _lay(_find(inner, at[end]), _find(ends, to[end]), len(ends))
    inner_at = inner_at.astype(np.int32)
    steps, last = (_Links([inner_at[x] for x in m.rounds], [(inner_at[x], *y) for x, *y in m.rest]) for m in (steps, last))
    leave, enter = (inner_at[_find(inner, x[goes_on])] for x in (at, to))
    next_from = np.r_[0, np.cumsum(np.bincount(leave, minlength=len(inner)))]
    return _Graph(inner, inner_at, ends, ends_at, steps, last, next_from, enter[np.argsort(leave, kind="stable")])


def _find(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id is in the sorted ids; -1 where it is not."""
    if not len(ids):
        return np.full(len(wanted), -1)
    where = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[where] == wanted, where, -1)


def _lay(at: np.ndarray, to: np.ndarray, n: int) -> tuple[_Links, np.ndarray]:
    """The links with their targets renumbered, those with most links first, and the new number of each."""
    many = np.bincount(to, minlength=n)
    place = np.empty(n, np.int64)
    place[np.argsort(-many, kind="stable")] = np.arange(n)
    to = place[to]
    order = np.argsort(to, kind="stable")
    at, to = at[order], to[order]
    nth = np.arange(len(to)) - np.searchsorted(to, to)
    rounds = [at[nth == k] for k in range(min(ROUNDS, many.max(initial=0)))]
    at, to = at[nth >= ROUNDS], to[nth >= ROUNDS]
    rest = []
    for low in range(0, len(to), CHUNK):
        own = to[low : low + CHUNK]
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        rest.append((at[low : low + CHUNK], begins, own[begins]))
    return _Links(rounds, rest), place


def _work(batches: Iterator[pa.RecordBatch], graph: _Graph, max_depth: int | None) -> Iterator[pa.RecordBatch]:
    words = int(max(1, min(BLOCK_WORDS, BLOCK_BYTES // (8 * max(1, len(graph.inner))))))
    for seed, node, end in _blocks(batches, 64 * words):
        ids, of = np.unique(seed, return_inverse=True)
        n, id_sum = _sums(_reached(graph, ids, of, node, max_depth), graph, len(ids))
        # Starts are found without any link; those that a link leads to are among the ends already.
        for k in np.flatnonzero(end & (node != seed) & (_find(graph.ends, node) < 0)):
            n[of[k]] += 1
            id_sum[of[k]] += int(node[k])
        some = [k for k, m in enumerate(n) if m]
        yield pa.RecordBatch.from_pydict({"seed": pa.array(ids[some], pa.int64()), "n": pa.array([n[k] for k in some], pa.int64()), "id_sum": pa.array([id_sum[k] for k in some], pa.int64())})


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """(seed, node, end) of at most ``most`` seeds at a time, from rows sorted by seed."""
    kept: list[list[np.ndarray]] = []
    n_kept, last = 0, None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "node_id", "_end")]
        while len(seed := rows[0]):
            begins = np.flatnonzero(np.r_[seed[0] != last, seed[1:] != seed[:-1]])
            cut = begins[most - n_kept] if len(begins) > most - n_kept else len(seed)
            kept.append([x[:cut] for x in rows])
            n_kept, last = n_kept + int((begins < cut).sum()), seed[cut - 1] if cut else last
            rows = [x[cut:] for x in rows]
            if len(rows[0]):
                yield [np.concatenate(x) for x in zip(*kept)]
                kept, n_kept, last = [], 0, None
    if kept:
        yield [np.concatenate(x) for x in zip(*kept)]


def _reached(graph: _Graph, ids: np.ndarray, of: np.ndarray, node: np.ndarray, max_depth: int | None) -> np.ndarray:
    """Per end a bit for each seed that reaches it, but for the seed itself."""
    words = -(-len(ids) // 64)
    bit = np.uint64(1) << (of % 64).astype(np.uint64)
    bits, found = (np.zeros((len(x), words), np.uint64) for x in (graph.inner, graph.ends))
    for into, known, place in ((bits, graph.inner, graph.inner_at), (found, graph.ends, graph.ends_at)):
        where = _find(known, node)
        here = where >= 0
        np.bitwise_or.at(into, (place[where[here]], of[here] // 64), bit[here])
    buffer = np.empty((CHUNK, words), np.uint64)
    new = np.flatnonzero(bits.any(axis=1))
    depth = 1
    while (max_depth is None or depth < max_depth) and len(new) and (graph.next_from[new + 1] - graph.next_from[new]).sum() * FEW < len(graph.next_to):
        new, depth = _push(bits, new, graph), depth + 1
    further = np.empty_like(bits)
    while (max_depth is None or depth < max_depth) and len(new):
        np.copyto(further, bits)
        _pass(bits, further, graph.steps, buffer)
        if all(np.array_equal(bits[k : k + CHUNK], further[k : k + CHUNK]) for k in range(0, len(bits), CHUNK)):
            break
        bits, further, depth = further, bits, depth + 1
    if max_depth is None or max_depth > 0:
        _pass(bits, found, graph.last, buffer)
    where = _find(graph.ends, ids)
    own = np.flatnonzero(where >= 0)
    found[graph.ends_at[where[own]], own // 64] &= ~(np.uint64(1) << (own % 64).astype(np.uint64))
    return found


def _push(bits: np.ndarray, new: np.ndarray, graph: _Graph) -> np.ndarray:
    """Pass the bits of the new nodes on along their links; returns the nodes that have bits they had not."""
    n = graph.next_from[new + 1] - graph.next_from[new]
    to = graph.next_to[np.arange(n.sum()) + np.repeat(graph.next_from[new] - np.cumsum(n) + n, n)]
    if not len(to):
        return to
    order = np.argsort(to, kind="stable")
    at, to = np.repeat(new, n)[order], to[order]
    begins = np.flatnonzero(np.diff(to, prepend=-1))
    to = to[begins]
    had = bits[to]
    bits[to] = has = had | np.bitwise_or.reduceat(bits[at], begins, axis=0)
    return to[(had != has).any(axis=1)]


def _pass(bits: np.ndarray, into: np.ndarray, links: _Links, buffer: np.ndarray) -> None:
    for at in links.rounds:
        for low in range(0, len(at), CHUNK):
            part = at[low : low + CHUNK]
            into[low : low + len(part)] |= np.take(bits, part, axis=0, out=buffer[: len(part)], mode="clip")
    for at, begins, to in links.rest:
        into[to] |= np.bitwise_or.reduceat(bits[at], begins, axis=0)


def _sums(found: np.ndarray, graph: _Graph, n_seeds: int) -> tuple[list[int], list[int]]:
    """How many ends have each seed's bit, and the sum of their ids, as whole numbers of any size."""
    if not len(found):
        return [0] * n_seeds, [0] * n_seeds
    least = int(graph.ends[0])
    above = np.empty(len(found), np.uint64)
    above[graph.ends_at] = graph.ends.astype(np.uint64) - graph.ends[:1].astype(np.uint64)
    shifts = range(0, max(1, int(above.max()).bit_length()), SUM_BITS)
    parts = np.stack([np.ones(len(found)), *((above >> np.uint64(s)) & np.uint64((1 << SUM_BITS) - 1) for s in shifts)]).astype(np.float32)
    total = np.zeros((len(parts), n_seeds), np.int64)
    for low in range(0, len(found), SUM_ROWS):
        ones = np.unpackbits(np.ascontiguousarray(found[low : low + SUM_ROWS]).astype("<u8", copy=False).view(np.uint8), axis=1, count=n_seeds, bitorder="little")
        total += (parts[:, low : low + SUM_ROWS] @ ones.astype(np.float32)).astype(np.int64)
    n, *sums = total.tolist()
    return n, [n[k] * least + sum(x[k] << s for x, s in zip(sums, shifts)) for k in range(n_seeds)]
