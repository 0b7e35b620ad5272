"""Items that appear together: heavy-light pair counting with a lift score.

Items above a share of all (record, item) incidences are heavy; there can be no more than
1 / share of them. Heavy pairs are counted by popcounts over a dense bit matrix of records,
light pairs by hash, mixed pairs by probing the bit rows of each light item's records. All
three are counted per block of records and summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import stage, stage_counting

HEAVY_SHARE = 1 / 2048
PAIR_CHUNK = 2_000_000
#: Pair counts held back to be summed over blocks before they leave a task.
HELD_PAIRS = 500_000
#: Distinct items of a record beyond which its pairs are dealt over tasks, in chunks of about this many.
WIDE_RECORD = 4096
_OUT = pa.schema([("_g", pa.string()), ("_a", pa.string()), ("_b", pa.string()), ("n", pa.int64())])
SCHEMA = T.StructType([T.StructField("_g", T.StringType()), T.StructField("_a", T.StringType()), T.StructField("_b", T.StringType()), T.StructField("n", T.LongType())])


def heavy_pairs(member: np.ndarray, item: np.ndarray, n_records: int, n_items: int) -> np.ndarray:
    """Co-occurrence matrix of ``n_items`` heavy items by popcount over packed record bits."""
    words = -(-n_records // 64)
    bits = np.zeros((n_items, words), np.uint64)
    np.bitwise_or.at(bits, (item, member >> 6), np.uint64(1) << (member & 63).astype(np.uint64))
    out = np.zeros((n_items, n_items), np.int64)
    for i in range(n_items):
        out[i, i:] = np.bitwise_count(bits[i] & bits[i:]).sum(axis=1)
    return out


def probe_pairs(light_member: np.ndarray, light: np.ndarray, n_light: int, member: np.ndarray, item: np.ndarray, n_records: int, n_items: int) -> np.ndarray:
    """(light, heavy) counts: the records of each light item probe the heavy bits."""
    rows = np.zeros((n_records, n_items), bool)
    rows[member, item] = True
    out = np.zeros((n_light, n_items), np.int64)
    step = max(1, PAIR_CHUNK // max(1, n_items))
    for at in range(0, len(light), step):
        np.add.at(out, light[at : at + step], rows[light_member[at : at + step]])
    return out


def light_pairs(member: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n) with a < b of light items, hash-counted in chunks of pairs.

    Every item pairs with the later items of its record; chunks cut that work anywhere, also
    inside a record, so a record with very many items is no larger step than others.
    """
    order = np.lexsort((item, member))
    member, item = member[order], item[order]
    ends = np.searchsorted(member, member, side="right")
    later = ends - np.arange(len(member)) - 1
    done = np.concatenate(([0], np.cumsum(later)))
    size = int(item.max()) + 1 if len(item) else 0
    for low in range(0, int(done[-1]), PAIR_CHUNK):
        high = min(low + PAIR_CHUNK, int(done[-1]))
        flat = np.arange(low, high)
        left = np.searchsorted(done, flat, side="right") - 1
        right = left + 1 + flat - done[left]
        code, n = np.unique(item[left] * size + item[right], return_counts=True)
        yield code // size, code % size, n


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts added up over blocks, as far as HELD_PAIRS of them go."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def add_up() -> pa.Table:
        return pa.Table.from_batches(held, _OUT).group_by(["_g", "_a", "_b"]).aggregate([("n", "sum")]).rename_columns(_OUT.names).cast(_OUT)

    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= HELD_PAIRS:
            table = add_up()
            held, rows = table.to_batches(), table.num_rows
            if rows > HELD_PAIRS // 2:
                yield from held
                held, rows = [], 0
    if held:
        yield from add_up().to_batches()


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _summed(_block_counts(batches))


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_g, _own, heavy, light, other) to partial pair counts.

    A record is one row with _own, or if it is wide several: one per chunk of its light items,
    the first with _own, and one per pair of chunks, light and other. Records and their heavy
    pairs are counted where _own is, mixed and light pairs in every row.
    """
    heavy_total: dict[str, tuple[dict[str, int], np.ndarray]] = {}
    records: dict[str, int] = {}

    def emit(g: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g] * len(n), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], schema=_OUT)

    def flatten(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.diff(lists.offsets.to_numpy())
        return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False)

    def block(g: str, own: np.ndarray, heavy: pa.ListArray, light: pa.ListArray) -> Iterator[pa.RecordBatch]:
        n = len(heavy)
        records[g] = records.get(g, 0) + int(own.sum())
        member, item = flatten(heavy)
        index, total = heavy_total.get(g, ({}, np.zeros((0, 0), np.int64)))
        names, local = np.unique(item.astype(str), return_inverse=True) if len(item) else (np.empty(0, str), np.empty(0, np.int64))
        if len(names):
            for name in names.tolist():
                index.setdefault(name, len(index))
            if len(index) > len(total):
                grown = np.zeros((len(index), len(index)), np.int64)
                grown[: len(total), : len(total)] = total
                total = grown
            at = np.array([index[x] for x in names.tolist()])
            counts = heavy_pairs(member[own[member]], local[own[member]], n, len(names))
            total[np.ix_(at, at)] += np.triu(counts, 1)
            heavy_total[g] = (index, total)
        light_member, light_item = flatten(light)
        if len(light_item):
            light_names, light_code = np.unique(light_item.astype(str), return_inverse=True)
            if len(names):
                for at in range(0, len(light_names), 4096):
                    pick = (light_code >= at) & (light_code < at + 4096)
                    mixed = probe_pairs(light_member[pick], light_code[pick] - at, min(4096, len(light_names) - at), member, local, n, len(names))
                    a, b = np.nonzero(mixed)
                    if len(a):
                        yield emit(g, light_names[a + at], names[b], mixed[a, b])
            for a, b, count in light_pairs(light_member, light_code):
                yield emit(g, light_names[a], light_names[b], count)

    def across(g: str, left: pa.ListArray, right: pa.ListArray) -> Iterator[pa.RecordBatch]:
        """Every item of one chunk of a record with every item of another."""
        for i in range(len(left)):
            a, b = left[i].values.to_numpy(zero_copy_only=False), right[i].values.to_numpy(zero_copy_only=False)
            step = max(1, PAIR_CHUNK // max(1, len(b)))
            for low in range(0, len(a), step):
                part = a[low : low + step]
                yield emit(g, np.repeat(part, len(b)), np.tile(b, len(part)), np.ones(len(part) * len(b), np.int64))

    for batch in batches:
        groups = batch.column("_g").to_pandas()
        paired = pc.greater(pc.list_value_length(batch.column("_other")), 0).to_numpy(zero_copy_only=False)
        own = batch.column("_own").to_numpy(zero_copy_only=False)
        for g, at in groups.groupby(groups, sort=False).indices.items():
            pick = pa.array(at[~paired[at]])
            if len(pick):
                yield from block(g, own[at[~paired[at]]], batch.column("_heavy").take(pick), batch.column("_light").take(pick))
            if paired[at].any():
                pick = pa.array(at[paired[at]])
                yield from across(g, batch.column("_light").take(pick), batch.column("_other").take(pick))
    for g, (index, total) in heavy_total.items():
        names = np.array(list(index), dtype=object)
        # Slots are in order of first sight, so a pair may lie in either triangle.
        both = np.triu(total + total.T, 1)
        a, b = np.nonzero(both)
        if len(a):
            yield emit(g, names[a], names[b], both[a, b])
    for g, n in records.items():
        yield pa.RecordBatch.from_arrays([pa.array([g]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([n], pa.int64())], schema=_OUT)


def _wide_records(seen: DataFrame) -> tuple[DataFrame, int]:
    """((_wg, _wr, _chunks) of records with more than WIDE_RECORD items, how many)."""
    sizes = seen.groupBy(F.col("_g").alias("_wg"), F.col("_r").alias("_wr")).agg(F.count("*").alias("n")).filter(F.col("n") > WIDE_RECORD)
    return stage_counting(sizes.select("_wg", "_wr", F.ceil(F.col("n") / WIDE_RECORD).cast("int").alias("_chunks")), "wide-records")


def _baskets(items: DataFrame, wide: DataFrame, n_wide: int) -> DataFrame:
    """(_g, _own, _heavy, _light, _other) of records: arrays of one row hold about WIDE_RECORD items at most."""
    none = F.array().cast("array<string>")
    listed = [F.collect_list("_hi").alias("_heavy"), F.collect_list("_li").alias("_light")]
    if not n_wide:
        return items.groupBy("_g", "_r").agg(*listed).select("_g", F.lit(True).alias("_own"), "_heavy", "_light", none.alias("_other"))
    marked = items.join(wide, (F.col("_g") == F.col("_wg")) & (F.col("_r") == F.col("_wr")), "left")
    plain = marked.filter("_chunks is null").groupBy("_g", "_r").agg(*listed).select("_g", F.lit(True).alias("_own"), "_heavy", "_light", none.alias("_other"))
    # Items of a wide record go to a chunk, and to the block of their chunk with each other one; heavy ones to every chunk.
    chunk = F.pmod(F.xxhash64("_li"), F.col("_chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("_chunks") - 1)
    dealt = marked.filter("_chunks is not null").withColumn("_c", F.when(F.col("_li").isNotNull(), chunk)).withColumn("_x", F.explode(every))
    dealt = dealt.select("_g", "_r", "_hi", "_li", "_c", F.least(F.coalesce("_c", "_x"), "_x").alias("_low"), F.greatest(F.coalesce("_c", "_x"), "_x").alias("_high"))
    rows = dealt.groupBy("_g", "_r", "_low", "_high").agg(
        F.collect_list("_hi").alias("_heavy"), F.collect_list(F.when((F.col("_c") == F.col("_low")), F.col("_li"))).alias("_light"), F.collect_list(F.when((F.col("_c") == F.col("_high")) & (F.col("_low") < F.col("_high")), F.col("_li"))).alias("_other")
    )
    # A block with an empty side has no pair.
    rows = rows.filter("_low = _high or (size(_light) > 0 and size(_other) > 0)")
    return plain.unionAll(rows.select("_g", (F.col("_low") + F.col("_high") == 0).alias("_own"), "_heavy", "_light", "_other"))


def cooccurring_pairs(df: DataFrame, record: str, item: str, group: str, min_support: int = 1, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(group, item_a, item_b, n_ab, n_a, n_b, n_records, lift) of pairs in >= ``min_support`` records.

    A record is (``group``, ``record``); item_a < item_b by bytes; n_records counts the
    group's records with any item; lift is n_ab * n_records / (n_a * n_b). Repeats of an item
    in a record count once; rows with a null group, record or item are no incidence. Items
    below ``min_support`` records cannot be in a pair and leave before pairing. Empty input
    gives no rows; other columns are ignored. All keys come out as strings. A record with
    more than WIDE_RECORD items is dealt over tasks in chunks and pairs of chunks.
    """
    rows = df.select(F.col(group).cast("string").alias("_g"), F.col(record).cast("string").alias("_r"), F.col(item).cast("string").alias("_i"))
    seen = stage(rows.dropna().distinct(), "incidences")
    items = stage(seen.groupBy("_g", "_i").agg(F.count("*").alias("n")), "item-counts")
    total = items.agg(F.sum("n")).first()[0] or 0
    # At most 1 / heavy_share items reach this count, whatever the data: safe to broadcast.
    bound = max(1.0, total * heavy_share)
    heavy = items.filter(F.col("n") >= bound).select("_g", "_i", F.lit(True).alias("_h"))
    marked = seen.join(F.broadcast(heavy), ["_g", "_i"], "left")
    frequent = items.filter((F.col("n") < bound) & (F.col("n") >= min_support)).select("_g", "_i", F.lit(True).alias("_l"))
    # Heavy keys are out of this join: no light item has more than the heavy share of rows.
    light = marked.filter(F.col("_h").isNull()).join(frequent, ["_g", "_i"], "left").select("_g", "_r", F.lit(None).cast("string").alias("_hi"), F.when(F.col("_l"), F.col("_i")).alias("_li"))
    baskets = marked.filter(F.col("_h")).select("_g", "_r", F.col("_i").alias("_hi"), F.lit(None).cast("string").alias("_li")).unionAll(light)
    baskets = _baskets(baskets, *_wide_records(seen))
    partial = stage(baskets.mapInArrow(_count_blocks, SCHEMA), "pair-partials")
    sizes = partial.filter(F.col("_a").isNull()).groupBy("_g").agg(F.sum("n").alias("n_records"))
    pairs = partial.filter(F.col("_a").isNotNull()).groupBy("_g", F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= min_support)
    out = pairs.join(items.select("_g", F.col("_i").alias("_a"), F.col("n").alias("n_a")), ["_g", "_a"]).join(items.select("_g", F.col("_i").alias("_b"), F.col("n").alias("n_b")), ["_g", "_b"]).join(sizes, "_g")
    lift = F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b"))
    return out.select(F.col("_g").alias(group), F.col("_a").alias("item_a"), F.col("_b").alias("item_b"), "n_ab", "n_a", "n_b", "n_records", lift.alias("lift"))
