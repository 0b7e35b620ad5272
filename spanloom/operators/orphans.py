"""References to records that do not exist: bitmaps of references AND-NOT parents.

References and parent keys meet in one sorted layout by key. There each run of 65,536
distinct keys is a key range: its keys are dictionary-encoded to integers, the parents and
each period's references become compressed bitmaps over those integers, and the bits left
by reference AND-NOT parent decode to the keys that nothing defines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = 1 << 16
#: Below this many bits a sorted list is smaller than the bit set (2 bytes a value).
SPARSE = 4096
SALTS = 16
BUFFER_ROWS = 200_000
_NO_PERIOD = np.iinfo(np.int32).min


class Container:
    """A compressed set of integers below 65,536: a sorted list, or a bit set if dense."""

    __slots__ = ("bits", "values")

    def __init__(self, codes: np.ndarray):
        unique = np.unique(codes).astype(np.uint16)
        self.values, self.bits = unique, None
        if len(unique) >= SPARSE:
            self.values, self.bits = None, np.zeros(RANGE // 8, np.uint8)
            np.bitwise_or.at(self.bits, unique >> 3, (1 << (unique & 7)).astype(np.uint8))

    def contains(self, values: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return (self.bits[values >> 3] >> (values & 7).astype(np.uint8)) & 1 == 1
        if not len(self.values):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return self.values[at] == values

    def and_not(self, other: Container) -> np.ndarray:
        """Values here that ``other`` lacks, ascending."""
        if self.bits is not None and other.bits is not None:
            return np.flatnonzero(np.unpackbits(self.bits & ~other.bits, bitorder="little"))
        mine = self.values if self.bits is None else np.flatnonzero(np.unpackbits(self.bits, bitorder="little")).astype(np.uint16)
        return mine[~other.contains(mine)].astype(np.int64)


def _survivors(code: np.ndarray, is_ref: np.ndarray, period: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(codes, period) of references without parent in one key range."""
    parents = Container(code[~is_ref])
    refs, when = code[is_ref], period[is_ref]
    order = np.argsort(when, kind="stable")
    refs, when = refs[order], when[order]
    cuts = np.flatnonzero(np.diff(when)) + 1
    for part, at in zip(np.split(refs, cuts), np.concatenate(([0], cuts)).astype(int)):
        if len(part):
            left = Container(part).and_not(parents)
            if len(left):
                yield left, int(when[at])


def _bitmaps(batches: Iterator[pa.RecordBatch], buffer_rows: int) -> Iterator[pa.RecordBatch]:
    """Key-sorted rows (_k, _ref, _period) to (_k, _period) of orphan references."""

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table.column("_k").combine_chunks()
        new = np.ones(len(keys), bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        dictionary = keys.filter(pa.array(new))
        code = np.cumsum(new) - 1
        is_ref = table.column("_ref").combine_chunks().to_numpy(zero_copy_only=False)
        period = table.column("_period").combine_chunks().fill_null(_NO_PERIOD).to_numpy(zero_copy_only=False)
        low = 0
        for base in range(0, len(dictionary), RANGE):
            high = int(np.searchsorted(code, base + RANGE))
            for left, at in _survivors((code[low:high] - base).astype(np.int64), is_ref[low:high], period[low:high]):
                when = pa.array(np.full(len(left), at, np.int32), mask=np.full(len(left), at == _NO_PERIOD))
                yield pa.RecordBatch.from_arrays([dictionary.take(pa.array(left + base)), when], names=["_k", "_period"])
            low = high

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < buffer_rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("_k").combine_chunks()
        ends = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
        if not len(ends):
            continue
        cut = int(ends[-1]) + 1
        yield from flush(table.slice(0, cut))
        held, rows = table.slice(cut).to_batches(), len(table) - cut
    if held:
        yield from flush(pa.Table.from_batches(held))


def orphan_keys(refs: DataFrame, parents: DataFrame, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """(key, period) of references no parent defines.

    ``refs`` has columns key and period (int or null), ``parents`` has key, of the same type.
    Both are reduced to distinct values before the shuffle, so a key with a third of all
    references is one row per period. Null keys refer to nothing and define nothing.
    """
    both = (
        refs.filter(F.col("key").isNotNull())
        .select(F.col("key").alias("_k"), F.lit(True).alias("_ref"), F.col("period").cast("int").alias("_period"))
        .unionAll(parents.filter(F.col("key").isNotNull()).select(F.col("key").alias("_k"), F.lit(False).alias("_ref"), F.lit(None).cast("int").alias("_period")))
    )
    schema = T.StructType([T.StructField("_k", both.schema["_k"].dataType), T.StructField("_period", T.IntegerType())])
    left = both.distinct().repartition("_k").sortWithinPartitions("_k").mapInArrow(lambda batches: _bitmaps(batches, buffer_rows), schema)
    return left.select(F.col("_k").alias("key"), F.col("_period").alias("period"))


def orphan_references(refs: DataFrame, parents: DataFrame, buffer_rows: int = BUFFER_ROWS) -> DataFrame:
    """Distinct (row_key, key, period) of references whose key no parent defines.

    ``refs`` has row_key, key and period; ``parents`` has key. A parent counts whenever it
    arrives. Null keys are no reference; a null period stays null; repeated rows come out
    once; empty inputs give no rows, and with no parents every reference is an orphan.
    Orphan keys are replicated over SALTS shares for the way back to their rows, so a
    missing key with most of the references spreads too.
    """
    missing = orphan_keys(refs, parents, buffer_rows).select("key").distinct()
    spread = missing.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = refs.select("row_key", "key", "period").withColumn("_salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    # Salting multiplies the orphan keys after their size is known; a merge keeps that off the driver.
    return salted.join(spread.hint("merge"), ["key", "_salt"], "left_semi").select("row_key", "key", "period").distinct()
