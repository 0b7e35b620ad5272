"""Per-key results when a few keys hold most rows: dense accumulator arrays.

Work is cut by input split, never by key. Each split dictionary-encodes its keys and
reduces with ``numpy.bincount`` and scatter operations; what leaves a split is one row per
distinct key. A global dictionary gives keys dense codes, codes fall into blocks, and
blocks of accumulator arrays are summed in two rounds. A key with a third of all rows
costs its splits no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators.ranged import dense_codes
from spanloom.session import stage

BLOCK = 8192
SPLIT_ROWS = 400_000
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_MEASURES = "n long, n_values long, total long, least long, most long, last long"
_ARRAYS = "n array<long>, n_values array<long>, total array<long>, least array<long>, most array<long>, last array<long>"


def _reduce(code: np.ndarray, size: int, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Scatter-reduce measures to ``size`` slots."""
    out = {k: np.zeros(size, np.int64) for k in ("n", "n_values", "total")}
    for k in out:
        np.add.at(out[k], code, rows[k])
    out["least"], out["most"], out["last"] = np.full(size, _HIGH), np.full(size, _LOW), np.full(size, _LOW)
    np.minimum.at(out["least"], code, rows["least"])
    np.maximum.at(out["most"], code, rows["most"])
    np.maximum.at(out["last"], code, rows["last"])
    return out


def _split_partials(batches: Iterator[pa.RecordBatch], split_rows: int) -> Iterator[pa.RecordBatch]:
    """One row per distinct key of each run of ``split_rows`` rows of the split."""
    from pyspark import TaskContext

    split = TaskContext.get().partitionId()

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        encoded = table.column("_k").combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        code, keys = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
        value, seen = table.column("_v").combine_chunks(), table.column("_t").combine_chunks()
        has_value, has_seen = value.is_valid().to_numpy(zero_copy_only=False), seen.is_valid().to_numpy(zero_copy_only=False)
        v, t = value.fill_null(0).to_numpy(zero_copy_only=False), seen.fill_null(0).to_numpy(zero_copy_only=False)
        size = len(keys)
        n = np.bincount(code, minlength=size)
        n_values = np.bincount(code[has_value], minlength=size)
        total, least, most, last = np.zeros(size, np.int64), np.full(size, _HIGH), np.full(size, _LOW), np.full(size, _LOW)
        np.add.at(total, code, v)
        np.minimum.at(least, code[has_value], v[has_value])
        np.maximum.at(most, code[has_value], v[has_value])
        np.maximum.at(last, code[has_seen], t[has_seen])
        return pa.RecordBatch.from_arrays([keys, pa.array(np.full(size, split, np.int64)), *(pa.array(x.astype(np.int64)) for x in (n, n_values, total, least, most, last))], names=["_k", "_split", "n", "n_values", "total", "least", "most", "last"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= split_rows:
            yield flush(held)
            held, rows = [], 0
    if held:
        yield flush(held)


def _to_arrays(group: pd.DataFrame) -> pd.DataFrame:
    """Rows of one (block, share) scattered into one row of dense arrays."""
    out = _reduce(group["_slot"].to_numpy(), int(group["_slot"].max()) + 1, {k: group[k].to_numpy() for k in ("n", "n_values", "total", "least", "most", "last")})
    return pd.DataFrame({"_block": [group["_block"].iloc[0]], **{k: [v] for k, v in out.items()}})


def _sum_arrays(group: pd.DataFrame, block: int) -> pd.DataFrame:
    """Arrays of one block reduced slot by slot, decoded to (code, measures)."""
    size = max(len(x) for x in group["n"])
    out = {k: np.zeros(size, np.int64) for k in ("n", "n_values", "total")} | {"least": np.full(size, _HIGH), "most": np.full(size, _LOW), "last": np.full(size, _LOW)}
    for k, step in (("n", np.add), ("n_values", np.add), ("total", np.add), ("least", np.minimum), ("most", np.maximum), ("last", np.maximum)):
        for x in group[k]:
            part = out[k][: len(x)]
            step(part, np.asarray(x), out=part)
    there = np.flatnonzero(out["n"])
    return pd.DataFrame({"_code": group["_block"].iloc[0] * block + there, **{k: v[there] for k, v in out.items()}})


def dense_key_stats(df: DataFrame, key: str, value: str | None = None, observed: str | None = None, block: int = BLOCK, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Per-key counts, sums and last observation, balanced whatever the key skew.

    ``value`` is an integer column, ``observed`` a timestamp. Returns key_value (type of
    ``key``), n_rows, n_values (non-null values), sum_value, min_value, max_value and
    last_observed; the last four are null for a key without such values. Every row counts,
    repeats too. A null key is a key of its own. An empty input gives no rows. Other columns
    of ``df`` are ignored, whatever their names. ``block`` slots make one accumulator array and
    ``split_rows`` rows are reduced at once: the result is the same for any.
    """
    spark = df.sparkSession
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.select(
        F.col(key).alias("_k"),
        (F.col(value).cast("long") if value else F.lit(None).cast("long")).alias("_v"),
        (micros(observed) if observed else F.lit(None).cast("long")).alias("_t"),
    )
    kind = rows.schema["_k"].dataType
    schema = T.StructType([T.StructField("_k", kind), T.StructField("_split", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n", "n_values", "total", "least", "most", "last"))])
    partials = stage(rows.mapInArrow(lambda batches: _split_partials(batches, split_rows), schema), "key-partials")
    codes = stage(dense_codes(partials, "_k", "_code", "key-order"), "key-codes")
    # Few splits feed few shares; the square root keeps both rounds of the reduction narrow.
    last_split = partials.agg(F.max("_split")).first()[0] or 0
    shares = max(1, math.isqrt(last_split + 1))
    coded = partials.join(codes, partials["_k"].eqNullSafe(codes["_k"])).select(
        F.expr(f"_code div {block}").alias("_block"), F.pmod("_code", F.lit(block)).cast("int").alias("_slot"), F.pmod("_split", F.lit(shares)).alias("_share"), "n", "n_values", "total", "least", "most", "last"
    )
    arrays = coded.groupBy("_block", "_share").applyInPandas(_to_arrays, f"_block long, {_ARRAYS}")
    summed = arrays.groupBy("_block").applyInPandas(lambda group: _sum_arrays(group, block), f"_code long, {_MEASURES}")
    some = lambda c, when: F.when(when, F.col(c))
    has = F.col("n_values") > 0
    return summed.join(codes, "_code").select(
        F.col("_k").alias("key_value"),
        F.col("n").alias("n_rows"),
        "n_values",
        some("total", has).alias("sum_value"),
        some("least", has).alias("min_value"),
        some("most", has).alias("max_value"),
        F.when(F.col("last") > F.lit(_LOW), F.timestamp_micros("last")).cast("timestamp_ntz").alias("last_observed"),
    )
