"""Vectors: cosine similarity and the binary form of stored vectors."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAGIC = b"f32"


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; vectors of unlike length raise."""
    pairs = F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))).otherwise(F.raise_error(F.lit("vectors of unlike dimension")).cast("array<double>"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def encode_vector(values: list[float]) -> bytes:
    """``f32``, a little-endian count, then 32-bit floats."""
    return _MAGIC + struct.pack(f"<I{len(values)}f", len(values), *values)


def decode_vector(blob: bytes) -> list[float]:
    if blob[:3] != _MAGIC or len(blob) < 7:
        raise ValueError("no f32 vector")
    (n,) = struct.unpack_from("<I", blob, 3)
    if len(blob) != 7 + 4 * n:
        raise ValueError(f"a vector of {n} floats takes {7 + 4 * n} bytes, not {len(blob)}")
    return list(struct.unpack_from(f"<{n}f", blob, 7))
