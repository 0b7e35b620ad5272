"""SCIP code indexes: a protobuf wire decoder as an Arrow-batched source, and its statistics."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field numbers of the public SCIP schema, and the bits of symbol roles.
INDEX_DOCUMENTS, INDEX_EXTERNAL = 2, 3
DOC_PATH, DOC_OCCURRENCES, DOC_SYMBOLS, DOC_LANGUAGE = 1, 2, 3, 4
OCC_RANGE, OCC_SYMBOL, OCC_ROLES, OCC_SYNTAX, OCC_ENCLOSING = 1, 2, 3, 5, 7
SYM_SYMBOL, SYM_DOC, SYM_KIND, SYM_DISPLAY, SYM_ENCLOSING = 1, 3, 5, 6, 8
ROLES = {"Definition": 1, "Import": 2, "WriteAccess": 4, "ReadAccess": 8, "Generated": 16, "Test": 32, "ForwardDefinition": 64}

SCHEMA = (
    "source string, path string, language string,"
    " occurrences array<struct<symbol:string,roles:int,syntax_kind:int,start_line:int,start_col:int,end_line:int,end_col:int,enclosing_start:int,enclosing_end:int>>,"
    " symbols array<struct<symbol:string,display_name:string,kind:int,enclosing_symbol:string,documentation:array<string>>>"
)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated varint")
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a message: varints, 32/64-bit words, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated field")
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise ValueError("truncated word")
            (value,) = struct.unpack_from("<Q" if wire == 1 else "<I", data, at)
            at += size
        else:
            raise ValueError(f"wire type {wire} is unknown")
        yield number, value


def ints(values: list[int | bytes]) -> list[int]:
    """Repeated int32 values, packed or not."""
    out: list[int] = []
    for value in values:
        if isinstance(value, bytes):
            at = 0
            while at < len(value):
                one, at = _varint(value, at)
                out.append(one)
        else:
            out.append(value)
    return [v - (1 << 64) if v >= 1 << 63 else v for v in out]


def _gather(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(data):
        out.setdefault(number, []).append(value)
    return out


def _text(found: dict[int, list], number: int) -> str:
    return found[number][-1].decode("utf-8") if number in found else ""


def _span(values: list[int]) -> tuple[int, int, int, int] | None:
    """Three numbers stay on one line, four don't."""
    if len(values) == 3:
        return values[0], values[1], values[0], values[2]
    return tuple(values) if len(values) == 4 else None


def decode_index(data: bytes, source: str = "") -> list[dict]:
    """Documents of an Index message as rows of SCHEMA."""
    rows = []
    for document in _gather(data).get(INDEX_DOCUMENTS, []):
        doc = _gather(document)
        occurrences, symbols = [], []
        for raw in doc.get(DOC_OCCURRENCES, []):
            occ = _gather(raw)
            span, outer = _span(ints(occ.get(OCC_RANGE, []))), _span(ints(occ.get(OCC_ENCLOSING, [])))
            if span is None:
                continue
            occurrences.append(
                {"symbol": _text(occ, OCC_SYMBOL), "roles": occ.get(OCC_ROLES, [0])[-1], "syntax_kind": occ.get(OCC_SYNTAX, [0])[-1], "start_line": span[0], "start_col": span[1], "end_line": span[2], "end_col": span[3], "enclosing_start": outer[0] if outer else None, "enclosing_end": outer[2] if outer else None}
            )
        for raw in doc.get(DOC_SYMBOLS, []):
            sym = _gather(raw)
            symbols.append({"symbol": _text(sym, SYM_SYMBOL), "display_name": _text(sym, SYM_DISPLAY), "kind": sym.get(SYM_KIND, [0])[-1], "enclosing_symbol": _text(sym, SYM_ENCLOSING), "documentation": [d.decode("utf-8") for d in sym.get(SYM_DOC, [])]})
        rows.append({"source": source, "path": _text(doc, DOC_PATH), "language": _text(doc, DOC_LANGUAGE), "occurrences": occurrences, "symbols": symbols})
    return rows


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of every index file under ``path``; a malformed file fails the read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_schema)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = decode_index(content, name)
                for low in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[low : low + 500], schema=schema)

    from pyspark.sql.types import _parse_datatype_string

    _schema = _parse_datatype_string(SCHEMA)
    return files.mapInArrow(decode, _schema)


def definitions(index: DataFrame) -> DataFrame:
    """(source, path, symbol, start_line, end_line), 1-based, of global definitions with a body."""
    occ = index.select("source", "path", F.explode("occurrences").alias("o"))
    return occ.filter((F.col("o.roles").bitwiseAND(ROLES["Definition"]) != 0) & ~F.col("o.symbol").startswith("local ")).select(
        "source", "path", F.col("o.symbol").alias("symbol"), (F.coalesce("o.enclosing_start", "o.start_line") + 1).alias("start_line"), (F.coalesce("o.enclosing_end", "o.end_line") + 1).alias("end_line"), (F.col("o.start_line") + 1).alias("name_line")
    )


def summarise(index: DataFrame) -> DataFrame:
    """(metric, value): counts, field coverage, and histograms of roles and syntax kinds."""
    occ = index.select(F.explode("occurrences").alias("o")).select("o.*")
    sym = index.select(F.explode("symbols").alias("s")).select("s.*")
    one = lambda df, name, col: df.agg(col.alias("value")).select(F.lit(name).alias("metric"), F.col("value").cast("long"))
    n_if = lambda c: F.count_if(c)
    parts = [one(index, "documents", F.count("*")), one(occ, "occurrences", F.count("*")), one(occ, "definitions", n_if(F.col("roles").bitwiseAND(1) != 0)), one(occ, "references", n_if(F.col("roles").bitwiseAND(1) == 0)), one(occ, "with_enclosing_range", n_if(F.col("enclosing_start").isNotNull())), one(sym, "symbols", F.count("*"))]
    parts += [one(sym, f"with_{c}", n_if(F.col(c) != "")) for c in ("display_name", "enclosing_symbol")]
    parts += [one(occ, f"role_{name}", n_if(F.col("roles").bitwiseAND(bit) != 0)) for name, bit in ROLES.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.unionByName(occ.groupBy("syntax_kind").count().select(F.concat(F.lit("syntax_kind_"), "syntax_kind").alias("metric"), F.col("count").alias("value")))
