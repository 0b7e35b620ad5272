"""Calls from index occurrences: references inside bodies that the source shows to be calls."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.operators.intervals import innermost
from spanloom.sources.scip import ROLES, definitions

_TYPE_ARGUMENTS = re.compile(r"<(?:[^<>()]|<(?:[^<>()]|<[^<>()]*>)*>)*>\s*\(")


def is_call_site(lines: list[str], line: int, end: int) -> bool | None:
    """Whether the identifier that ends at ``end`` of 0-based ``line`` is called.

    A ``(`` must follow, over white space, type arguments or a line break; None if there is
    no such line.
    """
    if not 0 <= line < len(lines):
        return None
    rest = lines[line][end:].lstrip()
    if rest.startswith("("):
        return True
    if rest.startswith("<"):
        return _TYPE_ARGUMENTS.match(rest) is not None
    return rest == "" and line + 1 < len(lines) and lines[line + 1].lstrip().startswith("(")


def function_extent(lines: list[str], line: int, col: int) -> tuple[int, int] | None:
    """(first, last) 1-based lines of a function that starts at ``line`` and 0-based ``col``.

    Brackets are counted outside strings and comments. A block body ends with its brace; an
    expression body at the comma, semicolon or closing bracket behind it.
    """
    if not 1 <= line <= len(lines):
        return None
    depth, in_block, quote = 0, False, ""
    for number in range(line - 1, len(lines)):
        text = lines[number]
        at = col if number == line - 1 else 0
        while at < len(text):
            c = text[at]
            at += 1
            if quote:
                if c == "\\":
                    at += 1
                elif c == quote:
                    quote = ""
                continue
            if c in "'\"`":
                quote = c
            elif c == "/" and text[at : at + 1] == "/":
                break
            elif c in "([{":
                in_block = in_block or c == "{" and depth == 0
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0 or c == "}" and depth == 0 and in_block:
                    return line, number + 1
            elif c in ",;" and depth == 0 and not in_block:
                return line, number + 1
    return None


def derive_calls(index: DataFrame, sources: DataFrame | None, local_packages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, skipped counts by reason).

    calls: src_symbol (innermost body, else the file's module), dst_symbol, path, line, col,
    confidence: certain for a target defined here, inferred for an external one, unresolved
    for a namespace that the source shows called. ``sources`` (path, content) turns the
    call-site check on; without it references by name leak through.
    """
    occ = index.select("path", F.posexplode("occurrences").alias("at", "o")).select("path", "at", "o.*")
    kind = S.symbol_kind(F.col("symbol"))
    bit = lambda name: F.col("roles").bitwiseAND(ROLES[name]) != 0
    reason = (
        F.when(bit("Definition"), "definition").when(bit("Import"), "import").when(F.col("symbol").startswith("local "), "local").when(kind.isin("type", "typeParameter"), "typePosition").when(kind.isin("parameter", "meta"), "parameter").when(kind == "unknown", "container")
    )
    marked = occ.withColumn("kind", kind).withColumn("skip", reason)
    if sources is not None:
        text = sources.select("path", F.col("content").alias("_text"))

        @F.pandas_udf("boolean")
        def called(content: pd.Series, line: pd.Series, end: pd.Series) -> pd.Series:
            split: dict[str, list[str]] = {}
            return pd.Series([None if c is None else is_call_site(split.setdefault(c, c.splitlines()), n, e) for c, n, e in zip(content, line, end)], dtype=object)

        live = marked.filter("skip is null").join(text, "path", "left").withColumn("_called", called("_text", "end_line", "end_col")).drop("_text")
        live = live.withColumn("skip", F.when(~F.coalesce("_called", F.lit(False)), "notACall")).drop("_called")
    else:
        live = marked.filter("skip is null").withColumn("skip", F.when(F.col("kind") == "namespace", "container"))
    counts = marked.filter("skip is not null").select("skip").unionByName(live.filter("skip is not null").select("skip")).groupBy(F.col("skip").alias("reason")).agg(F.count("*").alias("n"))
    refs = live.filter("skip is null").select("path", "at", "symbol", "kind", (F.col("start_line") + 1).alias("line"), F.col("start_col").alias("col"))
    bodies = definitions(index).withColumn("kind", S.symbol_kind(F.col("symbol")))
    ranges = bodies.filter("kind in ('method', 'term') and end_line > start_line").select("path", F.col("symbol").alias("src_symbol"), "start_line", "end_line")
    modules = bodies.filter("kind = 'namespace'").groupBy("path").agg(F.min("symbol").alias("_module"))
    keyed = refs.withColumn("_path", F.col("path"))
    owner = innermost(keyed.select("path", "_path", "at", "line"), ranges, "path", ["_path", "at"], "line", "src_symbol", "start_line", "end_line")
    defined = bodies.select(F.col("symbol").alias("_def")).distinct()
    local = F.lit(False) if local_packages is None else S.package_of(F.col("symbol")).isin(*local_packages)
    joined = keyed.join(owner, ["_path", "at"], "left").join(modules, "path", "left").join(defined, F.col("symbol") == F.col("_def"), "left")
    confidence = F.when(F.col("kind") == "namespace", "unresolved").when(F.col("_def").isNotNull() | local, "certain").otherwise("inferred")
    calls = joined.select(F.coalesce("src_symbol", "_module", "path").alias("src_symbol"), F.col("symbol").alias("dst_symbol"), "path", "line", "col", confidence.alias("confidence"), F.col("src_symbol").isNull().alias("from_module_scope"))
    return calls.dropDuplicates(["src_symbol", "dst_symbol", "path", "line"]), counts
