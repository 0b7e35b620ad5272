"""Extractors over files as DataFrames: one task reads its own files, facts come out as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.extract import cfg, js_source, python_source
from spanloom.extract.model import enclosing

FINDINGS = "path string, kind string, line int, col int, name string, detail string, base_var string, url_path string, dynamic boolean, function_name string, function_line int, function_end int, problem string"
FUNCTIONS = "path string, name string, start_line int, end_line int, problem string"
BLOCKS = "path string, function_name string, function_line int, function_end int, block_index int, parent_index int, kind string, condition_text string, outcome string, exit_form string, error_name string, start_line int, end_line int, problem string"
CHECKS = "path string, line int, function_line int, name string, check_kind string, detail string, problem string"


def _front_end(lang: str):
    return python_source if lang == "python" else js_source


def _map(files: DataFrame, schema: str, work) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, lang, content in zip(part["path"], part["lang"], part["content"]):
                try:
                    rows = work(path, lang, content or "")
                except (SyntaxError, ValueError, RecursionError) as problem:  # a file that cannot be read is a row, not a failed job
                    rows = [{"path": path, "problem": f"{type(problem).__name__}: {problem}"}]
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    known = files.filter(F.col("lang").isin("python", "javascript", "typescript"))
    return known.select("path", "lang", "content").mapInPandas(run, schema)


def functions(files: DataFrame) -> DataFrame:
    """One row per function; a file that cannot be parsed is one row with its problem."""
    return _map(files, FUNCTIONS, lambda path, lang, text: [{"path": path, "name": f.name, "start_line": f.start, "end_line": f.end} for f in _front_end(lang).parse(text).functions])


def findings(files: DataFrame) -> DataFrame:
    """Throws, config reads, SQL, HTTP calls, URLs and env bindings, with the function around each."""

    def work(path: str, lang: str, text: str) -> list[dict]:
        source = _front_end(lang).parse(text)
        rows = []
        for f in source.findings:
            around = enclosing(source.functions, f.line)
            rows.append({"path": path, "kind": f.kind, "line": f.line, "col": f.col, "name": f.name, "detail": f.detail, "base_var": f.base_var, "url_path": f.path, "dynamic": f.dynamic, "function_name": around.name if around else None, "function_line": around.start if around else None, "function_end": around.end if around else None})
        return rows

    return _map(files, FINDINGS, work)


def control_flow(files: DataFrame, error_builders: set[str]) -> DataFrame:
    """Control-flow blocks of every function."""

    def work(path: str, lang: str, text: str) -> list[dict]:
        return [{"path": path, "function_name": f.name, "function_line": f.start, "function_end": f.end, **vars(b)} for f in _front_end(lang).parse(text).functions for b in cfg.build(f, error_builders)]

    return _map(files, BLOCKS, work)


def inline_checks(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Security checks inside function bodies."""
    keys = ("line", "function_line", "name", "check_kind", "detail")
    return _map(files, CHECKS, lambda path, lang, text: [{"path": path, **dict(zip(keys, row))} for row in _front_end(lang).inline_checks(text, rules)])


def attribute(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """``facts`` (path, line) with owner: the innermost symbol around the line, else the file.

    ``symbols`` has path, symbol, symbol_kind, start_line, end_line; namespaces own nothing.
    """
    from spanloom.operators.intervals import innermost

    owners = symbols.filter("symbol_kind <> 'namespace'").select("path", "symbol", "start_line", "end_line")
    points = facts.filter("line is not null").select(F.col("path"), F.col("path").alias("at_path"), F.col("line").alias("at_line"), "line").distinct()
    found = innermost(points, owners, "path", ["at_path", "at_line"], "line", "symbol", "start_line", "end_line")
    joined = facts.join(found, (F.col("path") == F.col("at_path")) & (F.col("line") == F.col("at_line")), "left")
    return joined.withColumn("owner", F.coalesce("symbol", "path")).withColumn("owner_kind", F.when(F.col("symbol").isNull(), "file").otherwise("symbol")).drop("at_path", "at_line", "symbol")


def key_blocks(blocks: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with symbol, unkeyed functions): blocks by the symbol that starts on their line."""
    starts = symbols.filter("symbol_kind in ('method', 'term')").groupBy("path", F.col("start_line").alias("function_line")).agg(F.min("symbol").alias("symbol"))
    joined = blocks.filter("problem is null").join(starts, ["path", "function_line"], "left")
    return joined.filter("symbol is not null"), joined.filter("symbol is null").select("path", "function_line", "function_name").distinct()
