"""Row-level changes as set operations: every mutation is a new snapshot of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.schema import ENUMS, STATIC_EVIDENCE, TABLES


def first_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` plus the rows of ``new`` whose key it lacks; of new repeats the smallest row."""
    fresh = new.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    cond = [old[k].eqNullSafe(fresh[k]) for k in keys]
    return old.unionByName(fresh.join(old, cond, "left_anti"))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Upsert: rows of ``new`` replace rows of ``old`` with their key; of new repeats the last by ``order``."""
    pick = F.max_by(F.struct(*new.columns), F.col(order)) if order else F.max(F.struct(*new.columns))
    fresh = new.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(pick.alias("_r")).select("_r.*")
    cond = [old[k].eqNullSafe(fresh[k]) for k in keys]
    return old.join(fresh, cond, "left_anti").unionByName(fresh)


def replace_group(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Wholesale replacement: every group that ``new`` names is taken from ``new``."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is not true; null keeps the row."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def delete_by_provenance(rows: DataFrame, files: DataFrame, evidence: list[str] | None) -> DataFrame:
    """Rows without those of ``files`` (file_id) and, where given, of the evidence kinds.

    An empty evidence list deletes nothing; None means the table has no evidence column to ask.
    """
    if evidence is not None and not evidence:
        return rows
    doomed = files.select(F.col("file_id").alias("_f")).distinct().withColumn("_gone", F.lit(True))
    marked = rows.join(doomed, F.col("file_id") == F.col("_f"), "left")
    gone = F.coalesce("_gone", F.lit(False))
    if evidence is not None:
        gone = gone & F.col("evidence_kind").isin(*evidence)
    return marked.filter(~gone).select(*rows.columns)


def purge(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """What a re-index of ``files`` forgets: their static facts; boot, otel and manual facts stay.

    Unresolved calls and control flow go whatever their evidence; nodes are never deleted.
    """
    out = dict(tables)
    for name in ("edges", "route_chain"):
        if name in out:
            out[name] = delete_by_provenance(out[name], files, STATIC_EVIDENCE)
    for name in ("unresolved_calls", "function_cfg"):
        if name in out:
            out[name] = delete_by_provenance(out[name], files, None)
    return out


def forget_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """Deleted files cascade to every row that names them, of any evidence."""
    gone = files.select("file_id").distinct()
    return {name: rows.join(gone, "file_id", "left_anti") if "file_id" in rows.columns and name != "symbols" else rows for name, rows in tables.items()}


def diff_files(before: DataFrame, after: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, change): ``added``, ``changed``, ``deleted`` or ``unchanged`` by content digest."""
    a = before.groupBy(*keys).agg(F.max(digest).alias("_old"), F.lit(True).alias("_was"))
    b = after.groupBy(*keys).agg(F.max(digest).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def plan_derivations(n_touched: int, force: bool) -> list[str]:
    """What an index run derives again: everything once anything was touched, or by force."""
    steps = ["scip", "treesitter", "cfg", "boot"]
    return steps if force or n_touched else []


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, problem, n_rows): broken references and values outside their enum.

    One anti join per reference, over distinct keys that are counted first, so a key that
    many rows share is one row.
    """
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "table_name string, column_name string, problem string, n_rows long")
    for name, rows in tables.items():
        for column, (target, key) in TABLES[name].references.items():
            if target not in tables:
                continue
            counted = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("n"))
            broken = counted.join(tables[target].select(F.col(key).alias("_k")), "_k", "left_anti")
            out = out.unionByName(broken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit("reference").alias("problem"), "n_rows"))
    for (name, column), values in ENUMS.items():
        if name in tables:
            bad = tables[name].filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))
            out = out.unionByName(bad.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit("enum").alias("problem"), "n_rows"))
    return out
