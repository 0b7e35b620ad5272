"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The rank of a confidence, for SQL.
RANK_SQL = "case confidence when 'certain' then 3 when 'observed' then 2 when 'inferred' then 1 else 0 end"
NAME_SQL = "case {0} when 3 then 'certain' when 2 then 'observed' when 1 then 'inferred' else 'unresolved' end"
#: Edges once per identity, the first by id.
EDGES_SQL = "(select * from edges qualify row_number() over (partition by src_node_id, dst_node_id, type, evidence_kind, coalesce(file_id, -1), coalesce(line, -1) order by edge_id) = 1)"
#: Module namespaces, by the end of their key.
SPACES_SQL = "(select node_id from nodes where kind = 'symbol' and ends_with(key, '/'))"
