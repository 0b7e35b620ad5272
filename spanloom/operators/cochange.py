"""Files that change together: market-basket pairs over commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A commit with more known files says little about pairs; it is skipped and counted.
WIDE_COMMIT = 30
PEERS = 10


def commit_files(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, skipped): distinct (sha, file), and the wide commits with their size."""
    rows = commits.select("sha", "file").dropna().distinct()
    sizes = rows.groupBy("sha").agg(F.count("*").alias("n_files"))
    skipped = sizes.filter(F.col("n_files") > WIDE_COMMIT)
    return rows.join(sizes.filter(F.col("n_files") <= WIDE_COMMIT).select("sha"), "sha", "left_semi"), skipped


def co_changed(commits: DataFrame) -> DataFrame:
    """(file_a, file_b, commits, support_a, support_b) with file_a < file_b.

    Support is the share of a file's own commits that the pair makes up; both count narrow
    commits only, so a commit adds at most WIDE_COMMIT squared pairs.
    """
    rows, _ = commit_files(commits)
    totals = rows.groupBy("file").agg(F.count("*").alias("n"))
    other = rows.select("sha", F.col("file").alias("file_b"))
    pairs = rows.withColumnRenamed("file", "file_a").join(other, "sha").filter("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("commits"))
    a, b = totals.select(F.col("file").alias("file_a"), F.col("n").alias("_a")), totals.select(F.col("file").alias("file_b"), F.col("n").alias("_b"))
    return pairs.join(a, "file_a").join(b, "file_b").select("file_a", "file_b", "commits", (F.col("commits") / F.col("_a")).alias("support_a"), (F.col("commits") / F.col("_b")).alias("support_b"))


def peers(pairs: DataFrame, limit: int = PEERS) -> DataFrame:
    """(file, peer, commits, support): the strongest partners of each file, by its own support."""
    from pyspark.sql import Window

    both = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("peer"), "commits", F.col("support_a").alias("support")).unionByName(pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("peer"), "commits", F.col("support_b").alias("support")))
    order = Window.partitionBy("file").orderBy(F.desc("support"), F.desc("commits"), "peer")
    return both.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= limit).drop("_at")
