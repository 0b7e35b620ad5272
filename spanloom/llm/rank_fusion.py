"""One ranking from several differently scaled scores: weighted median rank aggregation.

Only the rank of an item within a score counts, so no score's range or distribution can
decide alone. Ranks come from a range sort with partition offsets: a query with a third of
all hits is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ranged import TOTAL, range_totals, with_global

SALTS = 16


def _weighted_median(ranks: Column) -> Column:
    """Middle of an array of (rank, weight) sorted by rank; the mean of both middles on a tie."""
    whole = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x["weight"])
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(state: Column, x: Column) -> Column:
        cum = state["cum"] + x["weight"]
        return F.struct(
            cum.alias("cum"),
            F.coalesce(state["low"], F.when(cum * 2 >= whole, x["rank"].cast("double"))).alias("low"),
            F.coalesce(state["high"], F.when(cum * 2 > whole, x["rank"].cast("double"))).alias("high"),
        )

    return F.aggregate(ranks, start, step, lambda s: (s["low"] + F.coalesce(s["high"], s["low"])) / 2)


def median_ranks(hits: DataFrame, scores: DataFrame, query: str, item: str, score_id: str, score: str, order: str, weight: str | None = None) -> DataFrame:
    """(query, item, median_rank, mean_rank, n_scores) of every scored item of every query.

    ``scores`` has one row per ``score_id`` with ``order`` (``asc``: low is better, anything
    else: high is better) and optionally a positive ``weight`` (default 1); a score it lacks
    counts as high-is-better with weight 1. Null and NaN scores and rows with a null query,
    item or score id are not scored. Repeated hits of an item in a score count once, at
    their best score; ties share the smallest rank. An item that a score of its query does
    not list ranks just behind that score's last item, so few appearances are no advantage.
    Empty input gives no rows; other columns are ignored.
    """
    how = scores.groupBy(F.col(score_id).alias("_s")).agg(F.min(F.col(order)).alias("_o"), (F.max(F.col(weight)) if weight else F.lit(1.0)).cast("double").alias("_w"))
    rows = hits.select(F.col(query).alias("_q"), F.col(item).alias("_i"), F.col(score_id).alias("_s"), F.col(score).cast("double").alias("_v"))
    rows = rows.filter(F.col("_q").isNotNull() & F.col("_i").isNotNull() & F.col("_s").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.join(how, "_s", "left").select("_q", "_s", "_i", F.coalesce("_w", F.lit(1.0)).alias("_w"), F.when(F.col("_o") == "asc", F.col("_v")).otherwise(-F.col("_v")).alias("_v"))
    once = rows.groupBy("_q", "_s", "_i").agg(F.min("_v").alias("_v"), F.first("_w").alias("_w")).withColumn("_one", F.lit(1).cast("long"))
    ranged = range_totals(once, ["_q", "_s"], ["_v"], "_one", "score-ranks", rank=True)
    ranks = with_global(ranged, "_rank")
    # Both groups hold at most one element per score.
    own = ranks.groupBy("_q", "_i").agg(F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col("_w").alias("weight"))).alias("own"), F.collect_set("_s").alias("seen"))
    sizes = ranged.fragments.groupBy("_q", "_s").agg(F.max(TOTAL).alias("n")).join(how, "_s", "left")
    lists = sizes.groupBy("_q").agg(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("n"), F.coalesce("_w", F.lit(1.0)).alias("w"))).alias("lists"))
    # Items of one query spread over salts; its one row of list sizes is repeated for each.
    lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(SALTS)).cast("int"))
    absent = F.transform(F.filter("lists", lambda x: ~F.array_contains("seen", x["s"])), lambda x: F.struct((x["n"] + 1).alias("rank"), x["w"].alias("weight")))
    full = own.join(lists, ["_q", "_salt"]).select("_q", "_i", F.size("own").alias("n_scores"), F.sort_array(F.concat("own", absent)).alias("ranks"))
    mean = F.aggregate("ranks", F.lit(0.0), lambda a, x: a + x["rank"] * x["weight"]) / F.aggregate("ranks", F.lit(0.0), lambda a, x: a + x["weight"])
    return full.select(F.col("_q").alias(query), F.col("_i").alias(item), _weighted_median(F.col("ranks")).alias("median_rank"), mean.alias("mean_rank"), "n_scores")


def best_items(ranks: DataFrame, query: str, item: str) -> DataFrame:
    """First item of each query, by median rank, mean rank and identifier."""
    best = ranks.groupBy(query).agg(F.min(F.struct("median_rank", "mean_rank", F.col(item).alias("_i"))).alias("_b"))
    return best.select(query, F.col("_b._i").alias(item))


def positions(ranks: DataFrame, query: str, item: str) -> DataFrame:
    """``ranks`` with ``position`` 1, 2, ... within the query, again by range sort and offsets."""
    ranged = range_totals(ranks.withColumn("_one", F.lit(1).cast("long")), [query], ["median_rank", "mean_rank", item], "_one", "rank-positions")
    return with_global(ranged, "position").drop("_one")
