"""Mixing sources to target weights: capped water-filling with seeded repetitions.

Sizes are token totals per source. Sources that cannot reach their share even at their
repeat cap are clamped there; what they leave goes to the others in proportion to their
targets, again and again until nobody is over its cap. Each document is then used a whole
number of times plus, by a seeded hash, one more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Share:
    """Plan for one source: tokens at hand and used, and uses per document."""

    source: str
    target_share: float
    repeat_cap: int
    tokens: int
    reachable: bool
    clamped: bool
    planned_tokens: float
    epochs: float


PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target_share", T.DoubleType()),
        T.StructField("repeat_cap", T.IntegerType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("reachable", T.BooleanType()),
        T.StructField("clamped", T.BooleanType()),
        T.StructField("planned_tokens", T.DoubleType()),
        T.StructField("epochs", T.DoubleType()),
    ]
)


def water_fill(targets: list[tuple[str, float, int, int]], budget: int) -> list[Share]:
    """Plan for (source, target_share, repeat_cap, tokens) rows and a total of ``budget`` tokens.

    ``reachable`` is false for the sources that the first fill clamps below their share; later
    fills clamp sources that reach theirs, but not what others leave them.
    """
    planned = {s: 0.0 for s, *_ in targets}
    open_sources = {s: (share, cap * tokens) for s, share, cap, tokens in targets if share > 0}
    clamped: set[str] = set()
    short: set[str] = set()
    left, level = float(budget), None
    while open_sources and left > 0:
        # Tokens per unit of share: of the first fill the budget itself, as shares are of the whole.
        whole = math.fsum(share for share, _ in open_sources.values())
        level = left / (1.0 if level is None and math.isclose(whole, 1.0, rel_tol=1e-9) else whole)
        over = [s for s, (share, most) in open_sources.items() if share * level >= most]
        if not clamped:
            # Clamped below what the first fill gives: the source cannot reach its own share.
            short = {s for s in over if open_sources[s][0] * level > open_sources[s][1]}
        if not over:
            for s, (share, _) in open_sources.items():
                planned[s] = share * level
            break
        for s in over:
            planned[s] = float(open_sources.pop(s)[1])
            clamped.add(s)
        left = budget - sum(planned[s] for s in clamped)
    return [Share(s, share, cap, tokens, s not in short, s in clamped, planned[s], planned[s] / tokens if tokens else 0.0) for s, share, cap, tokens in targets]


def plan_mix(tokens: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens", budget: int | None = None) -> DataFrame:
    """The plan, one row per target source (columns of PLAN).

    ``tokens`` has one row per document with its source and size; ``targets`` has source,
    target_share and repeat_cap. ``budget`` is the size of the mix, by default that of all
    documents, with those of null and untargeted sources. Null sizes count 0. Repeated target
    rows of a source add their shares and keep the smallest cap; null shares are 0, null
    caps 1, null target sources are left out. A source without documents has 0 tokens. An
    empty ``targets`` gives no rows. Only target rows reach the driver.
    """
    spark = tokens.sparkSession
    sizes = tokens.groupBy(F.col(source).alias("_s")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("_n")).persist()
    want = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("repeat_cap", F.lit(1))).cast("int").alias("repeat_cap"))
    rows = want.join(sizes, F.col("source") == F.col("_s"), "left").orderBy("source").collect()
    whole = budget if budget is not None else sizes.agg(F.sum("_n")).first()[0] or 0
    sizes.unpersist()
    plan = water_fill([(r["source"], r["target_share"], r["repeat_cap"], r["_n"] or 0) for r in rows], whole)
    return spark.createDataFrame([tuple(vars(p).values()) for p in plan], PLAN)


def sample_mix(tokens: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 17) -> DataFrame:
    """(key, source, n_tokens, copies) of the documents used at least once.

    copies is the whole part of the source's epochs, plus one for the documents whose seeded
    hash falls below the fraction: the same seed gives the same mix. Documents of null or
    untargeted sources are not used. The plan has one row per target source.
    """
    rate = plan.select(F.col("source").alias("_s"), "epochs")
    lot = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    rows = tokens.join(rate, F.col(source) == F.col("_s"))
    copies = F.floor("epochs") + (lot < F.col("epochs") - F.floor("epochs")).cast("int")
    return rows.select(F.col(key), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).alias("n_tokens"), copies.cast("int").alias("copies")).filter("copies > 0")


def reached_shares(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the tokens of the mix and the share they make up, per source."""
    used = mix.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    whole = used.agg(F.sum("mix_tokens").alias("_all"))
    return plan.join(used, F.col("source") == F.col("_s"), "left").crossJoin(F.broadcast(whole)).select(
        *plan.columns, F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("mix_tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share")
    )
