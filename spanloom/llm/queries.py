"""Queries of the training-data problems 1, 2, 4, 7, 8 and 9, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.cooccurrence import cooccurring_pairs
from spanloom.llm.mixing import plan_mix, reached_shares, sample_mix
from spanloom.llm.percentiles import merge_counts, percentiles, value_counts
from spanloom.llm.rank_fusion import best_items, median_ranks, positions
from spanloom.llm.reading_level import assign_levels, formula_labels, train
from spanloom.llm.tokenization import count_tokens, decode_corpus, encode_corpus
from spanloom.session import stage

PAIR_SUPPORT, PAIR_LIFT = 5, 6
MIN_SPANS, SPREAD = 20, 8
HARD_LEVEL = 4
DAYS_ERROR = 0.01
LEXICAL_WEIGHT = 2.5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Problem 1


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return median_ranks(read(spark, d, "search_hits"), read(spark, d, "search_builds"), "query_id", "node_key", "build_id", "score", "score_order")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return best_items(_ranks(spark, d), "query_id", "node_key")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return positions(_ranks(spark, d), "query_id", "node_key")


def p1_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The ranking with every lexical build counted LEXICAL_WEIGHT times."""
    builds = read(spark, d, "search_builds").withColumn("weight", F.when(F.col("provider").isNull(), LEXICAL_WEIGHT).otherwise(1.0))
    return median_ranks(read(spark, d, "search_hits"), builds, "query_id", "node_key", "build_id", "score", "score_order", "weight")


# Problem 2


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurring_pairs(read(spark, d, "spans"), "trace_id", "code_function", "service_name", PAIR_SUPPORT)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p2_pairs(spark, d).filter(F.col("n_ab") * F.col("n_records") >= PAIR_LIFT * F.col("n_a") * F.col("n_b"))
    return pairs.select("service_name", F.col("item_a").alias("function_a"), F.col("item_b").alias("function_b"))


# Problem 4

_GROUP = ["service_name", "http_route"]


def _spans_once(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "spans")
    return spans.groupBy("trace_id", "span_id").agg(*(F.min(c).alias(c) for c in (*_GROUP, "duration_us", "start_unix_us")))


def _wide(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    return rows.groupBy(*_GROUP).agg(F.max("n").alias("n_spans"), *(F.max(F.when(F.col("share") == p, F.col("value"))).alias(c) for c, p in shares.items()))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    state = value_counts(_spans_once(spark, d).filter(F.col("http_route").isNotNull()), _GROUP, "duration_us")
    wide = _wide(percentiles(state, _GROUP, [0.5, 0.95]), {"p50": 0.5, "p95": 0.95})
    return wide.filter((F.col("n_spans") >= MIN_SPANS) & (F.col("p95") >= SPREAD * F.col("p50"))).select(*_GROUP)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    state = value_counts(_spans_once(spark, d), _GROUP, "duration_us")
    return _wide(percentiles(state, _GROUP, [0.5, 0.9, 0.95, 0.99]), {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p4_days_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles within 1 %, from a state of the even days and one of the odd days, and their true error."""
    spans = stage(_spans_once(spark, d), "spans-once")
    even = F.to_date(F.timestamp_micros("start_unix_us")).cast("timestamp").cast("long") / 86400 % 2 == 0
    states = [stage(value_counts(spans.filter(days), _GROUP, "duration_us", DAYS_ERROR), "day-states") for days in (even, ~even | even.isNull())]
    shares = {"p50": 0.5, "p95": 0.95}
    near = _wide(percentiles(merge_counts(states, _GROUP), _GROUP, list(shares.values())), shares)
    true = _wide(percentiles(value_counts(spans, _GROUP, "duration_us"), _GROUP, list(shares.values())), {f"_{c}": p for c, p in shares.items()}).drop("n_spans")
    off = lambda c: F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(F.abs(F.col(c) - F.col(f"_{c}")) / F.col(f"_{c}"))
    both = near.join(true.toDF(*(f"_{c}" for c in _GROUP), *true.columns[2:]), F.col("service_name").eqNullSafe(F.col("_service_name")) & F.col("http_route").eqNullSafe(F.col("_http_route")))
    return both.select(*_GROUP, "n_spans", *(F.round(c, 4).alias(c) for c in shares), *((off(c) <= DAYS_ERROR).alias(f"{c}_within") for c in shares))


# Problem 7


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids do not decode to their text: none, as the encoding is lossless."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode_corpus(encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").groupBy((F.col("text") == F.col("decoded")).alias("lossless")).agg(F.count("*").alias("n_documents"))


# Problem 8


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    packed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    return stage(count_tokens(packed, "key").select("key.doc_id", "key.source", "n_tokens"), "document-tokens")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return plan_mix(_sizes(spark, d), read(spark, d, "mix_targets")).filter("not reachable").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    return sample_mix(sizes, plan_mix(sizes, read(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    plan = plan_mix(sizes, read(spark, d, "mix_targets"))
    return reached_shares(sample_mix(sizes, plan), plan)


# Problem 9


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return assign_levels(docs, train(docs, read(spark, d, "reading_labels"), seed=True))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).filter(F.col("reading_level") >= HARD_LEVEL).select("doc_id")


def p9_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Levels by models whose seeds are the readability formula alone, as where nothing is labelled."""
    docs = read(spark, d, "documents")
    return assign_levels(docs, train(docs, formula_labels(docs)))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p1_weighted, p2_found, p2_pairs, p4_found, p4_percentiles, p4_days_combined, p7_ids, p7_roundtrip, p8_found, p8_mix, p8_shares, p9_found, p9_levels, p9_seeded)}

_RANKS = """
  s as (select h.query_id, h.build_id, h.node_key, min(case when b.score_order = 'asc' then score else -score end) as v
        from search_hits h left join search_builds b using (build_id)
        where score is not null and not isnan(score) and h.query_id is not null and h.node_key is not null and h.build_id is not null group by 1, 2, 3),
  r as (select query_id, build_id, node_key, rank() over (partition by query_id, build_id order by v) as k from s),
  z as (select query_id, build_id, count(*) as n from s group by 1, 2),
  i as (select distinct query_id, node_key from s),
  f as (select i.query_id, i.node_key, coalesce(r.k, z.n + 1) as k, r.k as own from i join z using (query_id) left join r using (query_id, build_id, node_key)),
  m as (select query_id, node_key, median(k) as median_rank, avg(k) as mean_rank, cast(count(own) as int) as n_scores from f group by 1, 2),
  p as (select *, row_number() over (partition by query_id order by median_rank, mean_rank, node_key) as position from m)"""
_PAIRS = f"""
  s as (select distinct service_name as g, trace_id as t, code_function as c from spans where service_name is not null and trace_id is not null and code_function is not null),
  n as (select g, c, count(*) as n from s group by 1, 2),
  z as (select g, count(distinct t) as n from s group by 1),
  ab as (select a.g, a.c as a, b.c as b, count(*) as n from s a join s b on a.g = b.g and a.t = b.t and a.c < b.c group by 1, 2, 3 having count(*) >= {PAIR_SUPPORT}),
  q as (select ab.g as service_name, ab.a as item_a, ab.b as item_b, ab.n as n_ab, na.n as n_a, nb.n as n_b, z.n as n_records, ab.n * z.n / cast(na.n * nb.n as double) as lift
        from ab join n na on na.g = ab.g and na.c = ab.a join n nb on nb.g = ab.g and nb.c = ab.b join z on z.g = ab.g)"""
_SHARES = """
  o as (select min(service_name) as service_name, min(http_route) as http_route, min(duration_us) as v from spans group by trace_id, span_id),
  k as (select service_name, http_route, v, row_number() over (partition by service_name, http_route order by v) as k, count(*) over (partition by service_name, http_route) as n from o where v is not null),
  w as (select service_name, http_route, max(n) as n_spans, """ + ", ".join(f"cast(min(v) filter (where k >= ceil({p}::double * n)) as double) as p{p[2:].ljust(2, '0')}" for p in ("0.5", "0.9", "0.95", "0.99")) + """ from k group by 1, 2)"""

_RATIO = f"({1 + DAYS_ERROR}::double / {1 - DAYS_ERROR}::double)"
_CELL = "round(case when {0} = 0 then 0 else pow(" + _RATIO + ", ceil(ln({0}) / ln(" + _RATIO + "))) * 2 / (" + _RATIO + " + 1) end, 4)"

ORACLE = {
    "p4_days_combined": f"with {_SHARES} select service_name, http_route, n_spans, {_CELL.format('p50')} as p50, {_CELL.format('p95')} as p95, true as p50_within, true as p95_within from w",
    "p1_found": f"with {_RANKS} select query_id, node_key from p where position = 1",
    "p1_ranking": f"with {_RANKS} select * from p",
    "p1_weighted": f"""with {_RANKS}, fw as (select i.query_id, i.node_key, coalesce(r.k, z.n + 1) as k, r.k as own, case when b.build_id is not null and b.provider is null then {LEXICAL_WEIGHT} else 1.0 end::double as w from i join z using (query_id) left join r using (query_id, build_id, node_key) left join search_builds b using (build_id)),
      c as (select *, sum(w) over (partition by query_id, node_key order by k, w rows unbounded preceding) as cum, sum(w) over (partition by query_id, node_key) as whole from fw)
      select query_id, node_key, (min(k) filter (where cum * 2 >= whole) + coalesce(min(k) filter (where cum * 2 > whole), min(k) filter (where cum * 2 >= whole))) / 2.0::double as median_rank, sum(k * w) / sum(w) as mean_rank, cast(count(own) as int) as n_scores from c group by 1, 2""",
    "p2_found": f"with {_PAIRS} select service_name, item_a as function_a, item_b as function_b from q where n_ab * n_records >= {PAIR_LIFT} * n_a * n_b",
    "p2_pairs": f"with {_PAIRS} select * from q",
    "p4_found": f"with {_SHARES} select service_name, http_route from w where http_route is not null and n_spans >= {MIN_SPANS} and p95 >= {SPREAD} * p50",
    "p4_percentiles": f"with {_SHARES} select * from w",
}
