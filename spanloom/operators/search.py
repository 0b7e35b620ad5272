"""Lexical and vector search: postings, BM25, cosine top-k and reciprocal rank fusion."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import symbols as S
from spanloom.functions.stemming import fold, fold_text, porter, stems
from spanloom.functions.text import clip, tokens
from spanloom.functions.vectors import cosine
from spanloom.session import partitions_for

# The parameters of the ranking function, and the weight of terms that are everywhere.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_WORD = re.compile(r"[^\W_]+")
RRF_K = 60
#: Rows of a block of vectors or queries: a block of scores has its square.
BLOCK = 2048


def postings(docs: DataFrame, key: str, text: str, stem: bool = False) -> DataFrame:
    """(key, term, tf, length): folded terms of each document with their counts.

    length is the document's number of words. With ``stem`` terms are stems.
    """
    words = docs.select(key, tokens(fold(F.col(text))).alias("_w")).filter(F.size("_w") > 0)
    counted = words.select(key, F.size("_w").alias("length"), F.explode("_w").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    if not stem:
        return counted
    # Counted first, so that the stemmer sees a term once per document.
    return counted.withColumn("term", stems(F.col("term"))).groupBy(key, "length", "term").agg(F.sum("tf").alias("tf"))


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    """One row: n documents, those without words included, and their mean number of words."""
    n_words = F.greatest(F.lit(0), F.size(tokens(fold(F.col(text)))))
    return docs.agg(F.count("*").alias("_n"), (F.sum(n_words) / F.count("*")).alias("_avg"))


def bm25(found: DataFrame, size: DataFrame, key: str, terms: list[str], prefix: bool = False) -> DataFrame:
    """(key, score) of documents with all ``terms``, best highest.

    ``found`` has postings, ``size`` the one row of ``corpus_size``. Only postings of the terms
    are read on. With ``prefix`` a term stands for every term it begins, counted together. A
    term that is asked for twice counts twice; one in more than half of all documents counts
    next to nothing.
    """
    wanted = sorted(set(terms))
    hits = [F.col("term").startswith(t) if prefix else F.col("term") == t for t in wanted]
    some = reduce(Column.__or__, hits)
    # One row per document with any of the terms, read once for their frequencies and for the scores.
    rows = found.filter(some).groupBy(key, "length").agg(*(F.sum(F.when(hit, F.col("tf"))).alias(f"_t{i}") for i, hit in enumerate(hits)))
    stats = rows.agg(*(F.count(f"_t{i}").alias(f"_df{i}") for i in range(len(wanted)))).crossJoin(size)
    score, every = F.lit(0.0), F.lit(True)
    for i, term in enumerate(wanted):
        tf, df = F.col(f"_t{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + terms.count(term) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("_avg")))
        every = every & tf.isNotNull()
    # One row of statistics.
    return rows.filter(every).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))


def search_docs(nodes: DataFrame, routes: DataFrame, symbols: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(node_key, kind, name, qualified, signature, doc, path) of all symbols, routes and files.

    A symbol is qualified by its file, without one by its container, else its package; a route
    is named by method and url and qualified by its service; a file is qualified by its folder.
    """
    key, none = F.col("key"), F.lit("")
    own = nodes.filter("kind = 'symbol'").select("node_id", "key")
    if symbols is not None:
        own = own.join(symbols.select("node_id", "file_id", "display_name", "signature", "doc"), "node_id", "left")
        own = own.join(files.select("file_id", F.col("path").alias("_path")), "file_id", "left")
    else:
        own = own.select("*", *(F.lit(None).cast("string").alias(c) for c in ("display_name", "signature", "doc", "_path")))
    qualified = F.coalesce("_path", F.nullif(S.container_of(key), F.lit("")), S.package_of(key))
    by_symbol = own.select(key.alias("node_key"), F.lit("symbol").alias("kind"), F.coalesce("display_name", S.display_name(key)).alias("name"), qualified.alias("qualified"), F.coalesce("signature", none).alias("signature"), clip(F.coalesce("doc", none)).alias("doc"), F.coalesce("_path", none).alias("path"))
    method = F.upper("method")
    by_route = routes.join(nodes.filter("kind = 'route'").select("node_id", "key"), "node_id").select(key.alias("node_key"), F.lit("route").alias("kind"), F.concat_ws(" ", method, "url").alias("name"), F.col("service_name").alias("qualified"), none.alias("signature"), none.alias("doc"), none.alias("path"))
    folder = F.regexp_extract(key, r"^(?s)(.*)/[^/]*$", 1)
    by_file = nodes.filter("kind = 'file'").select(key.alias("node_key"), "kind", F.element_at(F.split(key, "/"), -1).alias("name"), folder.alias("qualified"), none.alias("signature"), none.alias("doc"), key.alias("path"))
    return by_symbol.unionByName(by_route).unionByName(by_file)


def words_of(phrase: str) -> list[str]:
    return _WORD.findall(phrase)


class SearchIndex:
    """An inverted index in a folder: postings in term order, so that a search reads its terms only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._meta: dict | None = None

    def build(self, docs: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, dimension: int = 0, provider: str | None = None) -> dict:
        """Index ``docs`` (columns of ``search_docs``) from scratch; the report of the build.

        ``embed`` turns a batch of texts into vectors of ``dimension`` numbers, on executors;
        another dimension fails the build, and the index before it stays as it was.
        """
        version = uuid.uuid4().hex
        at = f"{self.path}/{version}"
        whole = docs.select("node_key", "kind", search_text(*(F.col(c) for c in ("name", "qualified", "signature", "doc", "path"))).alias("text"))
        postings(whole, "node_key", "text", stem=True).repartitionByRange(partitions_for(whole), "term").sortWithinPartitions("term").write.parquet(f"{at}/postings")
        n_vectors = 0
        if embed is not None:
            told = docs.select("node_key", "kind", F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("name", "qualified", "signature", "path"))).alias("text"))
            embeddings(told, embed, dimension).write.parquet(f"{at}/vectors")
            n_vectors = self.spark.read.parquet(f"{at}/vectors").count()
        meta = corpus_size(whole, "text").select(F.lit(version).alias("version"), F.localtimestamp().alias("built_at"), F.col("_n").alias("row_count"), "_avg", F.lit(n_vectors).cast("long").alias("vector_count"), F.lit(provider).cast("string").alias("provider"))
        meta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        self._meta = None
        return self.meta() or {"row_count": 0, "vector_count": 0, "provider": provider}

    def meta(self) -> dict | None:
        """What the last build reported; None if there was none, or no document. Read once."""
        if self._meta is None:
            try:
                row = self.spark.read.parquet(f"{self.path}/meta").first()
            except AnalysisException:
                return None
            self._meta = row.asDict() if row and row["row_count"] else None
        return self._meta

    def lexical(self, phrase: str, limit: int) -> DataFrame:
        """(node_key, score, aspects): the best of three readings of the phrase per document.

        ``and``: all its words; ``phrase``: its words written as one; ``prefix``: what begins so.
        """
        meta, words = self.meta(), [porter(fold_text(w)) for w in words_of(phrase)]
        squashed = porter(fold_text("".join(words_of(phrase))))
        found = self.spark.read.parquet(f"{self.path}/{meta['version']}/postings")
        size = self.spark.range(1).select(F.lit(meta["row_count"]).alias("_n"), F.lit(meta["_avg"]).alias("_avg"))
        best = lambda terms, prefix, name: bm25(found, size, "node_key", terms, prefix).orderBy(F.desc("score"), "node_key").limit(limit).withColumn("aspect", F.lit(name))
        aspects = best(words, False, "and").unionByName(best([squashed], False, "phrase")).unionByName(best([squashed], True, "prefix"))
        # At most three times ``limit`` rows.
        merged = aspects.groupBy("node_key").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("aspect")), "+").alias("aspects"))
        return merged.orderBy(F.desc("score"), "node_key").limit(limit)

    def vectors(self) -> DataFrame | None:
        meta = self.meta()
        return self.spark.read.parquet(f"{self.path}/{meta['version']}/vectors") if meta and meta["vector_count"] else None


def embeddings(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """(node_key, kind, vector) of (node_key, kind, text), a batch at a time."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = embed(part["text"].tolist())
            wrong = next((v for v in vectors if len(v) != dimension), None)
            if wrong is not None or len(vectors) != len(part):
                raise ValueError(f"the provider gave {len(vectors)} vectors for {len(part)} texts, or {len(wrong or [])} numbers for {dimension}")
            yield pd.DataFrame({"node_key": part["node_key"], "kind": part["kind"], "vector": [list(map(float, v)) for v in vectors]})

    return texts.mapInPandas(work, "node_key string, kind string, vector array<float>")


def vector_top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows of highest positive cosine with ``query``: exact, one scan, no full sort."""
    probe = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(key, cosine(F.col(vector), probe).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def vector_top_k_batch(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score): for each row of ``queries`` the ``k`` rows of ``vectors`` nearest to it.

    As ``vector_top_k``, for any number of queries: blocks of vectors meet blocks of queries
    in one matrix product each, which keeps k rows a query; the best of these stay.
    """
    n_vectors, n_queries = (max(1, -(-df.count() // block)) for df in (vectors, queries))
    place = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    left = vectors.filter(whole).select(key, vector, place(n_vectors).alias("_v"), each(n_queries).alias("_q"))
    right = queries.filter(whole).select(key, vector, place(n_queries).alias("_q"), each(n_vectors).alias("_v"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array(table.column(vector).to_pylist(), dtype=np.float64)  # vectors of unlike dimension raise
        return rows, np.sqrt((rows * rows).sum(axis=1))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by(key)  # a stable sort by score then breaks ties by key
        at = owner = np.zeros(0, dtype=np.int64)
        top = np.zeros(0)
        if a.num_rows and b.num_rows:
            (x, x_norm), (y, y_norm) = matrix(a), matrix(b)
            scale = np.outer(y_norm, x_norm)
            score = np.divide(y @ x.T, scale, out=np.zeros_like(scale), where=scale != 0)
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            owner, at = np.repeat(np.arange(len(y)), order.shape[1]), order.ravel()
            top = score[owner, at]
            owner, at, top = owner[top > 0], at[top > 0], top[top > 0]
        return pa.table({"query_id": b.column(key).take(pa.array(owner)), key: a.column(key).take(pa.array(at)), "score": pa.array(top)})

    kind = vectors.schema[key].dataType.simpleString()
    found = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInArrow(best, f"query_id {kind}, {key} {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k).drop("_at")


def reciprocal_rank_fusion(ranks: DataFrame, group: list[str], item: str, rank: str, k: int = RRF_K) -> DataFrame:
    """(group, item, score, n_sources) from 1-based ranks, one row per (group, source, item)."""
    return ranks.groupBy(*group, item).agg(F.sum(1.0 / (k + F.col(rank))).alias("score"), F.count("*").alias("n_sources"))


def search_text(name: Column, qualified: Column, signature: Column, doc: Column, path: Column) -> Column:
    return F.concat_ws(" ", name, qualified, signature, doc, path)
