"""Reading level of each document: smoothed unigram language models, one per level.

Words of the prose (code, tables, data and logs set aside) are hashed to a fixed number of
buckets. Counts per (bucket, level) over all labelled documents, smoothed, are the models;
a document gets the level of the highest posterior likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import spread

LEVELS = (1, 2, 3, 4, 5)
#: Hash buckets of the vocabulary: with the levels, they bound the model's size.
BUCKETS = 1 << 16
SMOOTHING = 0.1
MIN_WORDS = 3
#: Labelled rows the models are fitted on at most: the first by hash of key and level.
TRAIN_ROWS = 200_000

_FENCE = r"(?s)```.*?(```|\z)|~~~.*?(~~~|\z)"
#: Lines that are no prose: indented code, data, log lines, diffs, tables, rules, headings.
_NO_PROSE = r"(?m)^(?:\t| {4,}|[ \t]*[\{\[\}\]]|[ \t]*\d{4}-\d\d-\d\d[T ]\d\d:|@@|[-+][ \t]{2,}|diff |\+\+\+|---|[ \t]*\||#+ |[ \t]*[=\-_*#~]+[ \t]*$).*$"
#: Tokens that name code. Looked for at token starts only, so linear also in very long tokens.
_IDENTIFIER = r"(?<!\S)(?=\S*?(?:[_()]|\p{Ll}\p{Lu}|\p{L}\.\p{L}))\S+"
_WORD = r"\p{L}[\p{L}\p{M}'’-]*"


def prose(text: Column) -> Column:
    """The lines of ``text`` that are prose, in lower case, identifiers removed."""
    lines = F.regexp_replace(F.regexp_replace(text, _FENCE, "\n"), _NO_PROSE, "")
    return F.lower(F.regexp_replace(lines, _IDENTIFIER, ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(prose(text), F.lit(_WORD), F.lit(0))


def _bucketed(df: DataFrame, key: str, text: str) -> DataFrame:
    hashed = F.transform(words(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return df.select(F.col(key).alias("_id"), F.coalesce(hashed, F.array().cast("array<int>")).alias("_w"))


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per (level, bucket) of rows (level, buckets), and of rows per level as bucket -1."""
    counts = np.zeros((len(LEVELS), BUCKETS + 1), np.int64)
    for batch in batches:
        bags = batch.column(1)
        sizes = np.diff(bags.offsets.to_numpy())
        known = sizes >= MIN_WORDS
        level = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) - LEVELS[0]
        flat = bags.flatten().to_numpy(zero_copy_only=False)
        each = np.repeat(np.where(known, level, -1), sizes)
        for i in range(len(LEVELS)):
            counts[i, 1:] += np.bincount(flat[each == i], minlength=BUCKETS)
            counts[i, 0] += int((known & (level == i)).sum())
    at, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array((at + LEVELS[0]).astype(np.int32)), pa.array((bucket - 1).astype(np.int32)), pa.array(counts[at, bucket])], names=["level", "bucket", "n"])


@dataclass
class LevelModel:
    """Log probabilities (level, bucket) and log priors."""

    log_word: np.ndarray
    log_prior: np.ndarray

    def posterior(self, offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Log posteriors (document, level), each row normalised."""
        sums = np.concatenate((np.zeros((len(self.log_prior), 1)), np.cumsum(self.log_word[:, flat], axis=1, dtype=np.float64)), axis=1)
        score = (sums[:, offsets[1:]] - sums[:, offsets[:-1]]).T + self.log_prior
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", level: str = "reading_level", train_rows: int = TRAIN_ROWS, seed: bool = False) -> LevelModel:
    """Models from the labels, all of them up to ``train_rows``.

    Labels outside LEVELS, null ones and those of unknown documents are left out; several
    labels of a document all count. Without any usable label all levels are alike, or with
    ``seed`` the labels of ``formula_labels`` are taken. The bound on the
    labels makes them safe to broadcast, so that no text is shuffled to meet its label; at most
    BUCKETS * len(LEVELS) counts reach the driver, however large the corpus.
    """
    rated = labels.filter(F.col(level).isin(*LEVELS)).select(F.col(key).alias("_lid"), F.col(level).cast("int").alias("_level")).filter("_lid is not null")
    rated = F.broadcast(rated.orderBy(F.xxhash64("_lid", "_level"), "_lid", "_level").limit(train_rows))
    known = spread(documents.select(key, text)).join(rated, F.col(key) == F.col("_lid")).select(F.struct(F.col("_lid"), F.col("_level")).alias("_both"), F.col(text).alias("_t"))
    bags = _bucketed(known.select("_both", "_t"), "_both", "_t")
    # Counted past Catalyst's reach: a filter on the words would be pushed below the join, to all texts.
    counted = bags.select("_id._level", "_w").mapInArrow(_level_counts, "level int, bucket int, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n"))
    word, prior = np.zeros((len(LEVELS), BUCKETS)), np.zeros(len(LEVELS))
    for row in counted.toLocalIterator():
        if row["bucket"] < 0:
            prior[row["level"] - LEVELS[0]] = row["n"]
        else:
            word[row["level"] - LEVELS[0], row["bucket"]] = row["n"]
    if seed and not prior.any():
        return train(documents, formula_labels(documents, key, text).withColumnRenamed("reading_level", level), key, text, level, train_rows)
    word += SMOOTHING
    prior += 1
    return LevelModel(np.log(word / word.sum(axis=1, keepdims=True)).astype(np.float32), np.log(prior / prior.sum()))


def formula_labels(documents: DataFrame, key: str = "doc_id", text: str = "text", cuts: tuple[float, ...] = (3.0, 6.0, 10.0, 16.0)) -> DataFrame:
    """(key, reading_level) seeds by the automated readability index, for corpora without labels."""
    body = prose(F.col(text))
    n_words = F.size(F.regexp_extract_all(body, F.lit(_WORD), F.lit(0)))
    n_letters = F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]", ""))
    n_sentences = F.greatest(F.lit(1), F.size(F.regexp_extract_all(body, F.lit(r"[.!?;]+(\s|$)"), F.lit(0))))
    index = F.lit(4.71) * n_letters / n_words + F.lit(0.5) * n_words / n_sentences - F.lit(21.43)
    grade = F.lit(1)
    for cut in cuts:
        grade = grade + F.when(index > cut, 1).otherwise(0)
    return documents.filter(n_words >= MIN_WORDS).select(F.col(key), grade.cast("int").alias("reading_level"))


def assign_levels(documents: DataFrame, model: LevelModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, reading_level, confidence) of every row of ``documents``.

    reading_level is the level of the highest posterior, the lower one on a tie; confidence is
    its posterior probability. Both are null for texts without prose (null, blank, fewer than
    MIN_WORDS prose words: code or data only). Repeated rows keep their rows; other
    columns are ignored; whole texts are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x LEVELS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                bags = batch.column(1).slice(low, 2000)
                offsets = bags.offsets.to_numpy()
                flat = bags.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                offsets = (offsets - offsets[0]).astype(np.int64)
                log = m.posterior(offsets, flat)
                n = np.diff(offsets)
                none = n < MIN_WORDS
                best = log.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, 2000), pa.array(n.astype(np.int32)), pa.array((best + LEVELS[0]).astype(np.int32), mask=none), pa.array(np.exp(log[np.arange(len(n)), best]), mask=none)],
                    names=["_id", "n_words", "reading_level", "confidence"],
                )

    bags = _bucketed(spread(documents.select(key, text)), key, text)
    kind = bags.schema["_id"].dataType.simpleString()
    return bags.mapInArrow(work, f"_id {kind}, n_words int, reading_level int, confidence double").withColumnRenamed("_id", key)
