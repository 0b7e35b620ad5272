import random

import pytest

from spanloom.llm.reading_level import assign_levels, formula_labels, prose, train, words

DOCS, LABELS = "doc_id long, text string, n_words int, _w string", "doc_id long, rater string, reading_level int"
WORDS = {1: "the cat sat on a red mat".split(), 2: "each worker copies one table before it waits".split(), 3: "the scheduler validates every nested transaction".split(), 4: "responsibility is therefore distributed across counterparts".split(), 5: "epistemology presupposes irreducible heterogeneous quiescence".split()}
CODE = "```python\ndef f(x):\n    return x\n```\n\n    SELECT a FROM b;\n\n| a | b |\n|---|---|\n\n{\"k\": 1}\n2026-03-07 09:07:11.628 WARN retry took=628ms\n"


def make(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        level = rng.randrange(1, 6)
        text = " ".join(rng.choice(WORDS[level] if rng.random() < 0.85 else WORDS[rng.randrange(1, 6)]) for _ in range(30))
        docs.append((i, (CODE + "\n" if i % 3 == 0 else "") + text + ".", 0, ""))
        labels.append((i, "r", level if rng.random() > 0.05 else rng.randrange(1, 6)))
        if i % 7 == 0:
            labels.append((i, "s", None if i % 14 else level))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = make()
    model = train(spark.createDataFrame(docs, DOCS), spark.createDataFrame([x for x in labels if x[0] % 4], LABELS))
    got = {r.doc_id: r.reading_level for r in assign_levels(spark.createDataFrame(docs, DOCS), model).collect()}
    held = [(i, level) for i, r, level in labels if i % 4 == 0 and r == "r"]
    assert sum(got[i] == level for i, level in held) / len(held) > 0.88


def test_texts_without_prose(spark):
    docs, labels = make(60)
    model = train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    bare = [(1, None, 0, ""), (2, "", 0, ""), (3, " \n\t ", 0, ""), (4, CODE, 0, ""), (5, "parse_row() fetchItem x.y", 0, ""), (6, "The cat sat on the mat.", 0, ""), (6, "The cat sat on the mat.", 0, "")]
    got = assign_levels(spark.createDataFrame(bare, DOCS), model).collect()
    assert len(got) == 7
    assert all(r.reading_level is None and r.confidence is None for r in got if r.doc_id < 6)
    assert all(r.reading_level == 1 for r in got if r.doc_id == 6)
    assert assign_levels(spark.createDataFrame([], DOCS), model).count() == 0


def test_prose_and_words(spark):
    row = spark.createDataFrame([(CODE + "Now the Door fetchItem is_open. It's naïve.\r\n- a list item\r\n# Heading", )], "t string").select(words("t").alias("w"), prose("t").alias("p")).first()
    assert row.w == ["now", "the", "door", "is", "it's", "naïve", "a", "list", "item"] or row.w == ["now", "the", "door", "it's", "naïve", "a", "list", "item"]
    assert "select" not in row.p and "heading" not in row.p


def test_very_long_token_and_text(spark):
    docs, labels = make(60)
    model = train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    long = spark.createDataFrame([(1, "x" * 300_000, 0, ""), (2, "the cat sat on a mat. " * 20_000, 0, "")], DOCS)
    got = {r.doc_id: (r.n_words, r.reading_level) for r in assign_levels(long, model).collect()}
    assert got[1][1] is None and got[2] == (120_000, 1)


def test_no_labels_and_formula_seeds(spark):
    docs, _ = make(80)
    df = spark.createDataFrame(docs, DOCS)
    flat = train(df, spark.createDataFrame([], LABELS))
    assert {r.reading_level for r in assign_levels(df, flat).collect()} == {1}
    seeds = formula_labels(df)
    assert {1 <= r.reading_level <= 5 for r in seeds.collect()} == {True}
    easy = {r.doc_id: r.reading_level for r in formula_labels(spark.createDataFrame([(1, "The cat sat. The dog ran. It is red.", 0, ""), (2, "Epistemological considerations necessitate heterogeneous commensurability, notwithstanding interdependencies presupposed throughout.", 0, "")], DOCS)).collect()}
    assert easy[1] == 1 and easy[2] == 5
