import os
import random

import pytest

from spanloom.llm.tokenization import BYTE_BPE, TOKENIZER_DIR, count_tokens, decode_corpus, encode_corpus, encoder

PATH = os.path.join(TOKENIZER_DIR, BYTE_BPE)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
SCHEMA = "doc_id long, text string, _id int, ids int"


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = [
    "", " ", "\n\n\t ", "Hello world, it's we'll THEY'RE done", "<|endoftext|> and <|im_start|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 300, " " * 257 + "x", "naïve café Ünïcödé ∂ 漢字かな 한국어 🙂👩‍👩‍👧", "​ ﻿\x00\x07",
    "def f(x):\r\n    return x_1 + 0x1F  # 12345678901234567890", "Привет, мир! Ошибка была вчера.", "éé ́", "'s't'd 've're", "1,234.56€ — “quotes”…",
]


def test_same_ids_as_the_public_library(public):
    tool = encoder(PATH)
    assert tool.encode(TEXTS) == [public(t) for t in TEXTS]


def test_random_texts(public):
    rng = random.Random(7)
    alphabet = "abcdefghijABC  \n\t.,;:_-'\"0123456789éüß漢🙂́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(300)]
    assert encoder(PATH).encode(texts) == [public(t) for t in texts]


def test_random_ascii_texts(public):
    rng = random.Random(9)
    texts = ["".join(rng.choice([" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x00", "\x7f", "'s", "'ll", "'", "aB", "9", "007", "_", "=>", "don't"]) for _ in range(60)) for _ in range(400)]
    assert encoder(PATH).encode(texts) == [public(t) for t in texts]


def test_very_long_piece_and_text(public):
    rng = random.Random(3)
    long_piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    mixed = "".join(rng.choice(["the", "ing", "x", "qz", "ation", "éü", "aaaa"]) for _ in range(30_000))
    texts = [long_piece, mixed, "=" * 100_001, "-=" * 3001, " " * 70_000, "ha" * 777 + "h" * 5000, "word and number 42. " * 5000]
    assert encoder(PATH).encode(texts) == [public(t) for t in texts]


def test_dataframe_null_empty_repeats_and_clashing_columns(spark, public):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(99, None, 1, 2), (3, TEXTS[3], 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect())
    assert got == sorted((i, public(t) if t else []) for i, t, *_ in rows)
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {i: len(ids) for i, ids in got}
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}
    assert encode_corpus(spark.createDataFrame([], SCHEMA)).count() == 0
