"""The stored index against the ranking function written out over plain lists."""

import math
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions.stemming import fold, fold_text, porter
from spanloom.operators.search import B, K1, LEAST_IDF, SearchIndex, embeddings, search_docs
from spanloom.plans.engine import Engine
from spanloom.schema import TABLES

DOCS = [
    ("k1", "checks user auths", "auth.ts", "checkUserAuth(user)", "Checks whether a user may enter.", "auth.ts"),
    ("k2", "userService", "services", "", "", "services/user.ts"),
    ("k3", "nothing", "here", "", "", ""),
    ("k4", "checkUserAuth", "", "", "", ""),
    ("k5", "Überprüfung", "café", "", "checking checked", ""),
    ("k6", "checkUserAuthorised", "", "", "", ""),
    ("k7", "", "", "", "", ""),
] + [(f"n{i}", f"filler{i}", "x", "", "", "") for i in range(8)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([(k, "symbol", *rest) for k, *rest in DOCS], TABLES["search_docs"].schema)
    made = SearchIndex(spark, str(tmp_path_factory.mktemp("index")))
    assert made.meta() is None
    report = made.build(docs)
    assert report["row_count"] == len(DOCS) and report["vector_count"] == 0
    return made


@pytest.mark.parametrize(
    "word,stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("replacement", "replac"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("grün", "grün"), ("v2", "v2"),
    ],
)
def test_published_stems(word, stem):
    assert porter(word) == stem


def test_folding_agrees_in_both_places(spark):
    texts = ["Café ÀÉÎÕÜ ñ Ż ő", "Ελληνικά Й", "cafe\u0301", "キューが", "straße", ""]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fold(F.col("t")).alias("f")).collect()]
    assert got == [fold_text(t) for t in texts] and got[0].startswith("cafe aeiou n z o") and got[2] == "cafe" and got[3] == "キューが"


def brute(phrase, limit):
    words = lambda t: [porter(w) for w in re.findall(r"[^\W_]+", fold_text(t))]
    docs = {k: words(" ".join(rest)) for k, *rest in DOCS}
    mean = sum(map(len, docs.values())) / len(docs)
    asked = re.findall(r"[^\W_]+", phrase)
    whole = porter(fold_text("".join(asked)))
    best = {}
    for terms, prefix in (([porter(fold_text(w)) for w in asked], False), ([whole], False), ([whole], True)):
        n_hits = lambda ws, t: sum(w.startswith(t) if prefix else w == t for w in ws)
        df = {t: sum(n_hits(ws, t) > 0 for ws in docs.values()) for t in terms}
        scored = {}
        for k, ws in docs.items():
            if all(n_hits(ws, t) for t in terms):
                scored[k] = sum(max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), LEAST_IDF) * n_hits(ws, t) * (K1 + 1) / (n_hits(ws, t) + K1 * (1 - B + B * len(ws) / mean)) for t in terms)
        for k, v in sorted(scored.items(), key=lambda kv: (-kv[1], kv[0]))[:limit]:
            best[k] = max(best.get(k, -1), v)
    return [(k, round(v, 9)) for k, v in sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:limit]]


@pytest.mark.parametrize("phrase,limit", [("check user auth", 20), ("check user auth", 2), ("CHECKING", 20), ("user user", 20), ("filler", 3), ("no such words", 20), ("überprüfung", 20)])
def test_lexical_ranking(index, phrase, limit):
    assert [(r.node_key, round(r.score, 9)) for r in index.lexical(phrase, limit).collect()] == brute(phrase, limit)


def test_readings_are_told(index):
    assert {r.node_key: r.aspects for r in index.lexical("check user auth", 9).collect()} == {"k1": "and+phrase+prefix", "k4": "phrase+prefix", "k6": "prefix"}


def test_engine_search(spark, index, tmp_path):
    e = Engine({"nodes": spark.createDataFrame([(1, "symbol", "k3", 1)], TABLES["nodes"].schema)})
    assert [r.node_key for r in e.search("check user auth", index)["hits"].collect()][0] in ("k1", "k4")
    assert e.search(",,,", index).facts["reason"] == "the phrase has no words"
    assert "not built" in e.search("x", SearchIndex(spark, str(tmp_path / "none"))).facts["reason"]
    assert [r.node_key for r in e.search("check", index, corrected="k3")["hits"].collect()] == ["k3"]


def test_vectors_are_built_and_checked(spark, tmp_path):
    docs = spark.createDataFrame([("a", "symbol", "one", "q", "", "d", ""), ("b", "symbol", "two", "", "", "d", "")], TABLES["search_docs"].schema)
    made = SearchIndex(spark, str(tmp_path / "i"))
    report = made.build(docs, lambda texts: [[float(len(t)), 1.0] for t in texts], 2, "lengths")
    assert report["vector_count"] == 2 and report["provider"] == "lengths"
    assert {r.node_key: list(r.vector) for r in made.vectors().collect()} == {"a": [5.0, 1.0], "b": [3.0, 1.0]}
    e = Engine({"nodes": spark.createDataFrame([], TABLES["nodes"].schema)})
    assert {r.node_key for r in e.search("two", made, [5.0, 1.0])["hits"].collect()} == {"a", "b"}
    with pytest.raises(Exception, match="numbers for 3"):
        made.build(docs, lambda texts: [[0.0, 1.0] for _ in texts], 3)
    assert SearchIndex(spark, str(tmp_path / "i")).meta()["vector_count"] == 2  # the failed build changed nothing
    assert embeddings(docs.select("node_key", "kind", F.lit("t").alias("text")).limit(0), lambda t: [], 2).count() == 0


def test_documents_of_the_index(spark, rows):
    nodes = spark.createDataFrame([(1, "symbol", "scip npm svc 1 `a.ts`/Cart#add().", 1), (2, "symbol", "scip npm svc 1 run().", 1), (3, "route", "svc GET /x", 1), (4, "file", "repo/src/a.ts", 1), (5, "symbol", "scip npm svc 1 `b.ts`/f().", 1)], TABLES["nodes"].schema)
    routes = spark.createDataFrame([(3, 1, "svc", "get", "/x", None, None, None, None, False, "boot", 1)], TABLES["routes"].schema)
    assert rows(search_docs(nodes, routes), "name", "qualified", "path") == [("GET /x", "svc", ""), ("a.ts", "repo/src", "repo/src/a.ts"), ("add", "a.ts/Cart", ""), ("f", "b.ts", ""), ("run", "svc", "")]
    symbols = spark.createDataFrame([(5, 9, "shown", "method", "f(): void", "Long. " * 2000, 1, 2, None, True, False)], TABLES["symbols"].schema)
    files = spark.createDataFrame([(9, 1, "b.ts", "ts", "x", 1)], TABLES["files"].schema)
    full = search_docs(nodes, routes, symbols, files).filter("name = 'shown'").first()
    assert (full.qualified, full.signature, full.path, len(full.doc)) == ("b.ts", "f(): void", "b.ts", 4000)
