import pytest
from pyspark.sql import functions as F

from spanloom.functions import confidence, keys, otel, symbols, text, toon, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


SYM = "scip npm web 1.2.0 src/`a b.ts`/Cart#total().(rate)"


@pytest.mark.parametrize(
    "symbol,display,container,kind",
    [
        ("scip npm web 1.2.0 `server.js`/po().", "po", "server.js", "method"),
        ("scip npm web 1.2.0 `server.js`/", "server.js", "", "namespace"),
        ("scip npm web 1.2.0 src/`a b.ts`/Cart#total().", "total", "src/a b.ts/Cart", "method"),
        ("scip npm web 1.2.0 src/`a.ts`/Cart#", "Cart", "src/a.ts", "type"),
        ("scip npm web 1.2.0 src/`a.ts`/PORT.", "PORT", "src/a.ts", "term"),
        ("scip npm web 1.2.0 src/`a.ts`/f().(x)", "x", "src/a.ts/f", "parameter"),
        ("scip npm web 1.2.0 src/`a.ts`/List#[T]", "T", "src/a.ts/List", "typeParameter"),
        ("scip npm web 1.2.0 `we``ird.ts`/f(+1).", "f", "we`ird.ts", "method"),
        ("local 12", "local 12", "", "unknown"),
    ],
)
def test_symbols(spark, symbol, display, container, kind):
    df = spark.createDataFrame([(symbol,)], "s string")
    row = df.select(symbols.display_name(F.col("s")).alias("d"), symbols.container_of(F.col("s")).alias("c"), symbols.symbol_kind(F.col("s")).alias("k")).first()
    assert (row.d, row.c, row.k) == (display, container, kind)


def test_symbol_head_and_predicates(spark):
    df = spark.createDataFrame([(SYM,), ("local 3",)], "s string")
    a, b = df.select(symbols.parse_symbol(F.col("s")).alias("p"), symbols.is_parameter_like(F.col("s")).alias("q"), symbols.is_container(F.col("s")).alias("r")).collect()
    assert (a.p.scheme, a.p.manager, a.p.package, a.p.version, a.q, a.r) == ("scip", "npm", "web", "1.2.0", True, False)
    assert b.p.local_id == "3" and b.r


@pytest.mark.parametrize("path,want", [("/a/b/?x=1#y", "/a/b"), ("/", "/"), ("", "/"), ("/a//", "/a"), ("/a#f", "/a"), ("?q", "/")])
def test_normalise_path(spark, path, want):
    assert one(spark, text.normalise_path(F.lit(path))) == want


@pytest.mark.parametrize("path,template,fits", [("/po/1", "/po/:id", True), ("/po/1/x", "/po/:id", False), ("/po/1?z=2", "/po/{id}", True), ("/a/b", "/a/*", True), ("/a/b", "/a/c", False)])
def test_path_fits(spark, path, template, fits):
    assert one(spark, text.path_fits(F.lit(path), F.lit(template))) is fits


@pytest.mark.parametrize(
    "sql,want",
    [("UPDATE purchase_orders SET x=1", ("UPDATE", "purchase_orders", "write")), ("SELECT 1", None), ("SELECT 1 FROM 2x", None), ('INSERT INTO "MAIL_EVENTS" VALUES (1)', ("INSERT", "mail_events", "write")), ("  with t as (select 1 from b) select * from t", ("WITH", "b", "read")), ("merge into x", None), ("upsert into x values (1)", None), ("replace into x values (1)", ("REPLACE", "x", "write")), ("hello", None), ("delete from `a.b`", ("DELETE", "a.b", "write"))],
)
def test_read_sql(spark, sql, want):
    from spanloom.extract.model import read_sql

    row = one(spark, text.read_sql(F.lit(sql)))
    assert (tuple(row) if row else None) == want == read_sql(sql)


def test_tokens_and_estimates(spark):
    assert one(spark, text.tokens(F.lit("check  USER-auth!"))) == ["check", "USER", "auth"]
    assert one(spark, text.tokens(F.lit(",,,"))) == []
    assert one(spark, text.squash(F.lit("Check user_Auth"))) == "checkuserauth"
    assert one(spark, text.estimate_tokens(F.lit("abcde"))) == 2
    assert one(spark, text.one_line(F.lit("a \n b" + "c" * 300), 10)) == "a bcccccc…"


def test_hash_sampling_agrees_with_the_stream(spark):
    from spanloom.streaming.sampler import fnv1a, keeps

    ids = [f"trace{i}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "t string")
    got = df.select("t", text.fnv1a(F.col("t")).alias("h"), text.keep_by_hash(F.col("t"), 0.3).alias("k")).collect()
    assert all(r.h == fnv1a(r.t) and r.k == keeps(r.t, False, 0.3) for r in got)
    assert 30 < sum(r.k for r in got) < 90
    assert one(spark, text.keep_by_hash(F.lit("x"), 1)) and not one(spark, text.keep_by_hash(F.lit("x"), 0))


def test_globs(spark):
    allow = lambda p, i, e: one(spark, text.path_allowed(F.lit(p), i, e))
    assert allow("src/a/b.ts", ["src/**/*.ts"], []) and allow("src/b.ts", ["src/**/*.ts"], [])
    assert not allow("src/a/b.ts", ["src/*.ts"], []) and not allow("src/b.ts", [], ["**/b.*"])
    assert allow("x.py", [], [])


def test_keys(spark):
    k = lambda c: one(spark, c)
    assert k(keys.route_key(F.lit("svc"), F.lit("post"), F.lit("/p"))) == "svc POST /p"
    assert tuple(k(keys.parse_route_key(F.lit("svc POST /p q")))) == ("svc", "POST", "/p q")
    assert k(keys.parse_route_key(F.lit("svc post"))) is None
    assert k(keys.file_key(F.lit("r"), F.lit(".\\a\\b.js"))) == "r/a/b.js"
    package = lambda n, v="1": k(keys.package_key(F.lit("npm"), F.lit(n), F.lit(v)))
    assert [package("typescript"), package("@types/node"), package("@types/react"), package("@types/babel__core"), package("zod", "3.1")] == ["builtin:ecmascript", "builtin:node", "npm:react", "npm:@babel/core", "npm:zod@3.1"]
    assert k(keys.host_key(F.lit("https://a.example/"))) == "http:a.example"
    assert k(keys.datastore_key(F.lit("Postgres"), F.lit(None).cast("string"), F.lit("Orders"))) == "postgres://?/orders"
    assert k(keys.config_key(F.lit("PORT"))) == "env:PORT" and k(keys.error_key(F.lit(None).cast("string"))) == "error:(rethrow)"


def test_otel_values(spark):
    k = lambda c: one(spark, c)
    assert [k(otel.micros(F.lit(x))) for x in ("1700000000000000000", "1700000000000000999", "12.7", "x")] == [1700000000000000, 1700000000000000, 0, 0]
    assert [k(otel.span_kind(F.lit(x))) for x in ("2", "SPAN_KIND_CLIENT", "9", "server")] == ["server", "client", None, "server"]
    assert [k(otel.status(F.lit(x))) for x in ("2", "STATUS_CODE_OK", "0")] == ["error", "ok", "unset"]
    assert k(otel.iso_from_micros(F.lit(1700000000000000))) == "2023-11-14 22:13:20"


def test_confidence(spark):
    weakest = lambda a, b: one(spark, confidence.weakest(F.lit(a), F.lit(b)))
    assert weakest("certain", "inferred") == weakest("inferred", "certain") == "inferred"
    assert weakest("inferred", "unresolved") == "unresolved" and weakest("observed", "certain") == "observed"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    a, b = [r.x for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert abs(a - 0.5**0.5) < 1e-9 and b == 0
    with pytest.raises(Exception, match="unlike dimension"):
        spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert vectors.decode_vector(vectors.encode_vector([0.5, -2.0])) == [0.5, -2.0]
    with pytest.raises(ValueError):
        vectors.decode_vector(b"f32\x02\x00\x00\x00\x00")


def test_toon():
    assert toon.encode({"edges": [{"src": "a", "dst": "b", "type": "CALLS"}, {"src": "c", "dst": "d,e", "type": "x\ny"}]}) == 'edges[2]{src,dst,type}:\n  a,b,CALLS\n  c,"d,e","x\\ny"'
    assert toon.encode({"x": []}) == "x[0]:" and toon.encode({"x": [1, 2, 3]}) == "x[3]: 1,2,3"
    assert toon.encode({"a": True, "b": None, "c": float("nan"), "d": {"e": 1}}) == "a: true\nb: \nc: \nd:\n  e: 1"


@pytest.mark.parametrize("kind,want", [("0", "unspecified"), ("1", "internal"), ("5", "consumer"), ("6", None), ("-1", None), ("SPAN_KIND_SERVER", "server"), ("SPAN_KIND_", None), ("Odd", "odd"), (None, None)])
def test_span_kinds(spark, kind, want):
    assert one(spark, otel.span_kind(F.lit(kind).cast("string"))) == want


@pytest.mark.parametrize("name,key", [("server_address", "http.host"), ("url_path", "http.path"), ("url_path", "http.target"), ("db_name", "db.name")])
def test_old_spellings(spark, name, key):
    assert one(spark, otel.attribute(F.create_map(F.lit(key), F.lit("v")), name)) == "v"


def test_lengths_are_utf16_units(spark):
    assert one(spark, text.estimate_tokens(F.lit("😀😀a"))) == 2
    assert one(spark, text.utf16_length(F.lit("ä😀"))) == 3


def test_collated_order(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "B", "a", "Z", "ä", "_", "A", "az")], "t string")
    assert [r.t for r in df.orderBy(text.collated("t")).collect()] == ["_", "a", "A", "ä", "az", "b", "B", "Z"]
