"""Queries over tables and text: snapshots, audits, search, parsing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import keys as K
from spanloom.functions import otel as O
from spanloom.functions import symbols as S
from spanloom.functions import text as TX
from spanloom.operators import context as CX
from spanloom.operators import graph as G
from spanloom.operators import mutations as M
from spanloom.operators import search as SE
from spanloom.operators import summaries as SU
from spanloom.operators.ranged import range_totals, with_global
from spanloom.plans.engine import Engine
from spanloom.queries.common import EDGES_SQL, read
from spanloom.queries.graph import _hub
from spanloom.schema import ENUMS, TABLES
from spanloom.session import shared_dir
from spanloom.sources.text_inputs import hunks

TERMS, PREFIX, TOP_K = ["service", "request"], ["conn"], 8
PHRASES = ["send voucher", "get carts", "retry", "POST orders", "réturns"]


def symbol_parse(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("key")
    return read(spark, d, "nodes").filter("kind = 'symbol'").select("node_id", S.display_name(key).alias("display"), S.container_of(key).alias("container"), S.package_of(key).alias("package"), S.symbol_kind(key).alias("symbol_kind"), S.is_callable_target(key).alias("callable"))


def key_builders(spark, d):
    """Keys built again from routes, files and packages: those that differ from the stored ones."""
    nodes = read(spark, d, "nodes")
    routes = read(spark, d, "routes").select("node_id", K.route_key(F.col("service_name"), F.col("method"), F.col("url")).alias("built"))
    parsed = nodes.filter("kind = 'route'").withColumn("p", K.parse_route_key(F.col("key"))).select("node_id", "key", F.col("p.service").alias("service"), F.col("p.method").alias("method"), F.col("p.url").alias("url"))
    return parsed.join(routes, "node_id", "left").select("node_id", "service", "method", "url", (F.col("built") == F.col("key")).alias("same"))


def package_identity(spark, d):
    p = F.regexp_extract_all("key", F.lit(r"^([a-z]+):(@?[^@]+)@?(.*)$"), F.lit(0))
    part = lambda i: F.regexp_extract("key", r"^([a-z]+):(@?[^@]+)@?(.*)$", i)
    external = read(spark, d, "nodes").filter("kind = 'external'").filter(F.size(p) > 0)
    return external.select("node_id", part(2).alias("name"), K.package_key(part(1), part(2), part(3)).alias("identity"))


def node_upsert_first_wins(spark, d):
    """Nodes of the later half of runs' repos inserted after the others: the first repo stays."""
    nodes = read(spark, d, "nodes")
    again = nodes.select((F.col("node_id") + 10_000_000).alias("node_id"), "kind", "key", F.lit(-1).cast("long").alias("repo_id"))
    fresh = nodes.filter("kind = 'file'").select((F.col("node_id") + 20_000_000).alias("node_id"), "kind", F.concat("key", F.lit(".new")).alias("key"), "repo_id")
    return M.first_wins(nodes, again.unionByName(fresh), ["kind", "key"])


def file_upsert_latest_wins(spark, d):
    files = read(spark, d, "files")
    newer = files.filter("lang = 'python'").withColumn("content_sha256", F.sha2("path", 256))
    return M.latest_wins(files, newer, ["repo_id", "path"])


def incremental_diff(spark, d):
    """Files that were last indexed, against the same without scripts and with Python rewritten."""
    before = read(spark, d, "files")
    after = before.filter("lang is null or lang <> 'javascript'").withColumn("content_sha256", F.when(F.col("lang") == "python", F.sha2("path", 256)).otherwise(F.col("content_sha256")))
    return M.diff_files(before, after, ["repo_id", "path"], "content_sha256")


def provenance_delete(spark, d):
    """Edges left after the static facts of all Python files are purged."""
    files = read(spark, d, "files").filter("lang = 'python'")
    kept = M.purge({"edges": read(spark, d, "edges")}, files)["edges"]
    return kept.groupBy("evidence_kind").agg(F.count("*").alias("n"), F.sum("edge_id").alias("id_sum"))


def forget_deleted(spark, d):
    files = read(spark, d, "files").filter("lang = 'python'")
    tables = M.forget_files({"edges": read(spark, d, "edges"), "route_chain": read(spark, d, "route_chain")}, files)
    return tables["edges"].groupBy("evidence_kind").agg(F.count("*").alias("n")).unionByName(tables["route_chain"].groupBy(F.concat(F.lit("chain:"), "evidence_kind").alias("evidence_kind")).agg(F.count("*").alias("n")))


def replace_cfg(spark, d):
    cfg = read(spark, d, "function_cfg").select("symbol_node_id", "block_index", "kind")
    new = cfg.filter("kind = 'root'").withColumn("kind", F.lit("exit"))
    return M.replace_group(cfg, new, ["symbol_node_id"])


def fk_audit(spark, d):
    return M.audit({t: read(spark, d, t) for t in ("runs", "files", "nodes", "edges", "routes", "route_chain", "function_cfg")})


def table_counts(spark, d):
    out = None
    for t in ("runs", "files", "nodes", "edges", "routes", "route_chain", "function_cfg", "spans"):
        one = read(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def language_histogram(spark, d):
    return read(spark, d, "files").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("repo_id").alias("repos"))


def status_classes(spark, d):
    return read(spark, d, "spans").filter("http_status is not null").groupBy(F.concat(F.floor(F.col("http_status") / 100).cast("string"), F.lit("xx")).alias("class")).agg(F.count("*").alias("n"))


SPELT = ["http_method", "http_status", "url_path", "code_function", "code_filepath", "db_system", "db_name", "db_operation", "server_address", "server_port"]


def semconv_coalesce(spark, d):
    """Attributes written under one of their spellings, by turns, and under two at once, read back by name."""
    spans = read(spark, d, "spans")
    turn = lambda c, i: F.element_at(F.array(*(F.lit(k) for k in O.ALIASES[c])), (F.pmod(F.col("start_unix_us") + i, F.lit(len(O.ALIASES[c]))) + 1).cast("int"))
    pairs = [F.struct(turn(c, i).alias("k"), F.col(c).cast("string").alias("v")) for i, c in enumerate(SPELT)]
    # The oldest spelling is there as well, with another value: the newer one must win.
    stale = [F.struct(F.lit(O.ALIASES[c][-1]).alias("k"), F.concat(F.lit("stale "), F.col(c).cast("string")).alias("v")) for c in SPELT]
    written = F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())
    older = F.filter(F.array(*stale), lambda p: p["v"].isNotNull() & ~F.exists(written, lambda w: w["k"] == p["k"]))
    attributes = F.map_from_entries(F.concat(written, older))
    back = spans.select("semconv", *SPELT, attributes.alias("a")).select("semconv", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), O.attribute(F.col("a"), c).alias("got"), F.col(c).cast("string").alias("want")) for c in SPELT))).alias("x"))
    return back.groupBy("semconv", "x.name").agg(F.count("x.got").alias("found"), F.count_if(F.col("x.got") == F.col("x.want")).alias("same"))


def sql_literal_read(spark, d):
    """Tables that SQL lines of the documents read or write."""
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\r\n|\r|\n")).alias("line"))
    read_ = lines.withColumn("sql", TX.read_sql(F.col("line"))).filter("sql is not null")
    return read_.groupBy("sql.verb", "sql.table", "sql.operation").agg(F.count("*").alias("n"))


def token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", TX.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def clip_and_digest(spark, d):
    text = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", F.length(TX.clip(text)).alias("clipped"), TX.sha256(text).alias("sha256"))


def phrase_tokens(spark, d):
    """Tokens and squashed names of route urls."""
    return read(spark, d, "routes").select("node_id", F.array_join(TX.tokens(F.col("url")), " ").alias("tokens"), TX.squash(F.col("url")).alias("squashed"))


def _bm25(spark, d, terms, prefix=False):
    docs = read(spark, d, "documents")
    return SE.bm25(SE.postings(docs, "doc_id", "text"), SE.corpus_size(docs, "text"), "doc_id", terms, prefix).select("doc_id", F.round("score", 6).alias("score"))


def bm25_and(spark, d):
    return _bm25(spark, d, TERMS)


def bm25_prefix(spark, d):
    return _bm25(spark, d, PREFIX, True)


def postings(spark, d):
    """The inverted index as statistics per term."""
    return SE.postings(read(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def search_phrases(spark, d):
    """Hits of every phrase over a stored index of all symbols, routes and files, fused."""
    index = SE.SearchIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    nodes = read(spark, d, "nodes")
    index.build(SE.search_docs(nodes, read(spark, d, "routes")))
    engine = Engine({"nodes": nodes})
    out = None
    for phrase in PHRASES:
        hits = engine.search(phrase, index)["hits"].select(F.lit(phrase).alias("phrase"), "node_key", F.round("score", 9).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return out


def vector_topk(spark, d):
    vectors = read(spark, d, "embeddings")
    query = vectors.orderBy("vec_id").select("embedding").first()[0]
    return SE.vector_top_k(vectors, "vec_id", "embedding", query, TOP_K).select("vec_id", F.round("score", 5).alias("score"))


def vector_topk_batch(spark, d):
    """The nearest vectors of every hundredth vector, among all."""
    vectors = read(spark, d, "embeddings")
    found = SE.vector_top_k_batch(vectors, vectors.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding", TOP_K)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"))


def rrf_fuse(spark, d):
    """Hits of every query fused over its builds by reciprocal rank."""
    builds = read(spark, d, "search_builds").select("build_id", "score_order")
    hits = read(spark, d, "search_hits").filter("score is not null and not isnan(score)").join(builds, "build_id")
    key = F.when(F.col("score_order") == "asc", F.col("score")).otherwise(-F.col("score"))
    best = hits.groupBy("query_id", "build_id", "node_key").agg(F.min(key).alias("v")).withColumn("one", F.lit(1).cast("long"))
    ranked = with_global(range_totals(best, ["query_id", "build_id"], ["v", "node_key"], "one", "rrf-ranks"), "rank")
    return SE.reciprocal_rank_fusion(ranked, ["query_id"], "node_key", "rank").select("query_id", "node_key", F.round("score", 9).alias("score"), "n_sources")


def search_docs_union(spark, d):
    return SE.search_docs(read(spark, d, "nodes"), read(spark, d, "routes")).select("node_key", "kind", "name", "qualified", "path")


def context_tiers(spark, d):
    """Sizes of the tiers of every symbol."""
    nodes = read(spark, d, "nodes")
    seeds = nodes.filter("kind = 'symbol'").select(F.col("node_id").alias("seed"))
    return CX.tiers(nodes, read(spark, d, "edges"), read(spark, d, "function_cfg"), seeds).groupBy("seed", "tier").agg(F.count("*").alias("n_items"))


def _seed(spark, d):
    """The hub if it is a symbol with most callers."""
    return _hub(spark, d)


def tier_budget_pack(spark, d):
    seeds = _seed(spark, d)
    rows = CX.tiers(read(spark, d, "nodes"), read(spark, d, "edges"), read(spark, d, "function_cfg"), seeds)
    return CX.pack(rows, seeds).select("tier", "n_items", "cost", "included")


def cache_misses(spark, d):
    """Summaries to make when those of all services and of functions without callees are cached."""
    wanted = SU.inputs(read(spark, d, "nodes"), read(spark, d, "edges"))
    cached = wanted.filter("kind = 'service' or (kind = 'function' and not contains(input, '\n'))")
    return SU.cache_misses(wanted, cached).groupBy("kind").agg(F.count("*").alias("n"), F.max("input_sha256").alias("last_sha256"))


def diff_carry_forward(spark, d):
    """Hunks of a unified diff in which every line with an edge grew, shrank or went, file by file."""
    named = read(spark, d, "files").select("file_id", "path")
    at = read(spark, d, "edges").filter("file_id is not null and line is not null").select("file_id", "line").distinct().join(named, "file_id")
    headers = at.select("file_id", "path").distinct().select(F.lit(1).alias("diff_id"), (F.col("file_id") * 1_000_000).alias("line_no"), F.concat(F.lit("+++ b/"), "path").alias("text"))
    kept = F.col("line") % 4
    size = F.when(kept == 1, "").otherwise(F.concat(F.lit(","), kept.cast("string")))
    bodies = at.select(F.lit(1).alias("diff_id"), (F.col("file_id") * 1_000_000 + F.col("line") + 1).alias("line_no"), F.concat(F.lit("@@ -"), "line", F.lit(",2 +"), "line", size, F.lit(" @@ around")).alias("text"))
    return hunks(headers.unionByName(bodies)).select("file", "first", "last")


def route_edges_graph(spark, d):
    """Nodes and edges of the picture of all routes: each distinct link once, with its weakest sign."""
    edges = G.edges_once(read(spark, d, "edges"), "confidence").filter("type in ('HANDLES', 'REQUESTS')")
    kinds = read(spark, d, "nodes").select("node_id", "kind")
    named = edges.join(kinds.toDF("src_node_id", "src_kind"), "src_node_id", "left").join(kinds.toDF("dst_node_id", "dst_kind"), "dst_node_id", "left")
    return named.groupBy("type", "src_kind", "dst_kind").agg(F.countDistinct("src_node_id", "dst_node_id").alias("links"), F.count_if(F.col("confidence") == "unresolved").alias("unresolved"))


def runs_per_channel(spark, d):
    runs = read(spark, d, "runs")
    last = Window.partitionBy("repo_id", "channel").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("at", F.row_number().over(last)).filter("at = 1").select("repo_id", "channel", "run_id", "commit_sha", F.col("finished_at").isNotNull().alias("finished"))


QUERIES = {
    f.__name__: f
    for f in (
        symbol_parse, key_builders, package_identity, node_upsert_first_wins, file_upsert_latest_wins, incremental_diff, provenance_delete, forget_deleted, replace_cfg, fk_audit, table_counts, language_histogram, status_classes, semconv_coalesce, sql_literal_read, token_estimate, clip_and_digest, phrase_tokens,
        bm25_and, bm25_prefix, postings, search_phrases, vector_topk, vector_topk_batch, rrf_fuse, search_docs_union, context_tiers, tier_budget_pack, cache_misses, diff_carry_forward, route_edges_graph, runs_per_channel,
    )
}

_UTF16 = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
_PY = "(select file_id from files where lang = 'python')"
#: Marks leave letters of the Latin, Greek and Cyrillic blocks only.
_FOLD = "array_to_string(list_transform(string_split(regexp_replace(lower(text), '\\p{Mn}+', '', 'g'), ''), lambda c: case when ord(c) between 192 and 591 or ord(c) between 880 and 1327 or ord(c) between 7680 and 8191 then strip_accents(c) else c end), '')"
_WORDS = "w as (select doc_id, coalesce(regexp_extract_all(" + _FOLD + ", '[\\p{L}\\p{N}]+'), []) as ws from documents), c as (select doc_id, len(ws) as length, ws from w)"


def _bm25_sql(terms: list[str], prefix: bool) -> str:
    hit = "starts_with(x, '{0}')" if prefix else "x = '{0}'"
    tfs = ", ".join(f"len(list_filter(ws, lambda x: {hit.format(t)})) as t{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) filter (where t{i} > 0) as d{i}" for i in range(len(terms)))
    idf = "greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), " + f"{SE.LEAST_IDF})"
    score = " + ".join(f"{idf.format(i=i)} * t{i} * {SE.K1 + 1} / (t{i} + {SE.K1} * (1 - {SE.B} + {SE.B} * length / avgl))" for i in range(len(terms)))
    return f"with {_WORDS}, t as (select doc_id, length, {tfs} from c), s as (select count(*) as n, sum(length) / count(*)::double as avgl, {dfs} from t) select doc_id, round({score}, 6) as score from t, s where " + " and ".join(f"t{i} > 0" for i in range(len(terms)))


def _audit_sql() -> str:
    names = ("runs", "files", "nodes", "edges", "routes", "route_chain", "function_cfg")
    parts = [f"select '{t}' as table_name, '{c}' as column_name, 'reference' as problem, count(*) as n_rows from {t} x where {c} is not null and not exists (select 1 from {p} y where y.{k} = x.{c})" for t in names for c, (p, k) in TABLES[t].references.items() if p in names]
    parts += [f"select '{t}', '{c}', 'enum', count(*) from {t} where {c} is not null and {c} not in ({', '.join(repr(v) for v in vs)})" for (t, c), vs in ENUMS.items() if t in names]
    return " union all ".join(parts)


_D = r"(?:`([^`]*)`|([^\s`/#.:!()\[\]]+))(\([^)]*\)\.|/|#|\.|:)"
_SQL_READ = " union all ".join(
    f"""select upper(verb) as verb, lower(regexp_replace(t, '^[`"''\\[]+|[`"''\\]]+$', '', 'g')) as "table", '{kind}' as operation from (select verb, regexp_extract(head, '(?i)\\b{word}\\s+([`"''\\[]?[\\w.]+[`"''\\]]?)', 1) as t from h where verb = '{verb}')"""
    for verb, (kind, word) in TX.SQL_VERBS.items()
)
_HUB_SQL = """hub as (select n.node_id as seed from (select dst_node_id as node_id, count(distinct src_node_id) as f from edges where type = 'CALLS' group by 1) c join nodes n using (node_id) where n.kind = 'symbol' order by f desc, n.node_id limit 1)"""
_EVERY_SQL = "hub as (select node_id as seed from nodes where kind = 'symbol')"
_LAST = r"regexp_extract({0}, '(?:`([^`]*)`|([^\s`/#.:!()\[\]]+))(?:\([^)]*\)\.|/|#|\.|:)$', {1})"
_NAME = "(case when {0} like 'scip %' then coalesce(nullif(" + _LAST.format("{0}", 2) + ", ''), " + _LAST.format("{0}", 1) + ") else {0} end)"
_NAME = _NAME.replace("{0}", "§")
_TIERS = f"""{_HUB_SQL}, e as (select distinct src_node_id as a, dst_node_id as b, type from edges),
  x as (select seed, 'seed' as tier, key as item from hub join nodes on node_id = seed
    union all select seed, case when e.type in ('CALLS', 'CALLS_EXTERNAL') then 'callees' when e.type = 'READS_CONFIG' then 'config' when e.type in ('READS', 'WRITES') then 'datastores' when e.type = 'THROWS' then 'errors' when e.type = 'REQUESTS' then 'routes' end,
      case when n.kind = 'symbol' then {_NAME.replace('§', 'n.key')} else n.key end from hub join e on a = seed join nodes n on n.node_id = b
    union all select seed, case when e.type = 'CALLS' then 'callers' when e.type = 'HANDLES' then 'routes' when e.type = 'CONTAINS' then 'siblings' end, case when n.kind = 'symbol' then {_NAME.replace('§', 'n.key')} else n.key end from hub join e on b = seed join nodes n on n.node_id = a
    union all select seed, 'control_flow', concat_ws(' ', block_index, kind, coalesce(condition_text, error_name, outcome)) from hub join function_cfg on symbol_node_id = seed),
  y as (select distinct seed, tier, item from x where tier is not null and item is not null)"""

ORACLE = {
    "symbol_parse": r"""with s as (select node_id, key, regexp_extract(key, '^\S+ \S+ (\S+) \S+ (.*)$', 1) as package, regexp_extract(key, '^\S+ \S+ \S+ \S+ (.*)$', 1) as body from nodes where kind = 'symbol'),
      d as (select *, regexp_extract_all(body, '(?:`[^`]*`|[^\s`/#.:!()\[\]]+)(?:\([^)]*\)\.|/|#|\.|:)') as ds from s),
      n as (select *, list_transform(ds, lambda x: regexp_replace(regexp_replace(x, '(\([^)]*\)\.|/|#|\.|:)$', ''), '`', '', 'g')) as ns from d),
      k as (select *, case when ds[-1] like '%).' then 'method' when ds[-1] like '%/' then 'namespace' when ds[-1] like '%#' then 'type' when ds[-1] like '%.' then 'term' when ds[-1] like '%:' then 'meta' else 'unknown' end as symbol_kind from n)
      select node_id, ns[-1] as display, array_to_string(ns[:-2], '/') as container, package, symbol_kind, symbol_kind in ('method', 'term') as callable from k""",
    "key_builders": r"""select n.node_id, regexp_extract(key, '^(\S+) ([A-Z]+) (.+)$', 1) as service, regexp_extract(key, '^(\S+) ([A-Z]+) (.+)$', 2) as method, regexp_extract(key, '^(\S+) ([A-Z]+) (.+)$', 3) as url,
      r.service_name || ' ' || upper(r.method) || ' ' || r.url = key as same from nodes n left join routes r on r.node_id = n.node_id where n.kind = 'route'""",
    "package_identity": r"""with p as (select node_id, regexp_extract(key, '^([a-z]+):(@?[^@]+)@?(.*)$', 1) as m, regexp_extract(key, '^([a-z]+):(@?[^@]+)@?(.*)$', 2) as name, regexp_extract(key, '^([a-z]+):(@?[^@]+)@?(.*)$', 3) as v from nodes where kind = 'external' and regexp_matches(key, '^([a-z]+):(@?[^@]+)@?(.*)$'))
      select node_id, name, case when name = 'typescript' then 'builtin:ecmascript' when name = '@types/node' then 'builtin:node' when name like '@types/%' then 'npm:' || case when contains(name[8:], '__') then '@' || replace(name[8:], '__', '/') else name[8:] end
        else m || ':' || name || case when v <> '' then '@' || v else '' end end as identity from p""",
    "node_upsert_first_wins": "select * from nodes union all select node_id + 20000000, kind, key || '.new', repo_id from nodes where kind = 'file'",
    "file_upsert_latest_wins": "select file_id, repo_id, path, lang, case when lang = 'python' then sha256(path) else content_sha256 end as content_sha256, last_run_id from files",
    "incremental_diff": "select repo_id, path, case when lang = 'javascript' then 'deleted' when lang = 'python' and sha256(path) <> content_sha256 then 'changed' else 'unchanged' end as change from files",
    "provenance_delete": f"select evidence_kind, count(*) as n, cast(sum(edge_id) as bigint) as id_sum from edges where not (evidence_kind in ('scip', 'treesitter', 'semgrep') and coalesce(file_id in {_PY}, false)) group by 1",
    "forget_deleted": f"""select evidence_kind, count(*) as n from edges where not coalesce(file_id in {_PY}, false) group by 1
      union all select 'chain:' || evidence_kind, count(*) from route_chain where not coalesce(file_id in {_PY}, false) group by 1""",
    "replace_cfg": """select symbol_node_id, block_index, kind from function_cfg where symbol_node_id not in (select symbol_node_id from function_cfg where kind = 'root')
      union all select symbol_node_id, block_index, 'exit' from function_cfg where kind = 'root'""",
    "fk_audit": _audit_sql(),
    "table_counts": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in ("runs", "files", "nodes", "edges", "routes", "route_chain", "function_cfg", "spans")),
    "language_histogram": "select lang, count(*) as n, count(distinct repo_id) as repos from files group by 1",
    "status_classes": "select cast(http_status // 100 as varchar) || 'xx' as class, count(*) as n from spans where http_status is not null group by 1",
    "semconv_coalesce": " union all ".join(f"select semconv, '{c}' as name, count({c}) as found, count({c}) as same from spans group by 1" for c in SPELT),
    "sql_literal_read": f"""with l as (select unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) as line from documents), h as (select substr(ltrim(line, ' '), 1, {TX.SQL_HEAD}) as head, lower(regexp_extract(ltrim(line, ' '), '^([a-zA-Z]+)\\b', 1)) as verb from l), r as ({_SQL_READ})
      select verb, "table", operation, count(*) as n from r where "table" <> '' and not regexp_matches("table", '^\\d') group by 1, 2, 3""",
    "token_estimate": f"with d as (select doc_id, coalesce(text, '') as t from documents) select doc_id, cast(ceil({_UTF16.format('t')} / 4.0) as bigint) as tokens from d",
    "clip_and_digest": "select doc_id, cast(least(length(coalesce(text, '')), 4000) as int) as clipped, sha256(coalesce(text, '')) as sha256 from documents",
    "phrase_tokens": "select node_id, array_to_string(regexp_extract_all(url, '[\\p{L}\\p{N}]+'), ' ') as tokens, lower(array_to_string(regexp_extract_all(url, '[\\p{L}\\p{N}]+'), '')) as squashed from routes",
    "bm25_and": _bm25_sql(sorted(TERMS), False),
    "bm25_prefix": _bm25_sql(sorted(PREFIX), True),
    "postings": f"with {_WORDS}, t as (select doc_id, unnest(ws) as term from c), p as (select doc_id, term, count(*) as tf from t group by 1, 2) select term, count(*) as df, cast(sum(tf) as bigint) as cf from p group by 1",
    "vector_topk": f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), q as (select e as q from v order by vec_id limit 1),
      s as (select vec_id, case when sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) = 0 then 0 else list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) end as score from v, q)
      select vec_id, round(score, 5) as score from s where score > 0 order by s.score desc, vec_id limit {TOP_K}""",
    "vector_topk_batch": f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), q as (select vec_id as query_id, e as q from v where vec_id % 100 = 0),
      s as (select query_id, vec_id, case when sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) = 0 then 0 else list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) end as score from v, q)
      select query_id, vec_id, round(score, 5) as score from s where score > 0 qualify row_number() over (partition by query_id order by s.score desc, vec_id) <= {TOP_K}""",
    "rrf_fuse": f"""with b as (select query_id, build_id, node_key, min(case when score_order = 'asc' then score else -score end) as v from search_hits join search_builds using (build_id) where score is not null and not isnan(score) group by 1, 2, 3),
      r as (select *, row_number() over (partition by query_id, build_id order by v, node_key) as k from b)
      select query_id, node_key, round(sum(1.0::double / ({SE.RRF_K} + k)), 9) as score, count(*) as n_sources from r group by 1, 2""",
    "search_docs_union": r"""with s as (select key, regexp_extract_all(regexp_extract(key, '^\S+ \S+ \S+ \S+ (.*)$', 1), '(?:`[^`]*`|[^\s`/#.:!()\[\]]+)(?:\([^)]*\)\.|/|#|\.|:)') as ds from nodes where kind = 'symbol'),
      n as (select key, list_transform(ds, lambda x: regexp_replace(regexp_replace(x, '(\([^)]*\)\.|/|#|\.|:)$', ''), '`', '', 'g')) as ns from s)
      select key as node_key, 'symbol' as kind, ns[-1] as name, coalesce(nullif(array_to_string(ns[:-2], '/'), ''), string_split(key, ' ')[3]) as qualified, '' as path from n
      union all select n.key, 'route', upper(method) || ' ' || url, service_name, '' from routes join nodes n using (node_id) where n.kind = 'route'
      union all select key, kind, string_split(key, '/')[-1], coalesce(regexp_extract(key, '^(.*)/[^/]*$', 1), ''), key from nodes where kind = 'file'""",
    "context_tiers": f"with {_TIERS.replace(_HUB_SQL, _EVERY_SQL)} select seed, tier, count(*) as n_items from y group by 1, 2",
    "tier_budget_pack": f"""with recursive {_TIERS}, sz as (select tier, count(*) as n_items, cast(ceil(sum({_UTF16.format('item')} + 3) / 4.0) as bigint) as cost from y group by 1),
      tn as (select unnest(range({len(CX.TIERS)})) as i, unnest([{', '.join(repr(t) for t in CX.TIERS)}]) as tier),
      ft as (select i, tier, coalesce(n_items, 0) as n_items, coalesce(cost, 0) as cost from tn left join sz using (tier)),
      fold as (select i, tier, n_items, cost, cost <= {CX.BUDGET} as included, case when cost <= {CX.BUDGET} then cost else 0 end as spent from ft where i = 0
        union all select f.i, f.tier, f.n_items, f.cost, p.spent + f.cost <= {CX.BUDGET}, p.spent + case when p.spent + f.cost <= {CX.BUDGET} then f.cost else 0 end from fold p join ft f on f.i = p.i + 1)
      select tier, n_items, cost, included from fold""",
    "cache_misses": f"""with s as (select node_id, key, {_NAME.replace('§', 'key')} as name, string_split(key, ' ')[3] as service, regexp_extract(key, '`([^`]*)`', 1) as module from nodes where kind = 'symbol'),
      c as (select e.a as node_id, string_agg(distinct n.key, chr(10) order by n.key) as callees from (select distinct src_node_id as a, dst_node_id as b from edges where type in ('CALLS', 'CALLS_EXTERNAL')) e join nodes n on n.node_id = e.b group by 1),
      w as (select 'function' as kind, concat_ws(chr(10), name, callees) as input from s left join c using (node_id)
        union all select 'module', string_agg(distinct name, chr(10) order by name) from s group by service, module),
      m as (select kind, sha256(input) as digest, input from w where not (kind = 'function' and not contains(input, chr(10))))
      select kind, count(*) as n, max(digest) as last_sha256 from m group by 1""",
    "diff_carry_forward": "select path as file, line as first, line + line % 4 - 1 as last from (select distinct file_id, line from edges where file_id is not null and line is not null) join files using (file_id) where line % 4 > 0",
    "route_edges_graph": f"""select e.type, a.kind as src_kind, b.kind as dst_kind, count(distinct (src_node_id, dst_node_id)) as links, count(*) filter (where confidence = 'unresolved') as unresolved
      from {EDGES_SQL} e left join nodes a on a.node_id = src_node_id left join nodes b on b.node_id = dst_node_id where e.type in ('HANDLES', 'REQUESTS') group by 1, 2, 3""",
    "runs_per_channel": "select repo_id, channel, run_id, commit_sha, finished_at is not null as finished from runs qualify row_number() over (partition by repo_id, channel order by started_at desc, run_id desc) = 1",
}
