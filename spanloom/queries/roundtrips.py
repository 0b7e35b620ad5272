"""Queries that write the given tables in the formats of the sources, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import keys as K
from spanloom.functions import otel as O
from spanloom.functions import text as TX
from spanloom.operators import mutations as M
from spanloom.queries.common import read
from spanloom.queries.graph import _commits
from spanloom.queries.runtime import _span_stream
from spanloom.queries.tables import SPELT
from spanloom.session import shared_dir
from spanloom.sources import boot, otlp
from spanloom.sources.text_inputs import history
from spanloom.store import Store
from spanloom.streaming.sampler import deliver_once

INCLUDE, EXCLUDE = ["src/**", "lib/*.ts"], ["**/*.js", "src/jobs/**"]
_SEPARATOR = "\u001f"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def otlp_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Spans as OTLP/JSON payloads, one each, under changing spellings, and normalised again."""
    spans = read(spark, d, "spans")
    turn = lambda c, i: F.element_at(F.array(*(F.lit(k) for k in O.ALIASES[c])), (F.pmod(F.col("start_unix_us") + i, F.lit(len(O.ALIASES[c]))) + 1).cast("int"))

    def pair(key, value, whole=False):
        text = value.cast("string")
        typed = F.struct(*(F.when(F.lit(whole == (field == "intValue")), text).alias(field) for field in ("stringValue", "intValue")))
        return F.when(value.isNotNull(), F.struct(key.alias("key"), typed.alias("value")))

    known = [pair(turn(c, i), F.col(c), c in ("http_status", "server_port")) for i, c in enumerate(SPELT)] + [pair(F.lit("http.route"), F.col("http_route"))]
    given = lambda pairs: F.filter(F.array(*pairs), lambda p: p.isNotNull())
    kinds = F.array(*(F.lit(k) for k in O.SPAN_KINDS))
    number = (F.array_position(kinds, F.col("kind")) - 1).cast("string")
    kind = F.when(F.col("start_unix_us") % 2 == 0, number).otherwise(F.concat(F.lit("SPAN_KIND_"), F.upper("kind")))
    nanos = lambda c: F.concat((F.col(c) * 1000 + 7).cast("string"))
    thrown = F.when(F.col("exception_type").isNotNull(), F.array(F.struct(F.lit("exception").alias("name"), given([pair(F.lit("exception.type"), F.col("exception_type")), pair(F.lit("exception.message"), F.col("exception_message"))]).alias("attributes"))))
    code = F.when(F.col("status") == "error", "2").when(F.col("status") == "ok", "STATUS_CODE_OK").otherwise("0")
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", kind.alias("kind"), nanos("start_unix_us").alias("startTimeUnixNano"), nanos("end_unix_us").alias("endTimeUnixNano"), F.struct(code.alias("code"), F.col("status_message").alias("message")).alias("status"), given(known).alias("attributes"), thrown.alias("events")
    )
    resource = F.struct(F.array(pair(F.lit("service.name"), F.col("service_name"))).alias("attributes"))
    body = F.struct(F.array(F.struct(resource.alias("resource"), F.concat(F.lit("https://opentelemetry.io/schemas/"), "semconv").alias("schemaUrl"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    folder = _folder(spark, "payloads")
    spans.select(F.to_json(body)).write.text(folder)
    payloads = otlp.read_payloads(spark, folder)
    return otlp.normalise(otlp.accepted(payloads)).select("trace_id", "span_id", "parent_span_id", "name", "kind", "service_name", "start_unix_us", "end_unix_us", "duration_us", "status", "status_message", "http_route", *SPELT, "exception_type", "exception_message", "semconv").distinct()


def boot_roundtrip(spark, d):
    """Boot chains of every service as dumps, one document each, read and expanded again."""
    chain = read(spark, d, "route_chain").filter("evidence_kind = 'boot'").dropDuplicates(["route_node_id", "phase", "position"])
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    entry = F.struct("position", "phase", "name", "key", F.col("file_id").cast("string").alias("file"), "line", none("int", "col"), F.col("end_line").alias("endLine"), F.col("name").isNull().alias("anonymous"), "origin", none("string", "declaredIn"), F.col("inherited_from").alias("inheritedFrom"))
    # As long as a route's chain, then as a service's list of routes: a dump is one document.
    chains = chain.groupBy(F.col("route_node_id").alias("node_id")).agg(F.array_sort(F.collect_list(entry)).alias("chain"))
    routes = read(spark, d, "routes").join(chains, "node_id").select("service_name", F.struct(F.lower("method").alias("method"), "url", "prefix", F.col("has_schema").alias("hasSchema"), "chain").alias("r"))
    dumps = routes.groupBy("service_name").agg(F.collect_list("r").alias("routes"))
    folder = _folder(spark, "boot")
    dumps.select(F.to_json(F.struct(F.lit("boot/1").alias("schema"), F.col("service_name").alias("service"), "routes")).alias("value"), F.col("service_name").alias("of")).write.partitionBy("of").text(folder)
    return boot.expand_chain(boot.read_boot(spark, folder)).select("service", "route_key", "position", "phase", "name", "key", "origin", "inherited_from", "file", "line", "end_line", "detail")


def history_roundtrip(spark, d):
    """Commits as a log with their files below them, read again."""
    runs = read(spark, d, "runs").groupBy(F.col("commit_sha").alias("sha")).agg(F.date_format(F.min("started_at"), "yyyy-MM-dd").alias("date"), F.min("tool").alias("author"))
    # As long as a commit's list of files.
    blocks = _commits(spark, d).distinct().groupBy("sha").agg(F.array_sort(F.collect_list("file")).alias("files")).join(runs, "sha")
    folder = _folder(spark, "log")
    blocks.select(F.concat_ws("\n", F.concat_ws(_SEPARATOR, "sha", "date", "author"), F.lit(""), F.array_join("files", "\n"))).write.text(folder)
    return history(spark, folder).select("sha", "date", "author", "file")


def store_upserts(spark, d):
    """A store filled, then given the same nodes, new files, newer routes and chains: rows per table."""
    store = Store(spark, _folder(spark, "store"))
    nodes, files, routes, chain = (read(spark, d, t) for t in ("nodes", "files", "routes", "route_chain"))
    store.commit({"nodes": nodes, "files": files, "routes": routes})
    store.insert("nodes", nodes.withColumn("repo_id", F.lit(-1).cast("long")).unionByName(nodes.filter("kind = 'file'").withColumn("key", F.concat("key", F.lit(".new")))))
    store.upsert("files", files.filter("lang = 'python'").withColumn("content_sha256", F.lit("again")))
    store.upsert("routes", routes.withColumn("method", F.lower("method")).withColumn("source", F.lit("again")))
    store.insert("route_chain", chain)
    counted = lambda t, sign: store.read(t).agg(F.count("*").alias("n_rows"), F.count_if(sign).alias("n_signed")).select(F.lit(t).alias("table_name"), "n_rows", "n_signed")
    out = counted("nodes", F.col("repo_id") == -1).unionByName(counted("files", F.col("content_sha256") == "again"))
    return out.unionByName(counted("routes", (F.col("source") == "again") & (F.col("method") == F.upper("method")))).unionByName(counted("route_chain", F.col("check_kind").isNotNull()))


def stream_delivered(spark, d):
    """Spans appended by a stream, each once, by day."""
    out = _folder(spark, "delivered")
    deliver_once(_span_stream(spark, d), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("trace_id", "span_id").alias("n_distinct"))


def glob_filter(spark, d):
    """Files that lists of globs let in."""
    return read(spark, d, "files").filter(TX.path_allowed(F.col("path"), INCLUDE, EXCLUDE)).select("file_id", "path")


def text_shapes(spark, d):
    """Words that look like URLs or error codes, per document, and its text on one line."""
    text = F.coalesce("text", F.lit(""))
    words = F.split(text, " ")
    return read(spark, d, "documents").select("doc_id", F.size(F.filter(words, TX.looks_like_url)).alias("n_urls"), F.size(F.filter(words, TX.error_code)).alias("n_codes"), TX.one_line(text).alias("line"))


def key_rebuild(spark, d):
    """Keys taken apart, written in another way, and built again."""
    nodes = read(spark, d, "nodes")
    part = lambda pattern, i: F.regexp_extract("key", pattern, i)
    store, file = r"^(.*?)://(.*?)/(.*)$", r"^([^/]+)/(.*)$"
    built = (
        F.when(F.col("kind") == "datastore", K.datastore_key(F.upper(part(store, 1)), F.nullif(part(store, 2), F.lit("?")), F.upper(part(store, 3))))
        .when(F.col("kind") == "file", K.file_key(part(file, 1), F.concat(F.lit("./././"), F.replace(part(file, 2), F.lit("/"), F.lit("\\")))))
        .when(F.col("kind") == "config", K.config_key(F.substring("key", 5, 10_000)))
        .when(F.col("key").startswith("http:"), K.host_key(F.concat(F.lit("https://"), F.substring("key", 6, 10_000), F.lit("//"))))
    )
    return nodes.filter("kind in ('datastore', 'file', 'config') or key like 'http:%'").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(built == F.col("key")).alias("same"))


def diff_kinds(spark, d):
    """Files of two runs by what changed, and what each kind would have derived again."""
    files = read(spark, d, "files")
    after = files.filter("file_id % 7 <> 0").withColumn("content_sha256", F.when(F.col("file_id") % 5 == 0, F.lit("x")).otherwise(F.col("content_sha256")))
    change = M.diff_files(files, after, ["repo_id", "path"], "content_sha256").groupBy("change").agg(F.count("*").alias("n"))
    steps = F.when(F.col("change") == "unchanged", len(M.plan_derivations(0, False))).otherwise(len(M.plan_derivations(1, False)))
    return change.select("change", "n", steps.alias("n_derived"))


QUERIES = {f.__name__: f for f in (otlp_roundtrip, boot_roundtrip, history_roundtrip, store_upserts, stream_delivered, glob_filter, text_shapes, key_rebuild, diff_kinds)}

ORACLE = {
    "otlp_roundtrip": f"""select distinct trace_id, span_id, nullif(parent_span_id, '') as parent_span_id, name, kind, coalesce(service_name, 'unknown_service') as service_name, start_unix_us, end_unix_us, greatest(0, end_unix_us - start_unix_us) as duration_us, status, status_message, http_route,
      {', '.join(SPELT)}, exception_type, case when exception_type is not null then exception_message end as exception_message, coalesce(semconv, '') as semconv from spans where trace_id <> '' and span_id <> ''""",
    "boot_roundtrip": """with c as (select * from route_chain where evidence_kind = 'boot' qualify row_number() over (partition by route_node_id, phase, position) = 1)
      select service_name as service, service_name || ' ' || upper(method) || ' ' || url as route_key, position, phase, name, key, origin, inherited_from, cast(file_id as varchar) as file, line, end_line, position || ':' || phase as detail from c join routes r on r.node_id = c.route_node_id""",
    "history_roundtrip": """with r as (select commit_sha as sha, strftime(min(started_at), '%Y-%m-%d') as date, min(tool) as author from runs where commit_sha <> '' group by 1)
      select distinct r.sha, r.date, r.author, concat_ws('/', f.repo_id, f.path) as file from files f join runs x on x.run_id = f.last_run_id join r on r.sha = x.commit_sha""",
    "store_upserts": """select 'nodes' as table_name, count(*) + count(*) filter (where kind = 'file') as n_rows, 0 as n_signed from nodes
      union all select 'files', count(*), count(*) filter (where lang = 'python') from files
      union all select 'routes', count(*), count(*) from routes
      union all select 'route_chain', count(*), count(check_kind) from (select * from route_chain qualify row_number() over (partition by route_node_id, phase, position) = 1)""",
    "stream_delivered": "select cast(cast(make_timestamp(start_unix_us) as date) as varchar) as day, count(*) as n, count(*) as n_distinct from (select * from spans qualify row_number() over (partition by trace_id, span_id) = 1) group by 1",
    "glob_filter": r"select file_id, path from files where (regexp_matches(path, '^src/') or regexp_full_match(path, 'lib/[^/]*\.ts')) and not regexp_full_match(path, '(.*/)?[^/]*\.js') and not regexp_matches(path, '^src/jobs/')",
    "text_shapes": r"""with d as (select doc_id, coalesce(text, '') as t from documents), f as (select *, trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as flat from d)
      select doc_id, len(list_filter(string_split(t, ' '), lambda w: starts_with(w, '/') or regexp_matches(w, '^(?i)https?://'))) as n_urls, len(list_filter(string_split(t, ' '), lambda w: regexp_matches(w, '^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+\n?$'))) as n_codes,
        case when length(flat) > 200 then substring(flat, 1, 199) || '…' else flat end as line from f""",
    "key_rebuild": r"select kind, count(*) as n, count(*) filter (where kind <> 'datastore' or key = lower(key)) as same from nodes where kind in ('datastore', 'file', 'config') or starts_with(key, 'http:') group by 1",
    "diff_kinds": "select change, count(*) as n, case when change = 'unchanged' then 0 else 4 end as n_derived from (select case when file_id % 7 = 0 then 'deleted' when file_id % 5 = 0 then 'changed' else 'unchanged' end as change from files) group by 1",
}
