"""Cross-service links: URLs that code really requests, matched to the one route they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import is_wildcard, normalise_path
from spanloom.operators.routing import LOOPBACK


def consumed_urls(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """URL findings whose function makes an HTTP call, or calls a same-file function that does."""
    calls = findings.filter("kind = 'http_call' and function_line is not null").select("path", "function_line", F.col("function_name").alias("wrapper")).distinct()
    urls = findings.filter("kind = 'url' and function_line is not null")
    direct = calls.select("path", "function_line", F.lit(True).alias("_direct")).distinct()
    body = F.array_join(F.slice(F.split("content", "\r?\n"), F.col("function_line"), F.col("function_end") - F.col("function_line") + 1), "\n")
    spans = urls.select("path", "function_line", "function_end").distinct().join(sources.select("path", "content"), "path").select("path", "function_line", body.alias("_body"))
    named = calls.filter("wrapper is not null").select("path", F.col("function_line").alias("_wline"), "wrapper")
    via = spans.join(named, "path").filter("_wline <> function_line").filter(F.expr("regexp_like(_body, concat('\\\\b', wrapper, '\\\\s*\\\\('))")).select("path", "function_line", F.lit(True).alias("_via")).distinct()
    marked = urls.join(direct, ["path", "function_line"], "left").join(via, ["path", "function_line"], "left")
    return marked.filter("_direct or _via").drop("_direct", "_via")


def resolve_base(urls: DataFrame, bindings: DataFrame, services: DataFrame, ports: DataFrame, env: DataFrame) -> DataFrame:
    """``urls`` with callee_service and reason, null where the base is known.

    The base is a literal URL (its host or loopback port), or a variable bound to an
    environment variable: declared to be a service's address (``env``: name, service), or with
    a default URL, or whose name shares a token with exactly one service.
    """
    bound = bindings.select("path", F.col("name").alias("base_var"), F.col("detail").alias("_env"), F.col("url_path").alias("_default")).dropDuplicates(["path", "base_var"])
    rows = urls.join(bound, ["path", "base_var"], "left")
    absolute = F.when(F.col("base_var").isNull() & F.col("url_path").rlike("(?i)^https?://"), F.col("url_path")).otherwise(F.col("_default"))
    rows = rows.withColumn("_host", F.regexp_extract(absolute, r"(?i)^https?://([^/:?#]+)", 1)).withColumn("_port", F.regexp_extract(absolute, r"(?i)^https?://[^/:?#]+:(\d+)", 1).try_cast("int"))
    rows = rows.join(services.select(F.col("host").alias("_host"), F.col("service").alias("_by_host")), "_host", "left")
    rows = rows.join(ports.select(F.col("port").alias("_port"), F.col("service").alias("_by_port")), "_port", "left")
    rows = rows.join(env.select(F.col("name").alias("_env"), F.col("service").alias("_by_env")), "_env", "left")
    names = services.select("service", F.array_distinct(F.split(F.lower("service"), "[^a-z0-9]+")).alias("_tokens")).distinct()
    words = rows.filter("base_var is not null").select("path", "base_var", F.explode(F.split(F.lower(F.concat_ws("_", F.col("_env"), F.col("base_var"))), "[^a-z0-9]+")).alias("_w")).distinct()
    spread = names.select("service", F.explode("_tokens").alias("_w")).filter("length(_w) > 2")
    unique = words.join(spread, "_w").groupBy("path", "base_var").agg(F.countDistinct("service").alias("_n"), F.min("service").alias("_by_token")).filter("_n = 1").drop("_n")
    rows = rows.join(unique, ["path", "base_var"], "left")
    service = F.coalesce("_by_env", "_by_host", F.when(F.col("_host").isin(*LOOPBACK), F.col("_by_port")), "_by_token")
    reason = F.when(service.isNotNull(), None).when(F.col("base_var").isNull(), "the host names no known service").when(F.col("_env").isNull(), "the base variable is bound to nothing known").otherwise("the environment variable names no service")
    return rows.withColumn("callee_service", service).withColumn("reason", reason).drop("_env", "_default", "_host", "_port", "_by_host", "_by_port", "_by_env", "_by_token")


def link(urls: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, unresolved) of consumed URLs with a base: one matching route makes a request.

    No route, several, or a path only known at run time make a gap with its reason. Every
    request is inferred: nothing but a name says that the call arrives there.
    """
    based = urls.filter("callee_service is not null").withColumn("_id", F.struct("path", "line", "col"))
    bare = F.regexp_replace(F.col("url_path"), "(?i)^https?://[^/]+", "")
    clean = F.when(bare.startswith("/"), normalise_path(bare)).otherwise(F.concat(F.lit("/"), normalise_path(bare)))
    # The tail of a path cut at its first unknown piece may go on, so its last slash matters.
    tail = F.regexp_replace(F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare)), "(?s)[?#].*$", "")
    based = based.withColumn("_p", F.split(F.when(F.col("dynamic"), tail).otherwise(clean), "/")).withColumn("_empty", F.col("dynamic") & (bare == ""))
    targets = routes.select("node_id", F.col("service_name").alias("callee_service"), F.col("method").alias("_m"), F.split(normalise_path(F.col("url")), "/").alias("_t"))
    met = based.filter("not _empty").join(targets, "callee_service")
    # A path cut at its first unknown piece fits any template that goes on from there.
    whole = (F.size("_p") == F.size("_t")) & F.forall(F.zip_with("_p", "_t", lambda a, b: is_wildcard(b) | (a == b)), lambda x: x)
    cut = (F.size("_t") >= F.size("_p")) & F.forall(F.zip_with(F.expr("slice(_p, 1, size(_p) - 1)"), F.expr("slice(_t, 1, size(_p) - 1)"), lambda a, b: is_wildcard(b) | (a == b)), lambda x: x)
    last = F.try_element_at("_t", F.size("_p"))
    cut = cut & (is_wildcard(last) | last.startswith(F.element_at("_p", -1)))
    fits = met.filter(F.col("method").isNull() | (F.col("method") == F.col("_m"))).filter(F.when(F.col("dynamic"), cut).otherwise(whole))
    found = fits.groupBy("_id").agg(F.count("*").alias("_n"), F.min("node_id").alias("route_node_id"))
    joined = based.join(found, "_id", "left")
    requests = joined.filter("_n = 1").select("path", "line", "col", "function_name", "callee_service", "url_path", "route_node_id", F.lit("inferred").alias("confidence")).dropDuplicates(["path", "line", "route_node_id"])
    reason = F.when(F.col("_empty"), "dynamic path cannot be matched to a unique route").when(F.col("_n").isNull(), "no indexed route matches the URL").otherwise(F.concat(F.lit("ambiguous route match ("), F.col("_n").cast("string"), F.lit(" candidates)")))
    gaps = joined.filter("_n is null or _n > 1").select("path", "line", "col", F.concat_ws(" ", "callee_service", "url_path").alias("target_hint"), reason.alias("reason"))
    unbased = urls.filter("callee_service is null").select("path", "line", "col", F.coalesce("base_var", "url_path").alias("target_hint"), "reason")
    return requests, gaps.unionByName(unbased).distinct()
