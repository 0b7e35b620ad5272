"""OTLP/JSON traces, from files or as a stream of files, normalised to span rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import one_line
from spanloom.functions.otel import ALIASES, any_value, attribute, micros, span_kind, status

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:struct<values:array<struct<stringValue:string,intValue:string>>>>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{_ATTRS},events:array<struct<name:string,attributes:{_ATTRS}>>>"
_SCOPE = f"array<struct<spans:array<{_SPAN}>>>"
OTLP = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,schemaUrl:string,scopeSpans:{_SCOPE},instrumentationLibrarySpans:{_SCOPE}>>"


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OTLP).json(path)


def stream_otlp(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Payload files as they arrive in ``path``; a thin HTTP front door only has to drop them there."""
    return spark.readStream.schema(OTLP).option("maxFilesPerTrigger", files_per_trigger).json(path)


#: Characters of a payload beyond which it is turned away.
MOST = 16 * 1024 * 1024


def read_payloads(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(file, body, payload, status, problem), one row per line of the files in ``path``.

    status is that of the answer a sender would get: 200, 400 for what is no JSON of the
    expected shape, 413 for what is too long. ``accepted`` takes the first, and ``refused``
    keeps the others with their reason, so that nothing vanishes silently.
    """
    reader = spark.readStream if stream else spark.read
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    long = F.length("body") > MOST
    parsed = F.from_json(F.when(~long, F.col("body")), f"{OTLP}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.filter(F.trim("body") != "").withColumn("payload", parsed)
    broken = F.col("payload").isNull() | F.col("payload._bad").isNotNull()
    status = F.when(long, 413).when(broken, 400).otherwise(200)
    problem = F.when(long, F.concat(F.lit(f"longer than {MOST} characters: "), F.length("body"))).when(broken, "not readable as JSON traces; the sender must use the JSON encoding")
    return rows.select("file", "body", "payload", status.alias("status"), problem.alias("problem"))


def accepted(payloads: DataFrame) -> DataFrame:
    return payloads.filter("status = 200").select("payload.resourceSpans")


def refused(payloads: DataFrame) -> DataFrame:
    return payloads.filter("status <> 200").select("file", "status", "problem", one_line(F.col("body")).alias("head"))


def _attribute_map(attributes) -> F.Column:
    """map<string,string> of key-value structs; of a repeated key the last stands."""
    pairs = F.coalesce(attributes, F.array().cast(_ATTRS))
    entries = F.transform(F.filter(pairs, lambda a: a["key"].isNotNull()), lambda a: F.struct(a["key"].alias("key"), any_value(a["value"]).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def _overlay(base, over) -> F.Column:
    """``base`` with the entries of ``over`` on top."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def normalise(payloads: DataFrame) -> DataFrame:
    """Span rows: service, times, kind, status, well-known attributes, exceptions.

    Span attributes lie over resource attributes, new spellings before old ones, the legacy
    scope list beside the present one. Spans without trace or span id are dropped as malformed;
    a negative duration is 0; an empty parent id means none.
    """
    resource = payloads.select(F.explode("resourceSpans").alias("r")).select(_attribute_map(F.col("r.resource.attributes")).alias("_res"), F.concat(F.coalesce("r.scopeSpans", F.array().cast(_SCOPE)), F.coalesce("r.instrumentationLibrarySpans", F.array().cast(_SCOPE))).alias("_scopes"), F.col("r.schemaUrl").alias("_url"))
    spans = resource.select("_res", "_url", F.explode("_scopes").alias("sc")).select("_res", "_url", F.explode("sc.spans").alias("s"))
    spans = spans.filter("coalesce(s.traceId, '') <> '' and coalesce(s.spanId, '') <> ''")
    thrown = F.filter(F.coalesce("s.events", F.array().cast(f"array<struct<name:string,attributes:{_ATTRS}>>")), lambda e: e["name"] == "exception")
    spans = spans.withColumn("_attrs", _overlay(F.col("_res"), _attribute_map(F.col("s.attributes")))).withColumn("_exc", _attribute_map(F.try_element_at(thrown, F.lit(1))["attributes"]))
    start, end = micros(F.col("s.startTimeUnixNano")), micros(F.col("s.endTimeUnixNano"))
    typed = [attribute(F.col("_attrs"), c).try_cast("int" if c in ("http_status", "server_port") else "string").alias(c) for c in ALIASES]
    return spans.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.expr("nullif(s.parentSpanId, '')").alias("parent_span_id"), F.col("s.name").alias("name"), span_kind(F.col("s.kind")).alias("kind"),
        F.coalesce(F.try_element_at("_attrs", F.lit("service.name")), F.lit("unknown_service")).alias("service_name"), start.alias("start_unix_us"), end.alias("end_unix_us"), F.greatest(F.lit(0), end - start).alias("duration_us"), status(F.col("s.status.code")).alias("status"), F.col("s.status.message").alias("status_message"),
        *typed, F.try_element_at("_exc", F.lit("exception.type")).alias("exception_type"), F.try_element_at("_exc", F.lit("exception.message")).alias("exception_message"), F.regexp_extract(F.coalesce("_url", F.lit("")), r"([\d.]+)$", 1).alias("semconv"), F.to_json("_attrs").alias("attributes"),
    )
