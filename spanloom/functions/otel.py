"""OpenTelemetry values: attribute aliases, any-values, times, kinds and status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical names with the spellings of semantic conventions, newest first.
ALIASES = {
    "http_route": ["http.route"],
    "http_method": ["http.request.method", "http.method"],
    "http_status": ["http.response.status_code", "http.status_code"],
    "url_path": ["url.path", "http.target", "http.path"],
    "code_function": ["code.function.name", "code.function"],
    "code_filepath": ["code.file.path", "code.filepath"],
    "db_system": ["db.system.name", "db.system"],
    "db_name": ["db.namespace", "db.name"],
    "db_operation": ["db.operation.name", "db.operation"],
    "server_address": ["server.address", "net.peer.name", "http.host"],
    "server_port": ["server.port", "net.peer.port"],
}
SPAN_KINDS = ["unspecified", "internal", "server", "client", "producer", "consumer"]


def attribute(attributes: Column, name: str) -> Column:
    """First present spelling of a canonical attribute in a map<string,string>."""
    return F.coalesce(*(F.try_element_at(attributes, F.lit(key)) for key in ALIASES[name]))


def any_value(value: Column) -> Column:
    """A typed OTLP value as a string: string, int, double, bool, else its array as JSON."""
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"), F.to_json(value["arrayValue"]))


def micros(nanos: Column) -> Column:
    """Nanoseconds in text to microseconds, exactly; malformed text is 0."""
    whole = F.split_part(nanos.cast("string"), F.lit("."), F.lit(1)).try_cast("long")
    return F.coalesce(F.floor(whole.cast("decimal(20,0)") / 1000).cast("long"), F.lit(0).cast("long"))


def span_kind(kind: Column) -> Column:
    """Kind from its number (0 unspecified ... 5 consumer) or the rest of its enum name; null for other numbers and empty text."""
    text = F.lower(F.regexp_replace(kind.cast("string"), "^SPAN_KIND_", ""))
    number = text.try_cast("int")
    names = F.array(*(F.lit(k) for k in SPAN_KINDS))
    return F.when(number.isNotNull(), F.when(number >= 0, F.try_element_at(names, number + 1))).otherwise(F.nullif(text, F.lit("")))


def status(code: Column) -> Column:
    text = F.upper(code.cast("string"))
    return F.when(text.isin("2", "STATUS_CODE_ERROR"), "error").when(text.isin("1", "STATUS_CODE_OK"), "ok").otherwise("unset")


def iso_from_micros(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")
