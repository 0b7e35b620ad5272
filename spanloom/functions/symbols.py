"""SCIP symbol strings, parsed inside the JVM.

``<scheme> <manager> <package> <version> <descriptor>...``, or ``local <id>``. A descriptor
is a name, in backticks if it holds other characters, and a suffix that tells its kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"(?:`(?:[^`]|``)*`|[^\s`/#.:!()\[\]]*)"
_DESCRIPTOR = rf"\[{_NAME}\]|\({_NAME}\)(?!\.)|{_NAME}(?:\([^()]*\)\.|/|#|\.|:|!)"
_HEAD = r"^(\S+) (\S+) (\S+) (\S+) (.*)$"


def is_local(symbol: Column) -> Column:
    return symbol.startswith("local ")


def _body(symbol: Column) -> Column:
    return F.regexp_extract(symbol, _HEAD, 5)


def _kind(d: Column) -> Column:
    return (
        F.when(d.startswith("["), "typeParameter")
        .when(d.startswith("("), "parameter")
        .when(d.endswith(")."), "method")
        .when(d.endswith("/"), "namespace")
        .when(d.endswith("#"), "type")
        .when(d.endswith("."), "term")
        .when(d.endswith(":"), "meta")
        .otherwise("macro")
    )


def _name(d: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(d, r"^[\[(]", ""), r"(\([^()]*\)\.|[/#.:!\])])$", "")
    return F.when(bare.startswith("`"), F.replace(F.regexp_replace(bare, "^`|`$", ""), F.lit("``"), F.lit("`"))).otherwise(bare)


def descriptors(symbol: Column) -> Column:
    """array of struct(name, kind); empty for locals and null for null."""
    found = F.regexp_extract_all(_body(symbol), F.lit(_DESCRIPTOR), F.lit(0))
    return F.transform(found, lambda d: F.struct(_name(d).alias("name"), _kind(d).alias("kind")))


def parse_symbol(symbol: Column) -> Column:
    """struct(scheme, manager, package, version, descriptors, local_id)."""
    part = lambda i: F.regexp_extract(symbol, _HEAD, i)
    return F.struct(
        part(1).alias("scheme"), part(2).alias("manager"), part(3).alias("package"), part(4).alias("version"), descriptors(symbol).alias("descriptors"), F.when(is_local(symbol), F.substr(symbol, F.lit(7))).alias("local_id")
    )


def display_name(symbol: Column) -> Column:
    """Name of the last descriptor that has one, else the symbol itself."""
    named = F.filter(descriptors(symbol), lambda d: d["name"] != "")
    return F.coalesce(F.try_element_at(named, F.lit(-1))["name"], symbol)


def container_of(symbol: Column) -> Column:
    """Names before the last descriptor, joined by ``/``."""
    found = descriptors(symbol)
    outer = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
    return F.array_join(F.transform(F.filter(outer, lambda d: d["name"] != ""), lambda d: d["name"]), "/")


def package_of(symbol: Column) -> Column:
    return F.regexp_extract(symbol, _HEAD, 3)


def symbol_kind(symbol: Column) -> Column:
    return F.coalesce(F.try_element_at(descriptors(symbol), F.lit(-1))["kind"], F.lit("unknown"))


def is_type_position(symbol: Column) -> Column:
    return symbol_kind(symbol).isin("type", "typeParameter")


def is_callable_target(symbol: Column) -> Column:
    return symbol_kind(symbol).isin("method", "term")


def is_container(symbol: Column) -> Column:
    return symbol_kind(symbol).isin("namespace", "unknown")


def is_parameter_like(symbol: Column) -> Column:
    return symbol_kind(symbol).isin("parameter", "meta")
