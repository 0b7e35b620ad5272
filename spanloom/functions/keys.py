"""Canonical keys of graph nodes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of packages that stand for the language itself.
BUILTIN_PACKAGES = {"typescript": "builtin:ecmascript", "@types/node": "builtin:node"}


def route_key(service: Column, method: Column, url: Column) -> Column:
    return F.concat_ws(" ", service, F.upper(method), url)


def parse_route_key(key: Column) -> Column:
    """struct(service, method, url); null for what is no route key."""
    pattern = r"^(\S+) ([A-Z]+) (.+)$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    return F.when(key.rlike(pattern), F.struct(part(1).alias("service"), part(2).alias("method"), part(3).alias("url")))


def file_key(repo: Column, path: Column) -> Column:
    return F.concat_ws("/", repo, F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""))


def package_key(manager: Column, name: Column, version: Column) -> Column:
    """``manager:name@version``; type packages name what they type, without a version."""
    typed = F.regexp_extract(name, r"^@types/(.+)$", 1)
    scoped = F.when(typed.contains("__"), F.concat(F.lit("@"), F.regexp_replace(typed, "__", "/"))).otherwise(typed)
    out = F.when(typed != "", F.concat(F.lit("npm:"), scoped)).otherwise(F.concat(manager, F.lit(":"), name, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise("")))
    for package, builtin in BUILTIN_PACKAGES.items():
        out = F.when(name == package, builtin).otherwise(out)
    return out


def host_key(url: Column) -> Column:
    return F.concat(F.lit("http:"), F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "/+$", ""))


def datastore_key(engine: Column, database: Column, table: Column) -> Column:
    return F.concat(F.lower(engine), F.lit("://"), F.coalesce(F.nullif(database, F.lit("")), F.lit("?")), F.lit("/"), F.lower(table))


def config_key(name: Column) -> Column:
    return F.concat(F.lit("env:"), name)


def error_key(constructor: Column) -> Column:
    return F.concat(F.lit("error:"), F.coalesce(constructor, F.lit("(rethrow)")))


def node_id(kind: Column, key: Column) -> Column:
    """Deterministic id of (kind, key), the same in every job."""
    return F.xxhash64(kind, F.lit("\u0000"), key)
