"""Scalar functions on text: paths, SQL literals, tokens, hashes and estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# SQL verbs that are understood, whether they write, and the word before the table.
# upsert and merge are writing verbs as well, but no word names their table, so they read as nothing.
SQL_VERBS = {"select": ("read", "from"), "with": ("read", "from"), "insert": ("write", "into"), "update": ("write", "update"), "delete": ("write", "from"), "replace": ("write", "into")}
SQL_HEAD = 4000


def normalise_path(path: Column) -> Column:
    """Query, fragment and trailing slashes cut; an empty path is ``/``."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(?s)[?#].*$", ""), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def is_wildcard(segment: Column) -> Column:
    return segment.startswith(":") | (segment == "*") | (segment.startswith("{") & segment.endswith("}"))


def path_fits(path: Column, template: Column) -> Column:
    """Whether a concrete path fits a route template, segment by segment."""
    a, b = F.split(normalise_path(path), "/"), F.split(normalise_path(template), "/")
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: is_wildcard(z["b"]) | (z["a"] == z["b"]))


def looks_like_url(text: Column) -> Column:
    return text.rlike("(?i)^https?://") | text.startswith("/")


def read_sql(text: Column) -> Column:
    """struct(verb, table, operation) of a SQL literal, null where no verb or table is plain.

    Looks at the first table after the verb's keyword within SQL_HEAD characters; a join
    reports its first table. Tables come out lower-cased and unquoted.
    """
    head = F.substring(F.ltrim(text), 1, SQL_HEAD)
    verb = F.lower(F.regexp_extract(head, r"^([a-zA-Z]+)\b", 1))
    table, operation = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (kind, word) in SQL_VERBS.items():
        found = F.regexp_extract(head, rf"(?i)\b{word}\s+([`\"'\[]?[\w.]+[`\"'\]]?)", 1)
        table = F.when(verb == name, found).otherwise(table)
        operation = F.when(verb == name, kind).otherwise(operation)
    table = F.lower(F.regexp_replace(table, r"^[`\"'\[]+|[`\"'\]]+$", ""))
    return F.when((table != "") & ~table.rlike(r"^\d"), F.struct(F.upper(verb).alias("verb"), table.alias("table"), operation.alias("operation")))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, case kept."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def squash(text: Column) -> Column:
    return F.lower(F.array_join(tokens(text), ""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length in UTF-16 units, rounded up."""
    return F.ceil(utf16_length(text) / 4).cast("long")


def clip(text: Column, most: int = 4000) -> Column:
    return F.substring(text, 1, most)


def one_line(text: Column, most: int = 200) -> Column:
    """White space flattened; longer texts end in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def collated(column: str) -> Column:
    """``column`` as people sort it: by letters first, then marks and case, whatever the bytes."""
    return F.collate(F.col(column), "UNICODE")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of ``text``."""
    return F.aggregate(F.transform(F.split(text, ""), F.ascii), F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long") % F.lit(1 << 32))


def keep_by_hash(text: Column, rate: float) -> Column:
    """Deterministic sampling: the same id is kept or dropped everywhere."""
    if rate >= 1:
        return F.lit(True)
    if rate <= 0:
        return F.lit(False)
    return F.pmod(fnv1a(text), F.lit(10_000)) / 10_000 < rate


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``**`` crosses ``/``, ``*`` and ``?`` do not."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        elif pattern[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif pattern[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + re.escape(pattern[at]), at + 1
    return f"^{out}$"


def path_allowed(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; no include pattern means everything."""
    ok = F.lit(not include)
    for glob in include:
        ok = ok | path.rlike(glob_regex(glob))
    for glob in exclude:
        ok = ok & ~path.rlike(glob_regex(glob))
    return ok


def error_code(text: Column) -> Column:
    return text.rlike(r"^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$")
