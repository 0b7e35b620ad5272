"""What a language front end hands over: functions, statements, expressions, findings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from spanloom.functions.text import SQL_HEAD, SQL_VERBS

_CODE = re.compile(r"[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+")

# HTTP client objects and the methods that are requests.
HTTP_CLIENTS = {"axios", "fetch", "got", "superagent", "ky", "httpx", "requests", "urllib3"}
HTTP_METHODS = {"get", "post", "put", "patch", "delete", "head", "options", "request"}


@dataclass
class Expr:
    """The few traits of an expression that decide what an exit means."""

    text: str = ""
    ident: str | None = None
    callee: str | None = None
    code: str | None = None
    status: int | None = None
    names: set[str] = field(default_factory=set)
    constructor: str | None = None


@dataclass
class Stmt:
    """kind: if, loop, try, return, throw, assign, call or block (any nested statements)."""

    kind: str
    start: int
    end: int
    expr: Expr | None = None
    target: str | None = None
    body: list[Stmt] = field(default_factory=list)
    orelse: list[Stmt] = field(default_factory=list)
    handlers: list[tuple[int, int, str | None, list[Stmt]]] = field(default_factory=list)
    final: list[Stmt] = field(default_factory=list)
    final_span: tuple[int, int] | None = None


@dataclass
class Function:
    name: str | None
    start: int
    end: int
    body: list[Stmt]
    body_start: int
    params: list[str] = field(default_factory=list)


@dataclass
class Finding:
    """kind: throw, config, sql, http_call, url or env_binding."""

    kind: str
    line: int
    col: int
    name: str | None = None
    detail: str | None = None
    base_var: str | None = None
    path: str | None = None
    dynamic: bool = False


@dataclass
class Source:
    functions: list[Function]
    findings: list[Finding]


def error_code(text: str) -> bool:
    return _CODE.fullmatch(text) is not None


def read_sql(text: str) -> tuple[str, str, str] | None:
    """(verb, table, operation) of a SQL literal; the same rule as the column function."""
    head = text.lstrip()[:SQL_HEAD]
    found = re.match(r"[a-zA-Z]+\b", head)
    verb = found[0].lower() if found else ""
    if verb not in SQL_VERBS:
        return None
    operation, word = SQL_VERBS[verb]
    table = re.search(rf"\b{word}\s+([`\"'\[]?[\w.]+[`\"'\]]?)", head, re.I)
    name = table[1].strip("`\"'[]").lower() if table else ""
    return (verb.upper(), name, operation) if name and not name[0].isdigit() else None


def looks_like_url(text: str) -> bool:
    return text.startswith("/") or re.match(r"https?://", text, re.I) is not None


def distinct(findings: list[Finding]) -> list[Finding]:
    """One finding per kind, place and content, in order."""
    seen: dict[tuple, Finding] = {}
    for f in findings:
        seen.setdefault((f.kind, f.line, f.col, f.name, f.detail, f.path), f)
    return list(seen.values())


def enclosing(functions: list[Function], line: int) -> Function | None:
    """The smallest function around a line, the first of equals."""
    around = [f for f in functions if f.start <= line <= f.end]
    return min(around, key=lambda f: f.end - f.start) if around else None
