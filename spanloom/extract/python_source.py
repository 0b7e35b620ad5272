"""Python front end, on the standard library's parser."""

from __future__ import annotations

import ast
import re

from spanloom.extract.model import HTTP_CLIENTS, HTTP_METHODS, Expr, Finding, Function, Source, Stmt, distinct, error_code, looks_like_url, read_sql

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except Exception:
        return ""


def _callee(node: ast.AST | None) -> str | None:
    return _dotted(node.func).rsplit(".", 1)[-1] if isinstance(node, ast.Call) else None


def _status(node: ast.AST) -> int | None:
    """A literal 100..599 that a call, key or keyword within three levels calls a status."""

    def visit(n: ast.AST, labels: tuple[str, ...]) -> int | None:
        if isinstance(n, ast.Constant) and type(n.value) is int and 100 <= n.value <= 599:
            return n.value if any("status" in x.lower() for x in labels[-3:]) else None
        if isinstance(n, ast.Dict):
            children = [(v, _dotted(k) if k else "") for k, v in zip(n.keys, n.values)]
        elif isinstance(n, ast.Call):
            children = [(n.func, ""), *((a, _dotted(n.func)) for a in n.args), *((k.value, f"{_dotted(n.func)} {k.arg}") for k in n.keywords)]
        else:
            children = [(c, "") for c in ast.iter_child_nodes(n)]
        for child, label in children:
            found = visit(child, (*labels, label))
            if found is not None:
                return found
        return None

    return visit(node, ())


def _expr(node: ast.AST | None) -> Expr | None:
    if node is None:
        return None
    inner = list(ast.walk(node))
    code = next((n.value for n in inner if isinstance(n, ast.Constant) and isinstance(n.value, str) and error_code(n.value)), None)
    made = _dotted(node.func) if isinstance(node, ast.Call) else node.id if isinstance(node, ast.Name) else None
    return Expr(" ".join(_dotted(node).split()), node.id if isinstance(node, ast.Name) else None, _callee(node), code, _status(node), {n.id for n in inner if isinstance(n, ast.Name)}, made)


def _statements(nodes: list[ast.stmt]) -> list[Stmt]:
    out = []
    for n in nodes:
        start, end = n.lineno, n.end_lineno or n.lineno
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            continue
        if isinstance(n, ast.Return):
            out.append(Stmt("return", start, end, _expr(n.value)))
        elif isinstance(n, ast.Raise):
            out.append(Stmt("throw", start, end, _expr(n.exc)))
        elif isinstance(n, ast.If):
            out.append(Stmt("if", start, end, _expr(n.test), body=_statements(n.body), orelse=_statements(n.orelse)))
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
            out.append(Stmt("loop", start, end, body=_statements(n.body), orelse=_statements(n.orelse)))
        elif isinstance(n, (ast.Try, ast.TryStar)):
            last = n.finalbody[-1].end_lineno if n.finalbody else None
            out.append(Stmt("try", start, end, body=_statements(n.body), orelse=_statements(n.orelse), handlers=[(h.lineno, h.end_lineno or h.lineno, _dotted(h.type) if h.type else None, _statements(h.body)) for h in n.handlers], final=_statements(n.finalbody), final_span=(n.finalbody[0].lineno, last) if n.finalbody else None))
        elif isinstance(n, (ast.Assign, ast.AnnAssign)) and n.value is not None:
            target = n.targets[0] if isinstance(n, ast.Assign) else n.target
            out.append(Stmt("assign", start, end, _expr(n.value), target.id if isinstance(target, ast.Name) else None))
        elif isinstance(n, ast.Match):
            out.append(Stmt("block", start, end, body=[s for c in n.cases for s in _statements(c.body)]))
        else:
            out.append(Stmt("block", start, end, _expr(n.value) if isinstance(n, ast.Expr) else None, body=_statements(getattr(n, "body", []) if isinstance(getattr(n, "body", None), list) else [])))
    return out


def _url(node: ast.AST) -> tuple[str | None, str, bool] | None:
    """(base variable, literal path, dynamic) of a string that can be a URL."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return (None, node.value, False) if looks_like_url(node.value) else None
    if not isinstance(node, ast.JoinedStr):
        return None
    base, path, dynamic = None, "", False
    for i, part in enumerate(node.values):
        if isinstance(part, ast.FormattedValue):
            if i == 0 and isinstance(part.value, ast.Name):
                base = part.value.id
            else:
                dynamic = True
        elif not dynamic:
            path += str(part.value)
    fits = looks_like_url(path) if base is None else path == "" or looks_like_url(path)
    return (base, path, dynamic) if fits else None


def _env_name(node: ast.AST) -> str | None:
    """Name of an environment variable this expression reads; values are never looked at."""
    text = _dotted(node)
    if isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and re.fullmatch(r"os\.getenv|os\.environ\.get|getenv|environ\.get", _dotted(node.func)):
        return str(node.args[0].value)
    if isinstance(node, ast.Subscript) and re.fullmatch(r"os\.environ|environ", _dotted(node.value)) and isinstance(node.slice, ast.Constant):
        return str(node.slice.value)
    return None if text else None


def parse(text: str) -> Source:
    tree = ast.parse(text)
    functions, findings = [], []
    inner_strings = {id(v) for n in ast.walk(tree) if isinstance(n, ast.JoinedStr) for v in n.values}
    for n in ast.walk(tree):
        if isinstance(n, _FUNCTIONS):
            args = n.args
            functions.append(Function(n.name, n.lineno, n.end_lineno or n.lineno, _statements(n.body), n.body[0].lineno, [a.arg for a in (*args.posonlyargs, *args.args, *args.kwonlyargs)]))
        if isinstance(n, ast.Raise):
            made = _expr(n.exc)
            findings.append(Finding("throw", n.lineno, n.col_offset, made.constructor if made else None))
        if isinstance(n, (ast.Call, ast.Subscript)) and (name := _env_name(n)):
            findings.append(Finding("config", n.lineno, n.col_offset, name))
        if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name):
            env = next((e for v in ast.walk(n.value) if (e := _env_name(v))), None)
            if env:
                default = n.value.args[1].value if isinstance(n.value, ast.Call) and len(n.value.args) > 1 and isinstance(n.value.args[1], ast.Constant) and looks_like_url(str(n.value.args[1].value)) else None
                findings.append(Finding("env_binding", n.lineno, n.col_offset, n.targets[0].id, env, path=default))
        if isinstance(n, ast.Constant) and isinstance(n.value, str) and id(n) not in inner_strings and (sql := read_sql(n.value)):
            findings.append(Finding("sql", n.lineno, n.col_offset, sql[1], f"{sql[0]} {sql[2]}"))
        if isinstance(n, (ast.Constant, ast.JoinedStr)) and id(n) not in inner_strings and (url := _url(n)):
            findings.append(Finding("url", n.lineno, n.col_offset, None, None, *url))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in HTTP_METHODS and _dotted(n.func.value).split(".", 1)[0] in HTTP_CLIENTS:
            findings.append(Finding("http_call", n.lineno, n.col_offset, n.func.attr.upper()))
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in HTTP_CLIENTS:
            findings.append(Finding("http_call", n.lineno, n.col_offset, None))
    return Source(sorted(functions, key=lambda f: (f.start, f.end)), distinct(sorted(findings, key=lambda f: (f.line, f.col))))


def _from_headers(node: ast.AST, known: set[str]) -> bool:
    return any(isinstance(n, ast.Name) and n.id in known or isinstance(n, ast.Attribute) and n.attr == "headers" or isinstance(n, ast.Call) and _callee(n) == "Header" for n in ast.walk(node))


def inline_checks(text: str, rules: dict[str, str]) -> list[tuple[int, int, str | None, str, str]]:
    """(line, function line, helper, kind, detail): header comparisons that end in 401 or 403.

    Names that come from request headers are followed through assignments until no more join.
    Calls of reviewed helpers count as well.
    """
    out = []
    for f in (n for n in ast.walk(ast.parse(text)) if isinstance(n, _FUNCTIONS)):
        own = [n for s in f.body for n in ast.walk(s)]
        known = {a.arg for a, default in zip(reversed(f.args.args), reversed(f.args.defaults)) if _from_headers(default, set())}
        while True:
            more = {t.id for n in own if isinstance(n, ast.Assign) and _from_headers(n.value, known) for t in n.targets if isinstance(t, ast.Name)} - known
            if not more:
                break
            known |= more
        for n in own:
            if isinstance(n, ast.If) and any(isinstance(c, ast.Compare) for c in ast.walk(n.test)) and _from_headers(n.test, known):
                if any(_status(e) in (401, 403) for s in n.body for e in ast.walk(s) if isinstance(e, ast.Call)):
                    out.append((n.lineno, f.lineno, None, "auth", "compares a request header and refuses"))
            if isinstance(n, ast.Call) and (name := _callee(n)) in rules:
                out.append((n.lineno, f.lineno, name, rules[name], f"calls {name}"))
    return sorted(set(out), key=str)
