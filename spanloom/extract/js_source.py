"""JavaScript and TypeScript front end: a lexer and a statement reader, no full grammar.

Brackets are matched first; statements are then read between them. Types, decorators and
markup are skipped over as expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from spanloom.extract.model import HTTP_CLIENTS, HTTP_METHODS, Expr, Finding, Function, Source, Stmt, distinct, error_code, looks_like_url, read_sql

_NAME = re.compile(r"[A-Za-z_$ª-￿][\w$ª-￿]*")
_NUMBER = re.compile(r"\d[\w.]*")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|.", re.S)
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "await", "new", "typeof"}
_OPEN, _CLOSE = "([{", ")]}"


@dataclass
class Token:
    kind: str  # name, number, string, template, punct
    text: str
    line: int
    col: int
    end_line: int
    parts: tuple = ()


def _template(text: str, at: int) -> int:
    """Index behind a template literal that starts at ``at``."""
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                c = text[at]
                if c == "`":
                    at = _template(text, at)
                    continue
                if c in "'\"":
                    at = _string(text, at)
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            at += 1
    return at


def _string(text: str, at: int) -> int:
    quote, at = text[at], at + 1
    while at < len(text) and text[at] != quote and text[at] != "\n":
        at += 2 if text[at] == "\\" else 1
    return at + 1


def lex(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, line_start = 0, 1, 0

    def push(kind: str, end: int) -> None:
        nonlocal at, line, line_start
        body = text[at:end]
        first, col = line, at - line_start
        breaks = body.count("\n")
        if breaks:
            line += breaks
            line_start = at + body.rfind("\n") + 1
        if kind:
            out.append(Token(kind, body, first, col, line))
        at = end

    while at < len(text):
        c = text[at]
        if c.isspace():
            push("", at + 1)
        elif text.startswith("//", at):
            end = text.find("\n", at)
            push("", len(text) if end < 0 else end)
        elif text.startswith("/*", at):
            end = text.find("*/", at)
            push("", len(text) if end < 0 else end + 2)
        elif c == "`":
            push("template", _template(text, at))
        elif c in "'\"":
            push("string", _string(text, at))
        elif m := _NAME.match(text, at):
            push("name", m.end())
        elif m := _NUMBER.match(text, at):
            push("number", m.end())
        elif c == "/" and (not out or out[-1].text in ("(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "return", "=>")) and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\n\\])+/[a-z]*").match(text, at)):
            push("string", m.end())
        else:
            push("punct", _PUNCT.match(text, at).end())
    return out


class Reader:
    def __init__(self, text: str):
        self.tokens = lex(text)
        self.text = text
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "punct" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "punct" and t.text in _CLOSE and stack:
                j = stack.pop()
                self.match[j], self.match[i] = i, j
        self.bodies: dict[int, Function] = {}
        self._find_functions()

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    # Functions

    def _bound_name(self, i: int) -> str | None:
        """Name a function expression at ``i`` is bound to."""
        j = i - 1
        while self.at(j) in ("async", "("):
            j -= 1
        if self.at(j) in ("=", ":") and j > 0 and self.tokens[j - 1].kind in ("name", "string"):
            return self.at(j - 1).strip("'\"")
        return None

    def _find_functions(self) -> None:
        found: list[tuple[str | None, int, int, int, list[str]]] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "name" and t.text == "function":
                j = i + 1 + (self.at(i + 1) == "*")
                name = self.at(j) if self.at(j) != "(" and self.at(j) else None
                j += name is not None
                if self.at(j) == "(" and j in self.match:
                    body = self._body_after(self.match[j] + 1)
                    if body is not None:
                        found.append((name or self._bound_name(i), i, body, self.match.get(body, len(self.tokens) - 1), self._params(j)))
            elif t.text == "=>":
                start = self.match.get(i - 1, i - 1) if self.at(i - 1) == ")" else i - 1
                if self.at(i + 1) == "{" and i + 1 in self.match:
                    found.append((self._bound_name(start), start, i + 1, self.match[i + 1], self._params(start)))
                else:
                    found.append((self._bound_name(start), start, -(i + 1), self._expression_end(i + 1), self._params(start)))
            elif t.kind == "name" and t.text not in _NOT_METHODS and self.at(i + 1) == "(" and i + 1 in self.match and self.at(i - 1) in ("{", "}", ";", ",", "async", "get", "set", "static", "*"):
                body = self._body_after(self.match[i + 1] + 1)
                if body is not None:
                    found.append((t.text, i, body, self.match.get(body, len(self.tokens) - 1), self._params(i + 1)))
        for name, start, body, end, params in found:
            first = self.tokens[max(start, 0)].line
            last = self.tokens[min(end, len(self.tokens) - 1)].end_line
            if body < 0:
                function = Function(name, first, last, [Stmt("return", self.tokens[min(-body, len(self.tokens) - 1)].line, last, self._expr(-body, end))], first, params)
                self.bodies[-body] = function
            else:
                self.bodies[body] = Function(name, first, last, [], self.tokens[body].line, params)
        for body, function in self.bodies.items():
            if not function.body:
                function.body = self._statements(body + 1, self.match.get(body, len(self.tokens)))

    def _params(self, i: int) -> list[str]:
        return [t.text for t in self.tokens[i : self.match.get(i, i) + 1] if t.kind == "name"]

    def _body_after(self, i: int) -> int | None:
        """The ``{`` of a body behind a parameter list, over a return type."""
        if self.at(i) == "{" and i in self.match:
            return i
        if self.at(i) == ":":
            j = i + 1
            while j < len(self.tokens) and self.at(j) not in (";", "=>", "}", ")"):
                if self.at(j) == "{" and j in self.match and j > i + 1:
                    return j
                j = self.match[j] + 1 if j in self.match and self.at(j) in _OPEN else j + 1
        return None

    def _expression_end(self, i: int) -> int:
        """Index behind an expression: a ``;``, ``,`` or closer on its own level, or a line that ends it."""
        j = i
        while j < len(self.tokens):
            text = self.at(j)
            if self.tokens[j].kind == "punct":
                if text in (";", ",") or text in _CLOSE:
                    return j
                if text in _OPEN and j in self.match:
                    j = self.match[j] + 1
                    continue
            if j > i and self.tokens[j].line > self.tokens[j - 1].end_line and self.tokens[j].kind != "punct" and self.tokens[j - 1].kind != "punct":
                return j
            if j > i and self.tokens[j].line > self.tokens[j - 1].end_line and self.tokens[j].kind != "punct" and self.at(j - 1) in _CLOSE:
                return j
            j += 1
        return j

    # Expressions

    def _slice(self, i: int, j: int) -> str:
        return " ".join(t.text for t in self.tokens[i:j])

    def _text(self, i: int, j: int) -> str:
        out, before = "", None
        for t in self.tokens[i:j]:
            gap = before is not None and (t.line != before.end_line or t.col != before.col + len(before.text))
            out += (" " if gap else "") + " ".join(t.text.split())
            before = t
        return out

    def _callee_at(self, opening: int) -> str:
        """Dotted text in front of a ``(``."""
        j, parts = opening - 1, []
        while j >= 0:
            t = self.tokens[j]
            dotted = not parts or parts[-1] in (".", "?.")
            if t.kind == "name" and dotted or t.text in (".", "?.") and not dotted:
                parts.append(t.text)
                j -= 1
            elif t.text == ")" and j in self.match and parts and parts[-1] in (".", "?."):
                j = self.match[j] - 1
            else:
                break
        return "".join(reversed(parts))

    def _status_in(self, i: int, j: int) -> int | None:
        for k in range(i, j):
            t = self.tokens[k]
            if t.kind != "number" or not t.text.isdigit() or not 100 <= int(t.text) <= 599:
                continue
            if self.at(k - 1) == ":" and "status" in self.at(k - 2).lower():
                return int(t.text)
            opening, level = k, 0
            while level < 3:
                opening -= 1
                while opening >= i and not (self.at(opening) in _OPEN and self.match.get(opening, -1) > k):
                    opening -= 1
                if opening < i:
                    break
                if self.at(opening) == "(" and "status" in self._callee_at(opening).lower():
                    return int(t.text)
                level += 1
        return None

    def _expr(self, i: int, j: int) -> Expr | None:
        while self.at(i) == "await":
            i += 1
        while self.at(i) == "(" and self.match.get(i) == j - 1:
            i, j = i + 1, j - 1
        if i >= j:
            return None
        span = self.tokens[i:j]
        last = self.tokens[j - 1]
        callee = None
        if last.text == ")" and j - 1 in self.match and self.match[j - 1] > i:
            callee = self._callee_at(self.match[j - 1]).replace("?.", ".").rsplit(".", 1)[-1] or None
        code = next((t.text[1:-1] for t in span if t.kind == "string" and error_code(t.text[1:-1])), None)
        ident = span[0].text if len(span) == 1 and span[0].kind == "name" else None
        made = None
        if span[0].text == "new" and len(span) > 1:
            made = span[1].text
        elif callee:
            made = self._callee_at(self.match[j - 1])
        elif ident:
            made = ident
        return Expr(self._text(i, j), ident, None if span[0].text == "new" else callee, code, self._status_in(i, j), {t.text for t in span if t.kind == "name"}, made)

    # Statements

    def _one(self, i: int, end: int) -> tuple[list[Stmt], int]:
        """Statements at ``i`` and the index behind them."""
        if i >= end:
            return [], end
        t = self.tokens[i]
        if t.text == "{" and i in self.match:
            j = self.match[i]
            return ([] if i in self.bodies else self._statements(i + 1, j)), j + 1
        if t.text == "if" and self.at(i + 1) == "(":
            close = self.match.get(i + 1, end)
            body, j = self._one(close + 1, end)
            orelse: list[Stmt] = []
            if self.at(j) == "else" and j < end:
                orelse, j = self._one(j + 1, end)
            return [Stmt("if", t.line, self.tokens[min(j, len(self.tokens)) - 1].end_line, self._expr(i + 2, close), body=body, orelse=orelse)], j
        if t.text in ("for", "while"):
            opening = i + 1 + (self.at(i + 1) == "await")
            body, j = self._one(self.match.get(opening, end) + 1, end)
            return [Stmt("loop", t.line, self.tokens[min(j, len(self.tokens)) - 1].end_line, body=body)], j
        if t.text == "do" and self.at(i + 1) == "{":
            body, j = self._one(i + 1, end)
            if self.at(j) == "while":
                j = self.match.get(j + 1, j) + 1
            return [Stmt("loop", t.line, self.tokens[min(j, len(self.tokens)) - 1].end_line, body=body)], j
        if t.text == "try" and self.at(i + 1) == "{":
            body, j = self._one(i + 1, end)
            s = Stmt("try", t.line, self.tokens[j - 1].end_line, body=body)
            if self.at(j) == "catch":
                start, caught, j = self.tokens[j].line, None, j + 1
                if self.at(j) == "(":
                    caught, j = self.at(j + 1), self.match.get(j, j) + 1
                inner, j = self._one(j, end)
                s.handlers.append((start, self.tokens[j - 1].end_line, caught, inner))
            if self.at(j) == "finally":
                start = self.tokens[j].line
                s.final, j = self._one(j + 1, end)
                s.final_span = (start, self.tokens[j - 1].end_line)
            s.end = self.tokens[j - 1].end_line
            return [s], j
        if t.text == "switch" and self.at(i + 1) == "(":
            opening = self.match.get(i + 1, i) + 1
            close = self.match.get(opening, end)
            return [Stmt("block", t.line, self.tokens[min(close, len(self.tokens) - 1)].line, body=self._statements(opening + 1, close))], close + 1
        if t.text in ("return", "throw"):
            same_line = i + 1 < end and self.tokens[i + 1].line == t.line and self.at(i + 1) not in (";", "}")
            j = min(self._comma_end(i + 1), end) if same_line else i + 1
            last = self.tokens[max(i, j - 1)].end_line
            return [Stmt(t.text, t.line, last, self._expr(i + 1, j) if same_line else None)], j + (self.at(j) == ";")
        if t.text in ("const", "let", "var") and self.at(i + 2) == "=" and self.tokens[i + 1].kind == "name":
            j = min(self._expression_end(i + 3), end)
            return [Stmt("assign", t.line, self.tokens[max(i, j - 1)].end_line, self._expr(i + 3, j), self.at(i + 1))], j + (self.at(j) in (";", ","))
        j = max(min(self._expression_end(i), end), i + 1)
        return [Stmt("block", t.line, self.tokens[j - 1].end_line, self._expr(i, j))], j + (self.at(j) in (";", ",") and j < end)

    def _comma_end(self, i: int) -> int:
        j = self._expression_end(i)
        while self.at(j) == ",":
            j = self._expression_end(j + 1)
        return j

    def _statements(self, i: int, end: int) -> list[Stmt]:
        out: list[Stmt] = []
        while i < end:
            more, j = self._one(i, end)
            out += more
            i = max(j, i + 1)
        return out


def _template_url(token: Token) -> tuple[str | None, str, bool] | None:
    body = token.text[1:-1]
    pieces = re.split(r"\$\{([^}]*)\}", body)
    base, path, dynamic = None, pieces[0], False
    for k in range(1, len(pieces), 2):
        if k == 1 and pieces[0] == "" and _NAME.fullmatch(pieces[k].strip()):
            base = pieces[k].strip()
        else:
            dynamic = True
        if not dynamic:
            path += pieces[k + 1]
    fits = looks_like_url(path) if base is None else path == "" or looks_like_url(path)
    return (base, path, dynamic) if fits else None


def parse(text: str) -> Source:
    r = Reader(text)
    findings: list[Finding] = []
    for i, t in enumerate(r.tokens):
        if t.text == "throw" and t.kind == "name":
            made = r._expr(i + 1, r._expression_end(i + 1))
            findings.append(Finding("throw", t.line, t.col, made.constructor if made and r.at(i + 1) == "new" else None))
        elif t.text == "process" and r.at(i + 1) == "." and r.at(i + 2) == "env":
            name = r.at(i + 4) if r.at(i + 3) == "." else r.at(i + 4).strip("'\"`") if r.at(i + 3) == "[" else ""
            if name:
                findings.append(Finding("config", t.line, t.col, name))
                if r.at(i - 1) == "=" and r.tokens[i - 2].kind == "name":
                    after = i + 5 + (r.at(i + 3) == "[")
                    default = r.at(after + 1)[1:-1] if r.at(after) in ("||", "??") and r.tokens[after + 1].kind == "string" else None
                    findings.append(Finding("env_binding", t.line, t.col, r.at(i - 2), name, path=default if default and looks_like_url(default) else None))
        elif t.kind == "string" and t.text[0] in "'\"":
            if sql := read_sql(t.text[1:-1]):
                findings.append(Finding("sql", t.line, t.col, sql[1], f"{sql[0]} {sql[2]}"))
            if looks_like_url(t.text[1:-1]):
                findings.append(Finding("url", t.line, t.col, None, None, None, t.text[1:-1], False))
        elif t.kind == "template":
            if sql := read_sql(t.text[1:-1]):
                findings.append(Finding("sql", t.line, t.col, sql[1], f"{sql[0]} {sql[2]}"))
            if url := _template_url(t):
                findings.append(Finding("url", t.line, t.col, None, None, *url))
        elif t.kind == "name" and t.text in HTTP_CLIENTS and r.at(i + 1) == "(" and r.at(i - 1) not in (".", "function"):
            findings.append(Finding("http_call", t.line, t.col, None))
        elif t.kind == "name" and t.text in HTTP_METHODS and r.at(i - 1) == "." and r.at(i - 2) in HTTP_CLIENTS and r.at(i - 3) != "." and r.at(i + 1) in ("(", "<"):
            findings.append(Finding("http_call", r.tokens[i - 2].line, r.tokens[i - 2].col, t.text.upper()))
    functions = sorted(r.bodies.values(), key=lambda f: (f.start, f.end))
    return Source(functions, distinct(findings))


def inline_checks(text: str, rules: dict[str, str]) -> list[tuple[int, int, str | None, str, str]]:
    """(line, function line, helper, kind, detail) of reviewed helpers called in a body.

    A helper whose result is bound counts only if a guard returns that result; one called on
    its own counts as an unguarded call.
    """
    from spanloom.extract.cfg import _flat

    out = []
    for f in Reader(text).bodies.values():
        body = list(_flat(f.body))
        guards = {s.expr.ident for s in body if s.kind == "if" and s.expr and s.expr.ident and any(x.kind == "return" and x.expr and x.expr.ident == s.expr.ident for x in s.body)}
        for s in body:
            name = s.expr.callee if s.expr else None
            if name not in rules or s.expr.constructor != name:
                continue
            if s.kind == "assign" and s.target in guards:
                out.append((s.start, f.start, name, rules[name], f"reviewed helper {name}"))
            elif s.kind == "block":
                out.append((s.start, f.start, name, rules[name], f"reviewed helper {name}, unguarded call"))
    return sorted(set(out), key=str)
