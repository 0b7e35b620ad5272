"""Control-flow blocks of a function: guards, branches, loops, handlers and classified exits.

What is not understood is ``unknown``, never ``success``.
"""

from __future__ import annotations

from dataclasses import dataclass

from spanloom.extract.model import Expr, Function, Stmt


@dataclass
class Block:
    block_index: int
    parent_index: int | None
    kind: str
    start_line: int
    end_line: int
    condition_text: str | None = None
    outcome: str | None = None
    exit_form: str | None = None
    error_name: str | None = None


def _flat(statements: list[Stmt]):
    for s in statements:
        yield s
        yield from _flat(s.body)
        yield from _flat(s.orelse)
        for *_, body in s.handlers:
            yield from _flat(body)
        yield from _flat(s.final)


class _Builder:
    def __init__(self, function: Function, builders: set[str]):
        self.builders = builders
        self.blocks = [Block(0, None, "root", function.body_start, function.end)]
        bound = [(s.target, s.expr) for s in _flat(function.body) if s.kind == "assign" and s.target and s.expr and s.expr.callee]
        self.call_bound = {name for name, _ in bound}
        self.error_bound = {name: e.code or e.callee for name, e in bound if e.callee in builders}

    def add(self, kind: str, s: Stmt | tuple[int, int], parent: int, **more) -> int:
        start, end = (s.start, s.end) if isinstance(s, Stmt) else s
        self.blocks.append(Block(len(self.blocks), parent, kind, start, end, **more))
        return len(self.blocks) - 1

    def returned(self, e: Expr | None, parent: int) -> dict:
        if e is None:
            return {"outcome": "success", "exit_form": "implicit"}
        error = lambda name: {"outcome": "error_exit", "exit_form": "return_error", "error_name": name}
        if e.callee in self.builders:
            return error(e.code or e.callee)
        if e.status is not None and e.status >= 400:
            return error(f"HTTP {e.status}")
        for name, code in self.error_bound.items():
            if name in e.names:
                return error(code)
        if e.ident in self.call_bound:
            above = self.blocks[parent]
            if above.kind in ("guard", "branch") and e.ident in (above.condition_text or ""):
                return error(e.ident)
            return {"outcome": "unknown", "exit_form": "return_value"}
        return {"outcome": "success", "exit_form": "return_value"}

    def visit(self, statements: list[Stmt], parent: int) -> None:
        for s in statements:
            if s.kind == "return":
                self.add("exit", s, parent, **self.returned(s.expr, parent))
            elif s.kind == "throw":
                self.add("exit", s, parent, outcome="error_exit", exit_form="throw", error_name=s.expr.constructor if s.expr else None)
            elif s.kind == "if":
                leaves = any(x.kind in ("return", "throw") for x in s.body)
                at = self.add("guard" if leaves else "branch", s, parent, condition_text=s.expr.text if s.expr else None)
                self.visit(s.body, at)
                self.visit(s.orelse, at)
            elif s.kind == "loop":
                self.visit(s.body + s.orelse, self.add("loop", s, parent))
            elif s.kind == "try":
                self.visit(s.body, self.add("try", s, parent))
                for start, end, caught, body in s.handlers:
                    self.visit(body, self.add("catch", (start, end), parent, condition_text=caught))
                self.visit(s.orelse, parent)
                if s.final_span:
                    self.visit(s.final, self.add("finally", s.final_span, parent))
            else:
                self.visit(s.body, parent)


def build(function: Function, builders: set[str]) -> list[Block]:
    """Blocks of one function, the root first; nested functions have their own."""
    b = _Builder(function, builders)
    b.visit(function.body, 0)
    return b.blocks
