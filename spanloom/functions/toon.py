"""A compact table notation for language-model contexts: header once, one row per line."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence


def cell(value: object) -> str:
    """One scalar; text is quoted if it holds a delimiter, a quote or a line break."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    text = str(value)
    if any(c in text for c in '",\n\r'):
        body = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        return f'"{body}"'
    return text


def _uniform(rows: Sequence) -> bool:
    return bool(rows) and all(isinstance(r, Mapping) for r in rows) and all(list(r) == list(rows[0]) for r in rows) and not any(isinstance(v, (Mapping, list, tuple)) for r in rows for v in r.values())


def encode(value: Mapping | Sequence | object, indent: int = 0) -> str:
    """Mappings line by line, uniform tables as ``k[n]{a,b}:``, scalar lists inline, the rest as items."""
    pad = "  " * indent
    if not isinstance(value, Mapping):
        return pad + cell(value)
    out = []
    for key, v in value.items():
        if isinstance(v, Mapping):
            out += [f"{pad}{key}:", encode(v, indent + 1)]
        elif isinstance(v, (list, tuple)):
            if not v:
                out.append(f"{pad}{key}[0]:")
            elif _uniform(v):
                out.append(f"{pad}{key}[{len(v)}]{{{','.join(v[0])}}}:")
                out += [f"{pad}  " + ",".join(cell(x) for x in row.values()) for row in v]
            elif not any(isinstance(x, (Mapping, list, tuple)) for x in v):
                out.append(f"{pad}{key}[{len(v)}]: " + ",".join(cell(x) for x in v))
            else:
                out.append(f"{pad}{key}[{len(v)}]:")
                out += [f"{pad}  - " + encode(x, indent + 2).lstrip() for x in v]
        else:
            out.append(f"{pad}{key}: {cell(v)}")
    return "\n".join(out)


def estimate_tokens(text: str) -> int:
    return -(-len(text) // 4)
