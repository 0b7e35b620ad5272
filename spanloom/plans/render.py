"""Answers as text, Mermaid, TOON and pull-request comments: small collected results only."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.toon import encode
from spanloom.plans.engine import Answer

MERMAID_NODES = 40
MERMAID_GAPS = 5
COMMENT_MARK = "<!-- route impact -->"


def _label(kind: str, key: str) -> str:
    return key.rsplit("/", 1)[-1].rstrip("().") if kind == "symbol" else key


def flow_lines(answer: Answer) -> list[str]:
    """The flow as an indented tree: one line per step, with what stops it."""
    rows = answer["steps"].select("position", F.col("edge_path").cast("array<string>").alias("e"), "depth", "line", "kind", "key", "path_confidence", "cycle", "truncated").collect()
    out, at = [], None
    for r in sorted(rows, key=lambda r: (r.position, [(len(x), x) for x in r.e])):
        if r.position != at:
            at = r.position
            out.append(f"[{at}]")
        stop = " (cycle)" if r.cycle else " (deeper calls cut)" if r.truncated else ""
        sure = "" if r.path_confidence == "certain" else f" ~{r.path_confidence}"
        out.append("  " * (r.depth + 1) + _label(r.kind or "", r.key or "?") + (f" :{r.line}" if r.line is not None else "") + sure + stop)
    for r in answer["unjoined"].select("phase", "key").collect():
        out.append(f"? {r.phase}: {r.key or 'anonymous'} is joined to no symbol")
    return out


def flow_mermaid(answer: Answer, nodes, links) -> str:
    """A flow chart of at most MERMAID_NODES nodes; what is cut is said, gaps are listed."""
    kept = nodes.orderBy("depth", "key").limit(MERMAID_NODES + 1).collect()
    cut = len(kept) > MERMAID_NODES
    kept = kept[:MERMAID_NODES]
    ids = {r.node_id: f"n{i}" for i, r in enumerate(kept)}
    quoted = lambda t: t.replace('"', "'")
    out = ["flowchart TD"] + [f'  {ids[r.node_id]}["{quoted(_label(r.kind or "", r.key or "?"))}"]' for r in kept]
    wanted = links.filter(F.col("src").isin(*ids) & F.col("dst").isin(*ids)).orderBy("src", "dst", "type").collect()
    out += [f"  {ids[r.src]} {'-->' if r.confidence == 'certain' else '-.->'}|{r.type}| {ids[r.dst]}" for r in wanted]
    if cut:
        out.append(f"  more[more than {MERMAID_NODES} nodes]")
    out += [f'  gap{i}["? {quoted(r.target_hint or "")}: {quoted(r.reason or "")}"]' for i, r in enumerate(answer["unknown"].orderBy("src_node_id", "line").limit(MERMAID_GAPS).collect())]
    return "\n".join(out)


def impact_lines(answer: Answer) -> list[str]:
    routes = answer["routes"].orderBy("bucket", "service_name", "url", "method").collect()
    out = [f"fan-in {answer.facts['fan_in']}" + (", a utility" if answer.facts["is_utility"] else "")]
    for bucket in ("certain", "inferred", "unknown"):
        mine = [r for r in routes if r.bucket == bucket]
        if mine:
            out += [f"{bucket}:"] + [f"  {r.service_name} {r.method} {r.url}" for r in mine]
    if routes and routes[0].total > len(routes):
        out.append(f"{routes[0].total} routes in all, {len(routes)} shown")
    return out


def impact_comment(answer: Answer) -> str:
    """A pull-request comment that a later run can find again by its mark."""
    routes = answer["routes"].orderBy("bucket", "service_name", "url", "method").collect()
    out = [COMMENT_MARK, f"**{len(routes)} routes** can be affected by this change.", ""]
    if routes:
        out += ["| route | evidence |", "|---|---|"] + [f"| `{r.service_name} {r.method} {r.url}` | {r.bucket} |" for r in routes]
    unmapped = answer["unmapped"].orderBy("file", "first").collect()
    if unmapped:
        out += ["", "Not mapped to a symbol: " + ", ".join(f"`{r['file']}:{r['first']}-{r['last']}`" for r in unmapped)]
    unindexed = [r.file for r in answer["unindexed"].orderBy("file").collect()]
    if unindexed:
        out += ["", "Not indexed: " + ", ".join(f"`{f}`" for f in unindexed)]
    return "\n".join(out)


def pack_toon(answer: Answer) -> str:
    """A context pack in TOON, tier by tier, gaps last."""
    rows = answer["items"].orderBy("tier", "item").collect()
    tiers: dict[str, list] = {}
    for r in rows:
        tiers.setdefault(r.tier, []).append(r.item)
    gaps = [{"kind": g.kind, "target": g.target_hint, "reason": g.reason} for g in answer["gaps"].select("kind", "target_hint", "reason").collect()]
    return encode({**tiers, "gaps": gaps})


def security_lines(rows) -> list[str]:
    """Coverage per route, anomalies marked."""
    out = []
    for r in rows.orderBy("service_name", "url", "method").collect():
        mark = "!" if r.writes_without_tenant else "-" if r.unprotected else " "
        out.append(f"{mark} {r.service_name} {r.method} {r.url}  checks: {r.kinds or 'none'}  writes: {r.n_writes}")
    return out


def display(key: str) -> str:
    return _label("symbol", key)


__all__ = ["display", "flow_lines", "flow_mermaid", "impact_comment", "impact_lines", "pack_toon", "security_lines"]


def error_lines(answer: Answer) -> list[str]:
    """What did and what can fail, side by side; an empty half says so, since absence is no proof."""
    seen = answer["observed"].orderBy("trace_id").collect()
    out = ["observed:"] + [f"  {r.trace_id}: {r.chain}" for r in seen] if seen else ["observed: no errored trace"]
    static = answer["surface"].orderBy("symbol_node_id", "start_line").collect()
    out += ["can fail:"] + [f"  {r.error_name or r.exit_form} :{r.start_line}" + (f" if {r.guard}" if r.guard else "") for r in static] if static else ["can fail: no error exit known"]
    thrown = answer["throws"].count()
    opaque, gaps = answer["opaque_exits"].count(), answer["unknown"].count()
    if thrown:
        out.append(f"{thrown} more thrown errors outside known control flow")
    if opaque or gaps:
        out.append(f"not known: {opaque} exits without an outcome, {gaps} calls without a target")
    return out


def report_lines(report) -> list[str]:
    """An index run (``plans.pipeline.Report``): what changed, what was derived, what was missing."""
    changes = ", ".join(f"{n} {c}" for c, n in sorted(report.changes.items())) or "no files"
    if report.skipped:
        return [f"files: {changes}", "nothing touched, nothing derived"]
    return [f"files: {changes}", *(f"{name}: {n}" for name, n in sorted(report.rows.items())), *(f"missing: {m}, its facts were not derived" for m in report.missing)]


def scan_lines(findings) -> list[str]:
    """Findings per kind, and the files that could not be read."""
    kinds = findings.filter("problem is null").groupBy("kind").count().orderBy("kind").collect()
    broken = findings.filter("problem is not null").select("path", "problem").orderBy("path").collect()
    return [f"{r['kind']}: {r['count']}" for r in kinds] + [f"! {r.path}: {r.problem}" for r in broken]
