"""Tables of the fact store: explicit schemas, identities and references; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SCHEMA_VERSION = 1


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # needs an active session, so tables are built lazily


@dataclass(frozen=True)
class Table:
    """Columns, what identifies a row, and which columns refer to which table."""

    columns: str
    identity: tuple[str, ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return _struct(self.columns)


TABLES = {
    "repos": Table("repo_id long, name string, root_path string, service_name string", ("name",)),
    "runs": Table("run_id long, repo_id long, commit_sha string, channel string, tool string, started_at timestamp_ntz, finished_at timestamp_ntz", ("run_id",)),
    "files": Table("file_id long, repo_id long, path string, lang string, content_sha256 string, last_run_id long", ("repo_id", "path"), {"last_run_id": ("runs", "run_id")}),
    "nodes": Table("node_id long, kind string, key string, repo_id long", ("kind", "key")),
    "symbols": Table("node_id long, file_id long, display_name string, symbol_kind string, signature string, doc string, start_line int, end_line int, enclosing_node_id long, is_exported boolean, is_test boolean", ("node_id",), {"node_id": ("nodes", "node_id"), "file_id": ("files", "file_id")}),
    "edges": Table(
        "edge_id long, src_node_id long, dst_node_id long, type string, confidence string, evidence_kind string, file_id long, line int, detail string, run_id long, cfg_block_index int, last_observed_at timestamp_ntz",
        ("src_node_id", "dst_node_id", "type", "evidence_kind", "file_id", "line"),
        {"src_node_id": ("nodes", "node_id"), "dst_node_id": ("nodes", "node_id"), "file_id": ("files", "file_id"), "run_id": ("runs", "run_id")},
    ),
    "routes": Table(
        "node_id long, repo_id long, service_name string, method string, url string, prefix string, handler_node_id long, request_schema string, response_schema string, has_schema boolean, source string, run_id long",
        ("node_id",),
        {"node_id": ("nodes", "node_id"), "handler_node_id": ("nodes", "node_id"), "run_id": ("runs", "run_id")},
    ),
    "route_chain": Table(
        "route_node_id long, position int, phase string, symbol_node_id long, key string, name string, check_kind string, origin string, inherited_from string, confidence string, evidence_kind string, file_id long, line int, end_line int, detail string, run_id long",
        ("route_node_id", "phase", "position"),
        {"route_node_id": ("nodes", "node_id"), "symbol_node_id": ("nodes", "node_id"), "file_id": ("files", "file_id"), "run_id": ("runs", "run_id")},
    ),
    "unresolved_calls": Table("src_node_id long, kind string, target_hint string, reason string, file_id long, line int, col int, run_id long", ("src_node_id", "kind", "target_hint", "file_id", "line", "col"), {"src_node_id": ("nodes", "node_id")}),
    "function_cfg": Table(
        "symbol_node_id long, block_index int, parent_index int, kind string, condition_text string, outcome string, exit_form string, error_name string, start_line int, end_line int, file_id long, run_id long",
        ("symbol_node_id", "block_index"),
        {"symbol_node_id": ("nodes", "node_id"), "file_id": ("files", "file_id"), "run_id": ("runs", "run_id")},
    ),
    "spans": Table(
        "trace_id string, span_id string, parent_span_id string, name string, kind string, service_name string, start_unix_us long, end_unix_us long, duration_us long, status string, status_message string, http_route string, http_method string, http_status int, code_function string, code_filepath string, db_system string, db_name string, db_operation string, server_address string, server_port int, url_path string, exception_type string, exception_message string, semconv string, attributes string, received_at timestamp_ntz",
        ("trace_id", "span_id"),
    ),
    "co_changed": Table("repo_id long, file_a string, file_b string, commits long, support_a double, support_b double, last_commit string, last_date string, run_id long", ("repo_id", "file_a", "file_b")),
    "search_docs": Table("node_key string, kind string, name string, qualified string, signature string, doc string, path string", ("node_key",)),
    "search_vectors": Table("node_key string, kind string, vector array<float>, built_at timestamp_ntz", ("node_key",)),
    "summaries": Table("node_key string, kind string, input_sha256 string, summary string, model string, provider string, tokens_in int, tokens_out int, generated_at timestamp_ntz", ("node_key", "kind", "input_sha256")),
}

# The enums of the store.
ENUMS = {
    ("nodes", "kind"): ["service", "route", "symbol", "file", "external", "datastore", "config"],
    ("edges", "confidence"): ["certain", "observed", "inferred", "unresolved"],
    ("edges", "evidence_kind"): ["scip", "treesitter", "semgrep", "boot", "otel", "manual"],
    ("runs", "channel"): ["static", "boot", "runtime"],
    ("route_chain", "origin"): ["scope", "route", "framework", "handler"],
    ("unresolved_calls", "kind"): ["call", "cross_service", "datastore"],
    ("function_cfg", "kind"): ["root", "branch", "guard", "try", "catch", "finally", "loop", "exit"],
    ("function_cfg", "outcome"): ["success", "error_exit", "unknown"],
    ("function_cfg", "exit_form"): ["throw", "return_error", "return_value", "implicit"],
}
STATIC_EVIDENCE = ["scip", "treesitter", "semgrep"]
