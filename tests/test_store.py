import pytest

from spanloom.operators import mutations as M
from spanloom.schema import TABLES
from spanloom.store import Store


def table(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name].schema)


def edge(i, a, b, type="CALLS", evidence="scip", file=1, line=1):
    return (i, a, b, type, "certain", evidence, file, line, None, 1, None, None)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_commit_read_and_empty_tables(spark, store):
    assert store.read("nodes").count() == 0 and store.snapshot == 0
    store.commit({"nodes": table(spark, "nodes", [(1, "file", "a", 1)]), "edges": table(spark, "edges", [edge(1, 1, 1)])})
    assert store.snapshot == 1 and store.read("nodes").count() == 1
    before = store.read("nodes")
    store.insert("nodes", table(spark, "nodes", [(2, "file", "a", 7), (3, "file", "b", 7)]))
    assert sorted((r.node_id, r.repo_id) for r in store.read("nodes").collect()) == [(1, 1), (3, 7)]
    assert before.count() == 1  # an older snapshot stays readable


def test_failed_commit_changes_nothing(spark, store):
    store.commit({"nodes": table(spark, "nodes", [(1, "file", "a", 1)])})
    bad = table(spark, "nodes", [(2, "file", "b", 1)]).selectExpr("node_id", "kind", "raise_error('broken') as key", "repo_id")
    with pytest.raises(Exception, match="broken"):
        store.commit({"edges": table(spark, "edges", [edge(1, 1, 1)]), "nodes": bad})
    assert store.snapshot == 1 and store.read("edges").count() == 0


def test_upserts_and_replacement(spark, store):
    files = lambda *rows: table(spark, "files", rows)
    store.upsert("files", files((1, 1, "a", "js", "x", 1), (2, 1, "b", "js", "y", 1)))
    store.upsert("files", files((1, 1, "a", "js", "z", 2)))
    assert sorted((r.path, r.content_sha256) for r in store.read("files").collect()) == [("a", "z"), ("b", "y")]
    block = lambda s, b: (s, b, None, "root", None, None, None, None, 1, 2, 1, 1)
    store.replace_cfg(table(spark, "function_cfg", [block(1, 0), block(1, 1), block(2, 0)]))
    store.replace_cfg(table(spark, "function_cfg", [block(1, 5)]))
    assert sorted((r.symbol_node_id, r.block_index) for r in store.read("function_cfg").collect()) == [(1, 5), (2, 0)]
    assert {r.table_name: r.n_rows for r in store.counts().collect()} == {"files": 2, "function_cfg": 2}


def test_edge_identity_with_nulls(spark):
    old = table(spark, "edges", [edge(1, 1, 2, file=None, line=None)])
    new = table(spark, "edges", [edge(2, 1, 2, file=None, line=None), edge(3, 1, 2), edge(4, 1, 2)])
    assert sorted(r.edge_id for r in M.first_wins(old, new, list(TABLES["edges"].identity)).collect()) == [1, 3]


def test_reindex_by_provenance(spark, store):
    files = [(1, 1, "a.ts", "ts", "old", 1), (2, 1, "b.ts", "ts", "same", 1), (3, 1, "c.ts", "ts", "gone", 1)]
    edges = [edge(1, 1, 2, file=1), edge(2, 2, 1, file=2), edge(3, 1, 9, "HANDLES", "boot", file=1), edge(4, 1, 3, evidence="otel", file=None, line=None), edge(5, 3, 1, "HANDLES", "boot", file=3), edge(6, 3, 1, file=3)]
    store.commit({"files": table(spark, "files", files), "edges": table(spark, "edges", edges)})
    after = table(spark, "files", [(1, 1, "a.ts", "ts", "new", 2), (2, 1, "b.ts", "ts", "same", 1)])
    store.reindex(store.read("files"), after)
    assert sorted(r.edge_id for r in store.read("edges").collect()) == [2, 3, 4]
    assert store.read("files").count() == 2


def test_deletes_and_plans(spark):
    edges = table(spark, "edges", [edge(1, 1, 2, file=1), edge(2, 1, 2, evidence="boot", file=1)])
    file = spark.createDataFrame([(1,)], "file_id long")
    assert M.delete_by_provenance(edges, file, []).count() == 2
    assert [r.edge_id for r in M.delete_by_provenance(edges, file, ["scip"]).collect()] == [2]
    assert M.plan_derivations(0, False) == [] and M.plan_derivations(0, True) == M.plan_derivations(3, False) != []


def test_diff_and_audit(spark):
    before = table(spark, "files", [(1, 1, "a", "ts", "1", 1), (2, 1, "b", "ts", "2", 1), (3, 1, "c", "ts", None, 1)])
    after = table(spark, "files", [(1, 1, "a", "ts", "9", 1), (3, 1, "c", "ts", None, 1), (4, 1, "d", "ts", "4", 1)])
    assert {r.path: r.change for r in M.diff_files(before, after, ["repo_id", "path"], "content_sha256").collect()} == {"a": "changed", "b": "deleted", "c": "unchanged", "d": "added"}
    found = M.audit({"nodes": table(spark, "nodes", [(1, "file", "a", 1), (2, "odd", "b", 1)]), "edges": table(spark, "edges", [edge(1, 1, 5), edge(2, 1, 5), edge(3, 1, 2)])})
    bad = {(r.table_name, r.column_name, r.problem): r.n_rows for r in found.collect() if r.n_rows}
    assert bad == {("edges", "dst_node_id", "reference"): 2, ("nodes", "kind", "enum"): 1}


def test_two_writers_of_one_table(spark, store):
    from spanloom.store import Conflict

    nodes = lambda *ids: table(spark, "nodes", [(i, "file", f"f{i}", 1) for i in ids])
    store.commit({"nodes": nodes(1)})
    other = Store(spark, store.path)
    base = store.snapshot
    other.insert("nodes", nodes(2))
    with pytest.raises(Conflict):
        store.commit({"nodes": nodes(1, 3)}, base)
    assert store.snapshot == 2 and sorted(r.node_id for r in store.read("nodes").collect()) == [1, 2]
    # Another table goes on top of what was committed meanwhile.
    assert store.commit({"edges": table(spark, "edges", [edge(1, 1, 2)])}, base) == 3
    assert store.read("nodes").count() == 2 and store.read("nodes", 1).count() == 1


def test_an_update_that_was_overtaken_runs_again(spark, store):
    store.commit({"nodes": table(spark, "nodes", [(1, "file", "a", 1)])})
    other, calls = Store(spark, store.path), []

    def change(old):
        if not calls:
            other.insert("nodes", table(spark, "nodes", [(2, "file", "b", 1)]))
        calls.append(1)
        return M.first_wins(old, table(spark, "nodes", [(3, "file", "c", 1)]), ["kind", "key"])

    store.update(nodes=change)
    assert len(calls) == 2 and sorted(r.node_id for r in store.read("nodes").collect()) == [1, 2, 3]


def test_vacuum_keeps_what_is_named(spark, store):
    for i in range(4):
        store.commit({"nodes": table(spark, "nodes", [(i, "file", "a", 1)])} | ({"edges": table(spark, "edges", [edge(1, 1, 1)])} if i == 0 else {}))
    assert store.vacuum(keep=1) == 3
    assert store.read("nodes").first().node_id == 3 and store.read("edges").count() == 1 and store.vacuum(keep=1) == 0


def test_migrations_go_step_by_step(spark, store, monkeypatch):
    from spanloom import store as module

    store.commit({"nodes": table(spark, "nodes", [(1, "file", "A", 1)])})
    assert store.migrate() == []
    monkeypatch.setattr(module, "SCHEMA_VERSION", 3)
    monkeypatch.setattr(module, "MIGRATIONS", {1: lambda t: {"nodes": t["nodes"].selectExpr("node_id", "kind", "lower(key) as key", "repo_id")}, 2: lambda t: {"nodes": t["nodes"].selectExpr("node_id + 10 as node_id", "kind", "key", "repo_id")}})
    assert store.migrate() == [2, 3] and store.migrate() == []
    assert tuple(store.read("nodes").first()) == (11, "file", "a", 1)
    monkeypatch.setattr(module, "SCHEMA_VERSION", 2)
    with pytest.raises(ValueError, match="version 3"):
        store.read("nodes")


def test_runs_and_methods(spark, store):
    store.start_run(1, 7, "static", "indexer", at="2026-01-01 00:00:00")
    store.start_run(1, 8, "boot", "again")
    store.finish_run(1, at="2026-01-02 00:00:00")
    store.finish_run(1, at="2026-01-03 00:00:00")
    row = store.read("runs").first()
    assert (row.repo_id, row.channel, row.started_at.day, row.finished_at.day, store.read("runs").count()) == (7, "static", 1, 2, 1)
    store.upsert("routes", table(spark, "routes", [(1, 1, "svc", "get", "/a", None, None, None, None, False, "boot", 1)]))
    assert store.read("routes").first().method == "GET"
