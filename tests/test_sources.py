import json
import struct

import pytest

from spanloom.sources import boot, scip
from spanloom.sources.otlp import normalise, read_otlp
from spanloom.sources.text_inputs import check_rules, history, hunks, repositories, source_files


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def make_index():
    packed = lambda *v: b"".join(map(varint, v))
    first = field(1, packed(0, 9, 15)) + field(2, "scip npm a 1 `x.ts`/f().") + field(3, 1) + field(7, packed(0, 0, 4, 1))
    second = field(1, 3) + field(1, 2) + field(1, 5) + field(2, "local 1") + field(3, 8) + field(5, 7)
    symbol = field(1, "scip npm a 1 `x.ts`/f().") + field(3, "doc") + field(6, "f")
    document = field(1, "x.ts") + field(4, "typescript") + field(2, first) + field(2, second) + field(3, symbol)
    return field(1, field(1, 0)) + field(2, document) + varint(9 << 3 | 1) + struct.pack("<Q", 5) + varint(10 << 3 | 5) + struct.pack("<I", 5)


def test_scip_decoder(spark, tmp_path):
    (tmp_path / "index.scip").write_bytes(make_index())
    index = scip.read_scip(spark, str(tmp_path))
    row = index.first()
    assert (row.path, row.language, len(row.occurrences), row.symbols[0].documentation) == ("x.ts", "typescript", 2, ["doc"])
    assert tuple(row.occurrences[0])[2:] == (0, 0, 9, 0, 15, 0, 4) and tuple(row.occurrences[1])[3:7] == (3, 2, 3, 5)
    assert [tuple(r)[2:] for r in scip.definitions(index).collect()] == [("scip npm a 1 `x.ts`/f().", 1, 5, 1)]
    stats = {r.metric: r.value for r in scip.summarise(index).collect()}
    assert (stats["documents"], stats["occurrences"], stats["definitions"], stats["with_display_name"], stats["role_ReadAccess"], stats["syntax_kind_7"]) == (1, 2, 1, 1, 1, 1)


@pytest.mark.parametrize("data", [b"\x80", b"\x12\x05ab", b"\x0b", b"\x09\x00"])
def test_scip_malformed(data):
    with pytest.raises(ValueError):
        scip.decode_index(data)


def test_boot_dumps(spark, tmp_path):
    entry = {"position": 0, "phase": "onRequest", "name": "auth", "key": "k", "file": "s.js", "line": 3, "col": 1, "anonymous": False, "origin": "scope"}
    dump = {"schema": "boot/1", "service": "svc", "routes": [{"method": "post", "url": "/p", "chain": [entry, entry | {"position": 1, "phase": "handler", "origin": "handler", "name": None}]}]}
    (tmp_path / "a.json").write_text(json.dumps(dump))
    rows = boot.expand_chain(boot.read_boot(spark, str(tmp_path / "a.json"))).orderBy("position").collect()
    assert [(r.route_key, r.position, r.phase, r.detail) for r in rows] == [("svc POST /p", 0, "onRequest", "0:onRequest"), ("svc POST /p", 1, "handler", "1:handler")]
    (tmp_path / "b.json").write_text(json.dumps(dump | {"routes": [{"method": "GET", "url": "/q", "chain": [entry | {"origin": "elsewhere"}]}]}))
    with pytest.raises(Exception, match="svc GET /q"):
        boot.read_boot(spark, str(tmp_path / "b.json")).collect()
    fast = {"schema": "f/1", "service": "py", "middleware": [{"name": "cors", "file": "m.py", "line": 1}], "routes": [{"method": "GET", "url": "/x", "chain": [{"position": 0, "phase": "dependency", "name": "user"}, {"position": 1, "phase": "handler", "name": "x"}]}]}
    (tmp_path / "c.json").write_text(json.dumps(fast))
    rows = boot.expand_chain(boot.read_fastapi(spark, str(tmp_path / "c.json"))).orderBy("position").collect()
    assert [(r.position, r.phase, r.name, r.inherited_from) for r in rows] == [(0, "onRequest", "cors", "py"), (1, "preHandler", "user", None), (2, "handler", "x", None)]


def payload(**over):
    attr = lambda k, v, t="stringValue": {"key": k, "value": {t: v}}
    span = {"traceId": "t1", "spanId": "s1", "parentSpanId": "", "name": "GET", "kind": 2, "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1699999999000000000", "status": {"code": 2}, "attributes": [attr("http.request.method", "GET"), attr("http.method", "OLD"), attr("http.response.status_code", "503", "intValue"), attr("service.version", "2")], "events": [{"name": "exception", "attributes": [attr("exception.type", "Boom"), attr("exception.message", "m")]}]} | over
    return {"resourceSpans": [{"resource": {"attributes": [attr("service.name", "svc"), attr("service.version", "1")]}, "schemaUrl": "https://opentelemetry.io/schemas/1.27.0", "scopeSpans": [{"spans": [span, {"traceId": "t1", "spanId": ""}]}], "instrumentationLibrarySpans": [{"spans": [span | {"spanId": "s2", "kind": "SPAN_KIND_CLIENT", "events": [], "status": {}}]}]}]}


def test_otlp(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(payload()))
    a, b = normalise(read_otlp(spark, str(tmp_path))).orderBy("span_id").collect()
    assert (a.service_name, a.kind, a.status, a.start_unix_us, a.duration_us, a.http_method, a.http_status, a.exception_type, a.semconv, a.parent_span_id) == ("svc", "server", "error", 1700000000000000, 0, "GET", 503, "Boom", "1.27.0", None)
    assert json.loads(a.attributes)["service.version"] == "2"
    assert (b.span_id, b.kind, b.status, b.exception_type) == ("s2", "client", "unset", None)


def test_hunks(spark):
    lines = ["+++ b/a.js", "@@ -1,3 +10,4 @@", "@@ -9 +20 @@", "@@ -9,2 +30,0 @@", "+++ /dev/null", "@@ -1 +1 @@", "+++ b/b.py\tx", "@@ -1,2 +5,2 @@ def"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "diff_id int, line_no int, text string")
    got = {(r["file"], r["first"], r["last"]) for r in hunks(df).collect()}
    assert {("a.js", 10, 13), ("a.js", 20, 20)} <= got and len(got) == 3


def test_small_inputs(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("y")
    (tmp_path / "c.md").write_text("z")
    assert [(r.path, r.lang) for r in source_files(spark, str(tmp_path)).collect()] == [("src/a.ts", "typescript")]
    helpers, builders = check_rules("check_kinds:\n  auth:\n    - needUser  # comment\n  tenant:\n    - scoped\nerror_builders:\n  - fail\n".splitlines())
    assert helpers == {"needUser": "auth", "scoped": "tenant"} and builders == ["fail"]
    with pytest.raises(ValueError, match="line 2"):
        check_rules(["check_kinds:", "  - ??"])
    assert repositories(spark, '{"repos": [{"//": "x", "name": "a", "root": "/r/a", "lang": "python"}]}').first().service_name == "a"
    for bad in ('{"repos": [{"name": "a", "root": "r", "lang": "python"}]}', '{"repos": [{"name": "a", "root": "/r", "lang": "cobol"}]}', '{"repos": [{"root": "/r"}]}'):
        with pytest.raises(ValueError):
            repositories(spark, bad)
    (tmp_path / "log.txt").write_text("s1\u001f2026-01-01\u001fann\n\na.js\nb.js\ns2\u001f2026-01-02\u001fbob\na.js\n")
    assert sorted((r.sha, r.file) for r in history(spark, str(tmp_path / "log.txt")).collect()) == [("s1", "a.js"), ("s1", "b.js"), ("s2", "a.js")]


def test_payloads_are_answered(spark, tmp_path, monkeypatch):
    from spanloom.sources import otlp

    monkeypatch.setattr(otlp, "MOST", 5000)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text("\n".join([json.dumps(payload()), "{broken", "", "\x0a\x05proto", json.dumps({"resourceSpans": [], "pad": "x" * 6000}), json.dumps({"resourceSpans": []})]))
    rows = otlp.read_payloads(spark, str(tmp_path / "in"))
    assert sorted(r.status for r in rows.collect()) == [200, 200, 400, 400, 413]
    assert normalise(otlp.accepted(rows)).count() == 2
    assert {r.status for r in otlp.refused(rows).collect()} == {400, 413} and all(r.problem and r.file for r in otlp.refused(rows).collect())
    stream, out = otlp.read_payloads(spark, str(tmp_path / "in"), stream=True), []
    stream.writeStream.foreachBatch(lambda b, _: out.extend(otlp.refused(b).collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(out) == 3


@pytest.mark.parametrize(
    "over,message",
    [({"framework": "rails"}, "framework"), ({"port": 0}, "port"), ({"port": True}, "port"), ({"include": "*.py"}, "include"), ({"baseUrlEnv": ["X"]}, "baseUrlEnv"), ({"name": "a"}, "twice")],
)
def test_repository_lists_are_checked(spark, over, message):
    good = {"name": "a", "root": "/r/a", "lang": "python", "framework": "fastapi", "port": 4100, "include": ["src/**"], "baseUrlEnv": {"ENGINE_URL": "engine"}, "// why": "x"}
    both = [good, {**good, "name": "b", "service": "bee", **over}]
    with pytest.raises(ValueError, match=message):
        repositories(spark, json.dumps({"repos": both}))
    from spanloom.sources.text_inputs import service_places

    hosts, ports, env = service_places(repositories(spark, json.dumps({"repos": [good, {**good, "name": "b", "service": "bee", "port": None}]})))
    assert {tuple(r) for r in hosts.collect()} == {("a", "a"), ("bee", "bee"), ("b", "bee")} and [tuple(r) for r in ports.collect()] == [(4100, "a")] and {r.name for r in env.collect()} == {"ENGINE_URL"}
