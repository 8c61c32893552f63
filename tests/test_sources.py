import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from tributary.__main__ import main
from tributary.operators.rows import transform, transform_split
from tributary.plans.pipeline import Pipeline, PlanFault, column_lineage, load
from tributary.sources import interchange, readers, rest, writers

GOOD = "UNB+UNOC:3+A+B+240101:1200+R1'UNH+1+X'LIN+a?+b'UNT+3+1'UNH+2+X'UNT+2+2'UNZ+2+R1'"


@pytest.mark.parametrize(
    "change,why",
    [
        (("UNT+3+1", "UNT+4+1"), "UNT counts '4', there are 3"),
        (("UNT+3+1", "UNT+3+9"), "UNT names '9', not '1'"),
        (("UNZ+2", "UNZ+3"), "UNZ counts"),
        (("+2+R1'", "+2+R2'"), "UNZ names"),
        (("UNZ+2+R1'", ""), "the end is missing"),
        (("UNZ+2+R1'", "UNZ+2+R1'LIN+1'"), "LIN after the end"),
        (("UNH+1+X'", ""), "LIN outside of a message"),
        (("UNT+3+1'", ""), "UNH out of place"),
    ],
)
def test_broken_structure(change, why):
    with pytest.raises(interchange.Malformed, match=why):
        list(interchange.body(readers.segments(GOOD.replace(*change), "edifact"), "edifact"))


def test_a_broken_interchange_goes_as_a_whole(spark, tmp_path):
    (tmp_path / "a.edi").write_text(GOOD)
    (tmp_path / "b.edi").write_text(GOOD.replace("UNZ+2", "UNZ+3"))
    (tmp_path / "c.edi").write_text("\n")
    good, bad = interchange.read_messages(spark, [str(tmp_path)], "edifact", 4)
    assert [(r.seg_id, r.msg_ref, r.e01, r.e02, r._doc_interchange.e02) for r in good.orderBy("position").collect()] == [("UNH", "1", "1", "X", "A"), ("LIN", "1", "a+b", None, "A"), ("UNH", "2", "2", "X", "A")]
    got = sorted((r._file[-5:], r.position, r._error) for r in bad.collect())
    assert got == [("b.edi", 1, "document_rejected"), ("b.edi", 2, "document_rejected"), ("b.edi", 3, "document_rejected"), ("b.edi", 4, "structural_validation"), ("c.edi", 1, "structural_validation")]


def test_frames_count_what_they_hold():
    f = interchange.Framer("x12", [["00"], ["PO"]], "850")
    lines = [x for refs, tag in (("IGA", "N1"), ("IGA", "N2"), ("IGB", "N1"), ("IHB", "N1")) for x in f.row(list(refs), tag, ["v", None])] + list(f.end())
    assert [x for x in lines if x[:2] in ("SE", "GE", "IE")] == ["SE*4*A~", "SE*3*B~", "GE*2*G~", "SE*3*B~", "GE*1*H~", "IEA*2*I~"]  # SE counts ST and itself
    with pytest.raises(ValueError, match="delimiter"):
        list(f.row(["I", "G", "A"], "N1", ["a*b"]))


class Pages(BaseHTTPRequestHandler):
    """Seven records in pages of three, by each way of paging; every first try of a page fails."""

    failed: set = set()

    def log_message(self, *_):
        pass

    def do_GET(self):  # noqa: N802
        url = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        status, headers, at = 200, [], int(q.get("offset", q.get("page", 0)))
        rows = [{"id": k, "name": f"n{k}", "tags": ["x"]} for k in range(at, min(7, at + 3))]
        doc = {"items": rows, "meta": {"next": at + 3 if at + 3 < 7 else None}}
        if self.path not in self.failed and url.path != "/missing":
            self.failed.add(self.path)
            status = 503
        elif url.path == "/missing" or self.headers.get("Authorization") != "Bearer t":
            status = 404
        elif url.path == "/link" and at + 3 < 7:
            headers.append(("Link", f'</other>; rel="prev", </link?page={at + 3}>; title="a, b"; rel="Next last"'))
        elif url.path == "/loop":
            headers.append(("Link", "</loop>; rel=next"))
        elif url.path == "/away":
            headers.append(("Link", "<http://example.invalid/x>; rel=next"))
        data = json.dumps(doc).encode()
        self.send_response(status)
        for h in headers:
            self.send_header(*h)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


AUTH = {"auth": {"scheme": "bearer", "token": "t"}, "record_path": "/items"}
SCHEMA = [{"name": "id", "type": "int"}, {"name": "name"}, {"name": "tags"}]


@pytest.mark.parametrize(
    "path,paging",
    [
        ("/off", {"strategy": "offset", "limit": 3}),
        ("/cursor", {"strategy": "cursor_token", "cursor_param": "page", "next_token_pointer": "/meta/next"}),
        ("/link", {"strategy": "link_header"}),
    ],
)
def test_rest_pages(spark, site, path, paging):
    raw = rest.read_rest(spark, [site + path], SCHEMA, pagination=paging, **AUTH)
    good, bad = readers.coerce(raw, SCHEMA)
    assert sorted((r.id, r.name, r.tags) for r in good.collect()) == [(k, f"n{k}", '["x"]') for k in range(7)] and bad.count() == 0


def test_rest_bounds_and_errors(spark, site):
    o = rest._DEFAULTS | AUTH
    assert len(list(rest.records(site + "/link", o | {"pagination": {"strategy": "link_header"}, "max_records": 4}))) == 4
    assert len(list(rest.records(site + "/one", o))) == 3
    for path, why, more in (("/link", "page_limit_reached", {"max_pages": 2}), ("/loop", "itself", {}), ("/away", "another origin", {}), ("/missing", "404", {})):
        with pytest.raises(rest.RestFault, match=why):
            list(rest.records(site + path, o | {"pagination": {"strategy": "link_header"}} | more))
    with pytest.raises(rest.RestFault, match="503"):
        list(rest.records(site + "/fresh", o | {"retries": 0}))
    with pytest.raises(rest.RestFault, match="conflicting"):
        rest.next_link(["<a>; rel=next, <b>; rel=next"])
    with pytest.raises(ValueError, match="no options"):
        rest.read_rest(spark, [site], SCHEMA, pages=1)


def test_sidecar_tells_of_the_output(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    path = writers.write(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), "csv", meta={"pipeline": "p"})
    about = json.loads((tmp_path / "out.meta.json").read_text())
    assert (about["rows"], about["output"], about["pipeline"], about["columns"]) == (5, path, "p", {"id": "bigint"})
    assert about["inputs"] and all("/in/part-" in x for x in about["inputs"])


def test_files_of_groups_by_bytes(spark):
    df = spark.createDataFrame([(g, "x" * 10) for g in "aabbbc"], "g string, v string")  # 27 bytes a row
    cut = lambda **o: {r.g: r._part for r in writers.cut_by_group(df, "g", **o).collect()}
    assert cut(max_bytes=54) == {"a": 0, "b": 1, "c": 2} and cut(max_bytes=55) == {"a": 0, "b": 0, "c": 1}
    assert cut(max_records=2, max_bytes=1000) == {"a": 0, "b": 1, "c": 2}
    assert {r.g: r._oversize for r in writers.cut_by_group(df, "g", 2, oversize_group="warn").collect()} == {"a": False, "b": True, "c": False}
    with pytest.raises(Exception, match="over the limits"):
        writers.cut_by_group(df, "g", 2, oversize_group="error").collect()
    with pytest.raises(ValueError, match="max_records or max_bytes"):
        writers.cut_by_group(df, "g")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("id\n1\n2\n3\n")
    (tmp_path / "p.yaml").write_text(f"""
name: p
vars: {{least: 1}}
nodes:
  - {{name: in, kind: source, format: csv, files: {{path: "{tmp_path}/in.csv"}}, schema: [{{name: id, type: int}}]}}
  - {{name: t, kind: transform, input: in, program: "filter id >= $vars.least"}}
  - {{name: out, kind: sink, input: t, path: "{tmp_path}/out", format: json}}
""")
    assert main(["run", str(tmp_path / "p.yaml"), "--check"], spark) == 0 and not (tmp_path / "out").exists()
    assert main(["run", str(tmp_path / "p.yaml"), "--explain"], spark) == 0 and "== t" in capsys.readouterr().out
    assert main(["run", str(tmp_path / "p.yaml"), "--set", "least=2"], spark) == 0
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == [2, 3]
    capsys.readouterr()
    assert main(["eval", "emit y = a * 2\nemit z = null", "--record", '{"a": 4}'], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"a": 4, "y": 8, "z": None}
    assert main(["eval", "emit y = nothing", "--record", '{"a": 4}'], spark) == 1 and "no field" in capsys.readouterr().err


DLQ = """
on_error: continue
dlq: {path: DIR/dead}
nodes:
  - {name: in, kind: source, format: json, files: {path: DIR/in.json}, on_unmapped: drop, options: {layout: object, record_path: rows, sections: {head: meta.batch}},
     schema: [{name: id, type: int}, {name: n}, {name: k}]}
  - {name: t, kind: transform, input: in, program: "emit v = n.to_int()\\nemit who = $doc.head.by"}
  - {name: ok, kind: validate, input: t, rules: [{name: small, check: "v < 100"}]}
  - {name: per, kind: aggregate, input: ok, group_by: [k], per_document: true, program: "emit total = sum(v)\\nemit by = max(who)"}
  - {name: out, kind: sink, input: per, path: DIR/out, format: json}
"""


def test_dead_letters_of_all_nodes_are_one_output(spark, tmp_path):
    rows = [{"id": "1", "n": "5", "k": "a"}, {"id": "x", "n": "5", "k": "a"}, {"id": "2", "n": "y", "k": "b"}, {"id": "3", "n": "500", "k": "b"}, {"id": "4", "n": "7", "k": "a"}]
    (tmp_path / "in.json").write_text(json.dumps({"meta": {"batch": {"by": "me"}}, "rows": rows}))
    p = Pipeline(spark, load(DLQ.replace("DIR", str(tmp_path))))
    out, dead = p.run()
    assert [(r.k, r.total, r.by) for r in spark.read.json(out).collect()] == [("a", 12, "me")]
    table = spark.read.option("header", True).csv(dead)
    assert table.columns == [*(f"_dlq_{c}" for c in ("id", "timestamp", "source_file", "stage", "trigger", "error_category", "error_detail")), "id", "k", "n", "v", "who"]
    got = sorted((r._dlq_stage, r._dlq_trigger, r._dlq_error_category, r._dlq_error_detail, r.id) for r in table.collect())
    assert got == [("in", None, "type_coercion_failure", "field id", "x"), ("ok", "small", "validation_failure", "rule small", "3"), ("t", None, "type_coercion_failure", "to_int: y", "2")]
    assert all(r._dlq_source_file.endswith("in.json") for r in table.collect()) and table.select("_dlq_id").distinct().count() == 3
    assert column_lineage(p) == {"out": {"k": ["in.k"], "total": ["in.n"], "by": ["in._doc_head"]}}


def test_lineage_of_joins_and_windows(spark):
    a, b = spark.createDataFrame([(1, 2)], "id long, x long"), spark.createDataFrame([(1, 3)], "id long, y long")
    spec = {"nodes": [
        {"name": "a", "kind": "source", "table": "a"}, {"name": "b", "kind": "source", "table": "b"},
        {"name": "c", "kind": "combine", "inputs": {"l": "a", "r": "b"}, "where": "l.id == r.id", "body": "let s = l.x + r.y\nemit id = l.id\nemit s = s * 2\nemit y = r.y"},
        {"name": "t", "kind": "transform", "input": "c", "analytic": {"group_by": ["id"], "sort_by": ["y"]}, "program": "emit first = $window.first().s\nemit all = [y].map(y => y + id)"},
        {"name": "o", "kind": "sink", "input": "t"},
    ]}
    p = Pipeline(spark, spec, {"a": a, "b": b})
    p.build()
    assert column_lineage(p)["o"] == {"id": ["a.id"], "s": ["a.x", "b.y"], "y": ["b.y"], "first": ["a.x", "b.y"], "all": ["a.id", "b.y"]}


RECORDS = {"H": [{"name": "id", "start": 1, "width": 3}], "D": [{"name": "v", "start": 1, "width": 3}], "T": [{"name": "n", "start": 1, "width": 3}]}


def test_multi_record_files_are_checked(spark, tmp_path):
    files = {"good": "H001D1  D2  T002", "miscounts": "H001D1  T002", "headless": "D1  T001", "late": "H001T001D1  ", "unknown": "H001X1  D1  T001", "twice": "H001H001D1  T001"}
    for name, text in files.items():
        (tmp_path / name).write_text("".join(text[k : k + 4] + "\n" for k in range(0, len(text), 4)))
    spec = {"nodes": [{"name": "in", "kind": "source", "format": "multi_record", "files": {"path": str(tmp_path)}, "options": {"start": 0, "width": 1, "records": RECORDS, "header": "H", "trailer": "T", "count": "n"}}]}
    ports = Pipeline(spark, spec).build()
    assert sorted(r.v for r in ports["in.D"].collect()) == ["1", "2"] and ports["in._unknown"].count() == 0
    why = {r._file.rpartition("/")[2]: r._detail for r in ports["in.rejected"].collect()}
    assert why == {
        "miscounts": "the trailer counts 2, there are 1", "headless": "the header is not the one first record", "late": "the trailer is not the one last record",
        "unknown": "a record of unknown type", "twice": "the header is not the one first record",
    }
    assert ports["in.rejected"].count() == 3 + 2 + 3 + 4 + 4


def test_logs_count_rows_as_they_pass(spark, tmp_path, caplog):
    spec = {"nodes": [
        {"name": "in", "kind": "source", "table": "t"},
        {"name": "t", "kind": "transform", "input": "in", "program": "emit y = id * 2", "log": [{"message": "all"}, {"level": "warn", "when": "y > 10", "message": "large"}]},
        {"name": "out", "kind": "sink", "input": "t", "path": str(tmp_path / "out"), "format": "json"},
        {"name": "unused", "kind": "transform", "input": "in", "program": "emit z = 1", "log": [{"message": "never"}]},
    ]}
    caplog.set_level("INFO", logger="tributary")
    Pipeline(spark, spec, {"t": spark.range(10)}).run()
    assert [(r.levelname, r.getMessage()) for r in caplog.records] == [("INFO", "t: all (10 rows)"), ("WARNING", "t: large (4 rows)")]
    caplog.clear()
    # Ports that no sink reads, and rows that the optimizer knows not to exist.
    spec["nodes"][1] |= {"on_error": "continue", "log": [{"message": "all"}]}
    spec["nodes"][2] |= {"input": "t.failed", "path": str(tmp_path / "failed")}
    Pipeline(spark, spec, {"t": spark.range(10)}).run()
    assert not caplog.records
    spec["nodes"][2] |= {"input": "none", "path": str(tmp_path / "none")}
    spec["nodes"].append({"name": "none", "kind": "transform", "input": "t", "program": "filter false"})
    Pipeline(spark, spec, {"t": spark.range(10)}).run()
    assert [r.getMessage() for r in caplog.records] in (["t: all (0 rows)"], ["t: all (10 rows)"])
    with pytest.raises(PlanFault, match="no level"):
        Pipeline(spark, {"nodes": [{"name": "in", "kind": "source", "table": "t", "log": [{"level": "loud"}]}]}, {"t": spark.range(1)}).build()


def test_fixed_width_justify(spark):
    df = spark.createDataFrame([(7, "ab")], "n long, s string")
    line = writers.fixed_width_line(df, [{"name": "n", "type": "int", "width": 4}, {"name": "s", "width": 4, "justify": "right"}, {"name": "n", "type": "int", "width": 3, "justify": "left"}])
    assert df.select(line).first()[0] == "   7  ab7  "


def test_xml_attributes_arrays_and_namespaces(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x"), (2, None, None)], "id long, tags array<string>, one string")
    path = writers.write(df.repartition(1), str(tmp_path / "x"), "xml", root="rs", record="r", attributes=["id"], arrays={"tags": {"repeat_as": "Tag", "wrap_in": "Tags"}, "one": {"repeat_as": "One"}})
    text = "".join("".join(x.read_text().split()) for x in (tmp_path / "x").glob("part-*"))
    assert '<rid="1"><Tags><Tag>a</Tag><Tag>b</Tag></Tags><One>x</One></r><rid="2"/>' in text
    back = readers.read_xml(spark, [path], "rs/r")
    assert sorted((r["@id"], r.One) for r in back.collect()) == [("1", "x"), ("2", None)]
    (tmp_path / "n.xml").write_text('<a xmlns:q="u"><q:r><q:v>1</q:v></q:r></a>')
    assert readers.read_xml(spark, [str(tmp_path / "n.xml")], "q:r", namespaces="qualify").columns[0] == "q:v"


def test_paths_by_source_file_and_null_columns(spark, tmp_path):
    df = spark.createDataFrame([("s3://b/x/one.csv", 1, None), ("s3://b/x/two.csv", 2, "v"), ("s3://b/x/two.csv", 3, None)], "_file string, id long, s string")
    writers.write(df, str(tmp_path / "out" / "{source_file}"), "json")
    lines = lambda d: sorted(x for f in (tmp_path / d).glob("part-*") for x in f.read_text().split())
    assert lines("out/source_file=one") == ['{"id":1}'] and lines("out/source_file=two") == ['{"id":2,"s":"v"}', '{"id":3}']
    writers.write(df.select("s").where("id = 1"), str(tmp_path / "nulls"), "json", preserve_nulls=True)
    assert lines("nulls") == ['{"s":null}']
    with pytest.raises(ValueError, match="fan_out"):
        writers.write(df, str(tmp_path / "z" / "{source_path}"), "json", fan_out=["id"])


def test_maps_with_computed_keys(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v long")
    good, dead = transform_split(df, 'emit m = {k: v, "b": 7}\nemit x = m["a"]')
    assert [(r.k, r.m, r.x) for r in good.collect()] == [("a", {"a": 1, "b": 7}, 1)]
    assert [r.k for r in dead.collect()] == ["b", None]
    with pytest.raises(Exception, match="null or comes twice"):
        transform(df, 'emit m = {k: v, "b": 7}').collect()
