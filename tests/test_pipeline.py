import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import aggregate, combine, rows
from tributary.plans.pipeline import Pipeline, PlanFault, load, ordered, overlay
from tributary.sources import readers, writers

SPEC = """
name: orders
vars: {least: 10}
functions: {double: {params: [x], body: "x * 2"}}
nodes:
  - {name: in, kind: source, format: csv, files: {glob: "DIR/*.csv"}, on_unmapped: drop,
     schema: [{name: id, type: int}, {name: kind}, {name: price, type: decimal, scale: 2}, {name: day, type: date, nullable: true}]}
  - {name: t, kind: transform, input: in, program: "filter id >= $vars.least\\nemit twice = double(id)"}
  - {name: r, kind: route, input: t, conditions: {a: "kind == \\"a\\""}}
  - {name: sums, kind: aggregate, input: r.a, group_by: [kind], program: "emit total = sum(price)\\nemit n = count(*)"}
  - {name: out, kind: sink, input: sums, path: DIR/out, format: json}
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "x.csv").write_text('id,kind,price,day,extra\n10,a,1.005,2024-01-02,z\n11,"a",2.5,,\n12,b,1,2024-01-01,\nx,a,1,,\n1,a,9,,\n13,a, 7,,\n')
    return tmp_path


def test_yaml_pipeline(spark, files):
    p = Pipeline(spark, load(SPEC.replace("DIR", str(files))))
    (out,) = p.run()
    (row,) = spark.read.json(out).collect()
    assert (row.kind, row.total, row.n) == ("a", "3.50", 2)
    bad = p.ports["in.rejected"].collect()
    assert sorted((r.id, r._error) for r in bad) == [("13", "price"), ("x", "id")]
    assert "extra" not in p.ports["t"].columns and p.ports["t"].columns[-1] == "twice"


def test_plans_are_checked(spark):
    with pytest.raises(PlanFault, match="cycle"):
        ordered({"nodes": [{"name": "a", "kind": "transform", "input": "b"}, {"name": "b", "kind": "transform", "input": "a"}]})
    with pytest.raises(PlanFault, match="no node"):
        ordered({"nodes": [{"name": "a", "kind": "transform", "input": "z"}]})
    with pytest.raises(PlanFault, match="two nodes"):
        ordered({"nodes": [{"name": "a", "kind": "source"}, {"name": "a", "kind": "source"}]})
    spec = overlay({"vars": {"x": 1}, "nodes": [{"name": "a", "kind": "source", "limit": 1}]}, {"vars": {"x": 2}, "nodes": {"a": {"limit": 5}, "b": {"kind": "sink", "input": "a"}}})
    assert spec["vars"]["x"] == 2 and spec["nodes"][0]["limit"] == 5 and spec["nodes"][1]["name"] == "b"


def test_composition_and_envelope(spark):
    df = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 5)], "doc string, v long")
    inner = {"nodes": [{"name": "i", "kind": "source", "table": "x"}, {"name": "t", "kind": "transform", "input": "i", "program": "emit v = v + 1"}, {"name": "o", "kind": "sink", "input": "t"}]}
    spec = {"nodes": [{"name": "s", "kind": "source", "table": "t"}, {"name": "c", "kind": "composition", "inputs": {"x": "s"}, "pipeline": inner}, {"name": "e", "kind": "envelope", "input": "c", "grain": ["doc"], "footer": {"total": "sum(v)"}}]}
    ports = Pipeline(spark, spec, {"t": df}).build()
    assert sorted(tuple(r) for r in ports["e.footer"].collect()) == [("d1", 5), ("d2", 6)]


def test_formats_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (22, "")], "id long, name string")
    schema = [{"name": "id", "type": "int", "start": 0, "width": 4}, {"name": "name", "start": 4, "width": 6}]
    path = writers.write(df, str(tmp_path / "f"), "fixed_width", schema=schema)
    raw = readers.read_fixed_width(spark, [path], schema).withColumn("id", F.trim("id"))
    assert sorted((r.id, r.name) for r in readers.coerce(raw, schema)[0].collect()) == [(1, "a b"), (22, "")]
    path = writers.write(df, str(tmp_path / "x"), "xml")
    assert {r.id for r in readers.read_xml(spark, [path], "record").collect()} == {"1", "22"}
    with pytest.raises(Exception, match="wide"):
        writers.write(df.withColumn("name", F.lit("too long a name")), str(tmp_path / "g"), "fixed_width", schema=schema)
    path = writers.write(df, str(tmp_path / "s"), "csv", mapping={"id": "key"}, sort_order=[{"field": "id", "order": "desc"}])
    assert spark.read.csv(path, header=True).columns == ["key", "name"]


def test_segment_files(spark, tmp_path):
    assert readers.segments("UNB+UNOA:1+S'LIN+1++it?'s ?+ok:EN'UNZ+1'", "edifact") == [("UNB", ["UNOA:1", "S"]), ("LIN", ["1", "", "it's +ok:EN"]), ("UNZ", ["1"])]
    assert readers.segments("MSH|^~\\&|A\rPID|1|x^y\n", "hl7") == [("MSH", ["^~\\&", "A"]), ("PID", ["1", "x^y"])]
    assert readers.segments("{1:F01}{4:\n:20:REF\n:59:A\nB\n-}", "swift") == [("20", ["REF"]), ("59", ["A", "B"])]
    (tmp_path / "a.edi").write_text("UNB+S'LIN+1'LIN+2'")
    df = readers.read_segments(spark, [str(tmp_path / "a.edi")], "edifact")
    got = readers.sections(df, ["UNB"], "head").orderBy("position").collect()
    assert [(r.tag, r.elements, r.head) for r in got] == [("LIN", ["1"], ["S"]), ("LIN", ["2"], ["S"])]


def test_matchers_and_multi_record(spark, tmp_path):
    for n in ("b.txt", "a.txt", "c.log"):
        (tmp_path / n).write_text("H001\nD002x\nT003\n")
    name = lambda ps: [p.rpartition("/")[2] for p in ps]
    assert name(readers.find_files(spark, {"glob": f"{tmp_path}/*.txt"})) == ["a.txt", "b.txt"]
    assert name(readers.find_files(spark, {"regex": rf"{tmp_path}/[ac]\..*", "take_last": 1})) == ["c.log"]
    assert name(readers.find_files(spark, {"path": str(tmp_path), "exclude": ["*.log"], "take_first": 1})) == ["a.txt"]
    with pytest.raises(FileNotFoundError):
        readers.find_files(spark, {"glob": f"{tmp_path}/*.none"})
    out = readers.read_multi_record(spark, [f"{tmp_path}/a.txt"], 0, 1, {"H": [{"name": "n", "start": 1, "width": 3}], "D": [{"name": "n", "start": 1, "width": 3}]})
    assert [r.n for r in out["D"].collect()] == ["002"] and [r.value for r in out["_unknown"].collect()] == ["T003"]


def test_null_rules_of_joins_windows_and_groups(spark):
    a = spark.createDataFrame([(1, None), (2, "k")], "id long, k string")
    b = spark.createDataFrame([(None, 7), ("k", 8), ("k", 9)], "k string, v long").withColumn("_ord", F.col("v"))
    got = combine.combine({"a": a, "b": b}, "a.k == b.k", "emit id = a.id\nemit v = b.v")
    assert sorted((r.id, r.v or 0) for r in got.collect()) == [(1, 0), (2, 8)]
    assert combine.combine({"a": a, "b": b}, "a.k == b.k", "filter b.v > 8\nemit id = a.id", on_miss="skip").count() == 0
    with pytest.raises(Exception, match="no match"):
        combine.combine({"a": a, "b": b}, "a.k == b.k", "emit id = a.id\nemit v = b.v", on_miss="error").collect()
    with pytest.raises(Exception, match="more than 1"):
        combine.combine({"a": a, "b": b}, "a.k == b.k", "emit v = b.v", match="all", on_miss="skip", max_output_rows=1).collect()
    assert rows.transform(a, "emit n = $window.count()", analytic={"group_by": ["k"]}).count() == 1
    kept, gone = rows.cull(a, ["k"], ["count(*) > 0"])
    assert (kept.count(), gone.count()) == (0, 2)
    assert aggregate.aggregate(a.where("false"), [], "emit n = count(*)").first().n == 0


def test_reshape_conflict_drops_the_group(spark):
    df = spark.createDataFrame([("g", 1), ("g", 5), ("h", 1)], "k string, v long")
    rules = [{"name": "a", "when": "v > 3", "mutate": {"v": "0"}}, {"name": "b", "when": "v > 4", "mutate": {"v": "9"}}]
    assert [(r.k, r.v) for r in rows.reshape(df, ["k"], rules).collect()] == [("h", 1)]


def test_file_cuts_and_values(spark):
    df = spark.createDataFrame([(g, i) for g in "abcd" for i in range(3)], "g string, i long")
    assert {r.g: r._part for r in writers.cut_by_group(df, "g", 6).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    held = spark.createDataFrame([(["a", "b"],), ([r"a\;b"],)], "v array<string>")
    assert sorted(r.v for r in rows.join_values(held, "v", on_conflict="escape").collect()) == ["a;b", r"a\\\;b"]
    with pytest.raises(Exception, match="holds"):
        rows.join_values(held, "v").collect()


def test_joined_values_escape_the_delimiter_and_the_backslash(spark):
    held = spark.createDataFrame([(["a", "b"],), (["a;b", "c"],), (["d\\e"],)], "v array<string>")
    assert sorted(r.v for r in rows.join_values(held, "v", on_conflict="escape").collect()) == ["a;b", "a\\;b;c", "d\\\\e"]
    assert sorted(r.v for r in rows.join_values(held, "v", on_conflict="encode_json").collect()) == ['["a","b"]', '["a;b","c"]', '["d\\\\e"]']


def test_streaming_windows(spark, tmp_path):
    import datetime as d

    from tributary.streaming.windows import stream_window

    t0 = d.datetime(2024, 1, 1)
    spark.createDataFrame([(t0 + d.timedelta(minutes=10 * k), "u") for k in range(13)] + [(t0 + d.timedelta(days=1), "u")], "ts timestamp_ntz, k string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("ts timestamp_ntz, k string").parquet(str(tmp_path / "in"))
    q = stream_window(src, "ts", {"tumbling": "1h"}, ["k"], [F.count("*").alias("n")]).writeStream.outputMode("append").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("tumbled").collect()) == [1, 6, 6]


def test_collect_has_no_bound_unless_asked(spark):
    a, b = spark.createDataFrame([(1,)], "id long"), spark.range(10_500).selectExpr("1L AS id", "id AS v")
    body = "emit id = a.id\nemit n = b.length()"
    (got,) = combine.combine({"a": a, "b": b}, "a.id == b.id", body, match="collect").collect()
    assert (got.id, got.n) == (1, 10_500)
    with pytest.raises(Exception, match="over 10000 matches"):
        combine.combine({"a": a, "b": b}, "a.id == b.id", body, match="collect", max_collected=10_000).collect()


@pytest.mark.parametrize("mode,values", [("escape", "escape"), ("encode_json", "json")])
def test_joined_values_split_back(spark, mode, values):
    cells = [["a", "b"], ["a;b", ""], ["d\\e", "\\", ";"], ["\n;x", "é"], ["x"]]
    held = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, v array<string>")
    back = rows.join_values(held, "v", on_conflict=mode).select("k", readers.split_values(F.col("v"), ";", values).alias("v"))
    assert {r.k: r.v for r in back.collect()} == dict(enumerate(cells))


def test_correlated_dead_letters_leave_null_keys_alone(spark):
    df = spark.createDataFrame([(None, 1), (None, 9), ("k", 9), ("k", 1), ("j", 1)], "k string, v long")
    good, dead = rows.dead_letter(df, F.col("v") > 5, ["k"])
    assert sorted((r.k or "", r.v) for r in good.collect()) == [("", 1), ("j", 1)]
    assert sorted((r.k or "", r.v) for r in dead.collect()) == [("", 9), ("k", 1), ("k", 9)]


def test_reshape_rejects_are_a_port(spark):
    df = spark.createDataFrame([("g", 1), ("g", 5), ("h", 1), (None, 5), ("", 2)], "k string, v long")
    rules = [{"name": "a", "when": "v > 3", "mutate": {"v": "0"}}, {"name": "b", "when": "v > 4", "mutate": {"v": "9"}}]
    out, rejected = rows.reshape_split(df, ["k"], rules)
    assert [r.k for r in out.collect()] == ["h"]
    assert sorted((r.k or "", r.v) for r in rejected.collect()) == [("", 2), ("", 5), ("g", 1), ("g", 5)]


def test_group_files_close_once_they_are_full(spark):
    df = spark.createDataFrame([(g, i) for g in "abc" for i in range(4)], "g string, i long")
    assert {r.g: r._part for r in writers.cut_by_group(df, "g", 6).collect()} == {"a": 0, "b": 0, "c": 1}


def test_json_keeps_folders_beside_decimals(spark, tmp_path):
    df = spark.sql("SELECT id % 3 AS k, cast(id / 7 AS decimal(10,3)) AS d FROM range(9)")
    path = writers.write(df, str(tmp_path / "j"), "json", fan_out=["k"], max_records=1)
    assert len(list((tmp_path / "j").glob("k=*"))) == 3 and len(list((tmp_path / "j").glob("k=*/part-*"))) == 9
    assert spark.read.json(path).schema["d"].dataType.simpleString() == "string"
    with pytest.raises(ValueError, match="array"):
        writers.write(df, str(tmp_path / "a"), "json", layout="array", fan_out=["k"])


def test_sources_in_order(spark):
    df = spark.createDataFrame([("f", 0, 2), ("f", 1, 1), ("g", 2, 0)], "_file string, _ord long, v long")
    assert [r.v for r in readers.in_order(df, ["v"], "_ord").collect()] == [1, 2, 0]
    with pytest.raises(Exception, match="not in order"):
        readers.in_order(df, ["v"], "_ord", "error").collect()
    assert readers.in_order(df.where("_ord <> 1"), ["v"], "_ord", "error").count() == 2


PREDICATES = {
    "a.k == b.k": lambda p, q: p[1] is not None and p[1] == q[1],
    "a.k == b.k and b.lo > 5": lambda p, q: p[1] is not None and p[1] == q[1] and q[2] > 5,
    "a.k == b.k and a.x > b.lo": lambda p, q: p[1] is not None and p[1] == q[1] and p[2] is not None and p[2] > q[2],
    "a.x >= b.lo and a.x < b.hi": lambda p, q: p[2] is not None and q[2] <= p[2] < q[3],
    "b.lo > a.x and b.lo < a.x + a.w": lambda p, q: p[2] is not None and p[2] < q[2] < p[2] + p[3],
    "a.x < b.hi and a.w > b.lo": lambda p, q: p[2] is not None and p[2] < q[3] and p[3] > q[2],
    "a.x < b.lo": lambda p, q: p[2] is not None and p[2] < q[2],
}


@pytest.mark.parametrize("text", PREDICATES)
def test_joins_match_brute_force_without_broadcasts(spark, text):
    """A shuffled driver with repeated rows and null keys, every match mode, and no plan that forms all pairs."""
    r = random.Random(2)
    a = [(i, r.choice([None, *range(6)]), r.choice([None, *[k / 2 for k in range(40)]]), r.uniform(0, 8)) for i in range(40)]
    a += [*a[:5], (99, None, None, 1.0)]
    b = [(i, r.choice([None, *range(6)]), lo, lo + r.choice([0.1, 1, 5, 30])) for i, lo in ((i, r.uniform(0, 20)) for i in range(25))]
    left = spark.createDataFrame(a, "id long, k long, x double, w double").repartition(4)
    right = spark.createDataFrame(b, "id long, k long, lo double, hi double").repartition(3).withColumn("_ord", F.col("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for match in ("first", "all", "collect"):
            body = "emit id = a.id\nemit m = " + ('b.map(v => v.id).join(",")' if match == "collect" else "b.id")
            found = [(p[0], [q[0] for q in b if PREDICATES[text](p, q)]) for p in a]
            for miss in ("null_fields", "skip"):
                df = combine.combine({"a": left, "b": right}, text, body, match=match, on_miss=miss)
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "Cartesian" not in plan and "NestedLoop" not in plan
                none = "" if match == "collect" else "None"
                shown = {"first": lambda m: [str(m[0])], "all": lambda m: map(str, m), "collect": lambda m: [",".join(map(str, m))]}[match]
                want = [(i, x) for i, m in found for x in (shown(m) if m else [none] if miss != "skip" else [])]
                assert sorted((x.id, str(x.m)) for x in df.collect()) == sorted(want), (match, miss)
            with pytest.raises(Exception, match="no match in b"):
                combine.combine({"a": left, "b": right}, text, "emit id = a.id", match=match, on_miss="error").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_faults_of_programs(spark, monkeypatch):
    df = spark.createDataFrame([("1", 2, ["1", "2"]), ("x", 3, ["4"]), ("5", 0, ["q", "7"]), (None, 1, None), ("8", 0, [])], "a string, b long, l array<string>")

    def split(program):
        good, dead = rows.transform_split(df, program)
        return [tuple(r)[3:] for r in good.collect()], sorted((r.a, r._error, r._error_field) for r in dead.collect())

    assert split("emit n = a.to_int()\nfilter b > 0\nemit q = 6 / b") == ([(1, 3), (None, 6)], [("x", "type_coercion_failure", "n")])
    # What a branch that isn't taken could do is no fault.
    assert split("emit n = if b == 3 then 0 else a.to_int()") == ([(1,), (0,), (5,), (None,), (8,)], [])
    assert split('emit n = match a { "x" => 0, _ => a.to_int() }')[1] == [] and split('emit n = a == null or a != "x" and a.to_int() > 0')[1] == []
    assert split("emit n = b ?? a.to_int()")[1] == []
    assert split("emit m = l.map(x => x.to_int()).join('+')") == ([("1+2",), ("4",), (None,), ("",)], [("5", "type_coercion_failure", "m")])
    assert split("emit each x in l { emit v = x.to_int() }") == ([(1,), (2,), (4,)], [("5", "type_coercion_failure", "x")])
    assert split("emit each x in l outer { emit v = x.to_int() }")[0] == [(1,), (2,), (4,), (None,), (None,)]
    good, dead = split("emit q = 6 / b\ndistinct by b")
    assert sorted(good) == [(2,), (3,), (6,)] and [d[0] for d in dead] == ["5", "8"]
    monkeypatch.setattr(rows, "MAX_EXPANSION", 1)
    assert split("emit each x in l { emit v = x }") == ([("4",)], [("1", "expansion_limit_exceeded", "x"), ("5", "expansion_limit_exceeded", "x")])
    with pytest.raises(TypeError, match="needs an array"):
        rows.transform_split(df, "emit each x in b { emit v = x }")


def test_modules_are_checked(spark):
    def made(modules):
        return Pipeline(spark, {"modules": modules, "nodes": []})

    with pytest.raises(PlanFault, match="recursion"):
        made({"m": {"functions": {"f": {"params": ["x"], "body": "g(x)"}, "g": {"params": ["x"], "body": "f(x)"}}}})
    with pytest.raises(PlanFault, match="by itself"):
        made({"m": {"use": {"n": "n"}, "lets": {"a": "n.b"}}, "n": {"use": {"m": "m"}, "lets": {"b": "m.a"}}})
