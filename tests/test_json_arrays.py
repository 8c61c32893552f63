"""JSON arrays: files that stay small, and numbers read as the text that they are, each byte once."""

import os

from tributary.sources import readers, writers


def test_arrays_are_cut_into_files_and_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "ARRAY_BYTES", 2000)
    df = spark.range(500).selectExpr("id", "concat('é\\n[,', id) AS t").coalesce(1)
    path = writers.write(df, str(tmp_path / "a"), "json", layout="array")
    files = readers.find_files(spark, {"glob": f"{path}/part-*"})
    assert len(files) > 5 and all(os.path.getsize(f.removeprefix("file:")) <= 2010 for f in files)
    back = readers.read_json(spark, files, ["id", "t"], layout="array", declared_only=True)
    assert sorted((int(r.id), r.t) for r in back.collect()) == [(i, f"é\n[,{i}") for i in range(500)]
    none = writers.write(df.where("id < 0"), str(tmp_path / "b"), "json", layout="array")
    assert readers.read_json(spark, readers.find_files(spark, {"glob": f"{none}/part-*"}), ["id", "t"], layout="array", declared_only=True).count() == 0


def test_numbers_of_arrays_and_objects_keep_their_text(spark, tmp_path):
    rows = '[{"a": 1.10,\n "b": {"c": 1e5}}\n,\n{"a": 12345678901234567890.123456789, "b": {"c": -0.0}}]\n'
    want = [("1.10", "1e5"), ("12345678901234567890.123456789", "-0.0")]
    for layout, text, code in (("array", rows, "utf-8"), ("array", rows, "utf-8-sig"), ("object", f'{{"data":\n {{"rows": {rows}}}}}', "utf-8")):
        path = tmp_path / f"{layout}-{code}.json"
        path.write_bytes(text.encode(code))
        df = readers.read_json(spark, [str(path)], ["a", "b"], layout=layout, record_path="data.rows" if layout == "object" else None)
        assert sorted((r.a, r.b.c) for r in df.collect()) == want, (layout, code)


def test_a_file_is_read_once(spark, tmp_path):
    """The reader does not go back for numbers that are read as text."""
    path = tmp_path / "a.json"
    path.write_text("[" + "\n,".join(f'{{"a": {i}, "b": "{i}"}}' for i in range(20_000)) + "]")
    df = readers.read_json(spark, [str(path)], ["a", "b"], layout="array", declared_only=True)
    read = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    total = lambda: sum(x.getBytesRead() for x in read.getAllStatistics().toArray())
    before = total()
    assert len(df.collect()) == 20_000
    assert total() - before < 4 * path.stat().st_size
