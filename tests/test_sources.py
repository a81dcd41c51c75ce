import json

import pytest
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.operators import alter
from quillspark.sources import files, schemas


def test_lenient_strict_and_replacing_decodes(spark):
    raw = [b"plain", b"ok\xe2\x82A\xffz\xc3\xa9", "fine � é".encode(), b"\xf0\x9f\x98"]
    df = spark.createDataFrame([(bytearray(r),) for r in raw], "content binary")
    c = F.col("content")
    got = df.select(files.decode_ignoring(c).alias("i"), files.decode_replacing(c).alias("r"), files.decode_strict(c).alias("s")).collect()
    assert [r["i"] for r in got] == [b.decode("utf-8", "ignore") for b in raw]
    assert [r["r"] for r in got] == [b.decode("utf-8", "replace") for b in raw]
    assert [r["s"] for r in got] == ["plain", None, "fine � é", None]


def test_scans_folders_and_single_files(spark, tmp_path):
    for name, text in (("p1/a.py", "x = 1"), ("p1/deep/b.py", "y"), ("p2/c.PY", "z"), ("p2/d.txt", "t")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "p2/bad.py").write_bytes(b"\xff")
    rows = {(r["project"], r["qualified_name"]): r["text"] for r in files.python_sources(spark, str(tmp_path)).collect()}
    assert rows == {("p1", "a.py"): "x = 1", ("p1", "deep/b.py"): "y", ("p2", "bad.py"): None}
    named = files.python_sources(spark, str(tmp_path / "p1"), "mine").select("project", "qualified_name", "file_path").collect()
    assert {(r["project"], r["qualified_name"]) for r in named} == {("mine", "a.py"), ("mine", "deep/b.py")}
    assert {r["file_path"] for r in named} == {str(tmp_path / "p1/a.py"), str(tmp_path / "p1/deep/b.py")}
    assert files.text_files(spark, str(tmp_path / "p2/c.PY"), ".py").first()["text"] == "z"
    assert files.text_files(spark, str(tmp_path), ".py").count() == 3


def test_safe_reads(spark):
    units = spark.createDataFrame([(1, "/a"), (2, "/gone"), (3, ""), (4, None)], "id long, file_path string")
    content = spark.createDataFrame([("/a", bytearray(b"t\xff"))], "path string, content binary")
    got = {r["id"]: r["content"] for r in files.read_safely(units, content).collect()}
    assert got == {1: "t�", 2: "[File not found: /gone]", 3: "[No file path provided]", 4: "[No file path provided]"}


def test_report_units(spark, tmp_path):
    report = {"summary": "s", "projects": [
        {"project_name": "p", "test_modules": [{"file_path": "/x"}, {"file_path": "/y", "is_test_module": False}]},
        {"test_modules": [{"file_path": "/z", "is_test_module": True}]},
    ]}
    path = tmp_path / "report.json"
    path.write_text(json.dumps(report, indent=2))
    got = {(r["source"], r["unit_id"]) for r in files.report_units(spark, str(path)).collect()}
    assert got == {("/x", '{"project_name":"p","file_path":"/x"}'), ("/z", '{"project_name":"unknown","file_path":"/z"}')}


def _label_files(tmp_path):
    body = {"x.py": {"doc_id": 7, "code": "c", "decided_by": "agreement", "final_label": {"f": "none", "n": 1}}, "y.py": 3,
            'q"z': {"final_label": "text"}, "w": {"doc_id": "9"}}
    for name, text in (("p/a.json", json.dumps(body)), ("p/list.json", "[1]"), ("q/bad.json", "{oops"), ("q/b.json", json.dumps({"k": {"final_label": {"f": "yes"}}}))):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return body


def test_label_files_are_read_altered_and_written_elsewhere(spark, tmp_path):
    body = _label_files(tmp_path / "in")
    originals = files.label_files(spark, str(tmp_path / "in"))
    entries = files.label_entries(originals)
    assert entries.count() == 5 and entries.where("final_label IS NULL").count() == 2
    assert {r["project"] for r in entries.collect()} == {"p", "q"}
    marked = alter.mark_entries(entries, [("f", "none"), ("n", 5)])
    new = marked.where("matches").select("path", "item", F.lit('{"f":"fresh"}').alias("new_label"))
    altered = alter.alter(marked, new)
    assert alter.alteration_counts(altered).first().asDict() == {
        "total_items": 5, "filtered_items": 1, "relabeled_items": 1, "failed_items": 0, "skipped_items": 2}
    root = "file:" + str(tmp_path / "in")
    assert sinks.rewrite_label_files(originals, alter.altered_files(altered), root, "file://" + str(tmp_path / "out")) == 2
    assert json.loads((tmp_path / "out/p/a.json.bak").read_text()) == body
    written = json.loads((tmp_path / "out/p/a.json").read_text())
    assert written["x.py"] == {"doc_id": 7, "code": "c", "decided_by": "label_alterer", "final_label": {"f": "fresh"}, "relabeled": True}
    assert {k: written[k] for k in ("y.py", 'q"z', "w")} == {k: body[k] for k in ("y.py", 'q"z', "w")}
    assert not (tmp_path / "out/q").exists()


def test_failed_relabeling_is_counted(spark, tmp_path):
    _label_files(tmp_path)
    marked = alter.mark_entries(files.label_entries(files.label_files(spark, str(tmp_path))), [("f", "yes")])
    altered = alter.alter(marked, spark.createDataFrame([], "path string, item string, new_label string"))
    assert alter.alteration_counts(altered).first()["failed_items"] == 1
    assert [r["item"] for r in alter.alteration_errors(altered).collect()] == ["k"]


def test_ranking_text(spark):
    lines = ["Project Statistics", "Total Projects: 2", "", "#     Project Name     Tests", "-----", "1     fast thing      154   ",
             "2     b               1   ", "----", "TOTAL                 155"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    assert sorted(tuple(r) for r in files.ranking_rows(df).collect()) == [(1, "fast thing", 154), (2, "b", 1)]


def test_stored_patterns_set_broken_lines_aside(spark, tmp_path):
    path = tmp_path / "patterns.json"
    path.write_text('{"pattern_id":"p1","pattern_name":"n","usage_count":2}\n{broken\n')
    good, bad = files.pattern_rows(spark, str(path))
    assert [r["pattern_id"] for r in good.collect()] == ["p1"] and bad.count() == 1
    assert files.stored_or_empty(spark, str(tmp_path / "none"), schemas.VECTORS).count() == 0


def test_results_document(spark):
    rows = spark.createDataFrame([("p", "b", 2), ("p", 'a"', 1)], "project string, item string, doc_id long")
    assert json.loads(sinks.results_document(rows).first()["body"]) == {'a"': {"doc_id": 1}, "b": {"doc_id": 2}}


def test_name_aliases(spark):
    from quillspark.functions.text import list_items, name_aliases

    df = spark.createDataFrame([("a.b.C",), ("m::f",), ("x",), (" ",), ("f:g:h",)], "n string")
    assert [r[0] for r in df.select(name_aliases(F.col("n"))).collect()] == [
        ["C", "a.b.C", "b.C"], ["f", "m.f", "m::f"], ["x"], [], ["f:g:h", "g.h", "h"]]
    df = spark.createDataFrame([("tools=[a, b(c)[0],,]",), ("[]",), ("x",), ("]a[",)], "n string")
    assert [r[0] for r in df.select(list_items(F.col("n"))).collect()] == [["a", "b(c)[0]"], [], [], []]


def test_label_files_of_any_size_and_unreadable_ones(spark):
    rows = [("/o/p/bad.json", '{"a": 1,}'), ("/o/p/list.json", "[1]"), ("/o/p/none.json", None), ("/o/p/empty.json", "{}")]
    members = files.label_members(spark.createDataFrame(rows, "path string, body string"))
    assert {r["path"] for r in files.unread_files(members).collect()} == {"/o/p/bad.json", "/o/p/list.json", "/o/p/none.json"}
    # more than one parsed value may hold
    large = spark.range(1).select(F.lit("/o/p/big.json").alias("path"), F.concat(
        F.lit('{"a": {"final_label": {"f": 1}}, "pad": "'), F.repeat(F.lit("x"), 140 << 20),
        F.lit('", "b": {"final_label": {"f": "1"}}, "a": {"final_label": {"f": 2}}}')).alias("body"))
    got = {r["item"]: r["final_label"] for r in files.label_entries(large).select("item", "final_label").collect()}
    assert got == {"a": '{"f":2}', "pad": None, "b": '{"f":"1"}'}


def test_folders_named_like_files(spark, tmp_path):
    (tmp_path / "pkg.py" / "in").mkdir(parents=True)
    (tmp_path / "pkg.py" / "in" / "m.py").write_text("x = 1\n")
    assert files.binary_files(spark, str(tmp_path / "pkg.py"), ".py").count() == 1
    assert files.binary_files(spark, str(tmp_path / "pkg.py" / "in" / "m.py"), ".py").count() == 1
    assert files.binary_files(spark, str(tmp_path / "pkg.py" / "in" / "m.py"), ".json").count() == 0


def test_only_a_missing_store_is_empty(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        files.stored_or_empty(spark, str(tmp_path / "broken"), schemas.VECTORS).count()
