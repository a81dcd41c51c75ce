"""Label files in both layouts, cut into many splits."""

import json
import random

import pytest

from quillspark import sinks
from quillspark.sources import files
from quillspark.sources.label_files import label_pieces, stored_label_members


def _read(spark, root):
    rows = stored_label_members(spark, str(root)).collect()
    return ({(r["path"].rsplit("/", 1)[1], r["item"]): json.loads(r["value"]) for r in rows if r["item"] is not None},
            {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows if r["item"] is None})


def _value(rng, deep=3):
    texts = ['a,b', 'q"', "back\\", '{"', "]}", "\n}\n{", "é,ü", "", ",,", '\\",']
    kind = rng.randrange(7 if deep else 4)
    if kind < 2:
        return rng.choice(texts) * rng.randrange(1, 4)
    if kind < 4:
        return rng.choice([None, True, 1, -2.5, 10**20])
    if kind == 4:
        return [_value(rng, deep - 1) for _ in range(rng.randrange(4))]
    return {f"{rng.choice(texts)}{i}": _value(rng, deep - 1) for i in range(rng.randrange(4))}


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in kept:
        spark.conf.set(key, "700")
    yield
    for key, value in kept.items():
        spark.conf.set(key, value)


def test_one_object_of_items_is_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(3)
    want = {}
    for n, style in enumerate(({}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")})):
        body = {f'item "{i}", [': {"final_label": _value(rng), "x": _value(rng)} for i in range(60)} | {"stray": n}
        (tmp_path / f"o{n} é.json").write_text(json.dumps(body, **style), encoding="utf-8")
        want |= {(f"o{n} é.json", k): v for k, v in body.items()}
    assert label_pieces(spark, str(tmp_path)).select("path", "block").distinct().count() > 12
    got, bad = _read(spark, tmp_path)
    assert not bad and got == want


def test_one_object_a_line(spark, tmp_path, small_splits):
    rng = random.Random(4)
    objects = [{f"k{i}": {"v": _value(rng)}, f"m{i}": {"v": i}} for i in range(40)] + [{}, {"k0": {"v": "last"}}]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(o) for o in objects) + "\n")
    want = {("lines.json", k): v for o in objects for k, v in o.items()}
    rows = [{"item": f'r"{i}', "x": _value(rng)} for i in range(40)]
    (tmp_path / "rows.json").write_text("\r\n\n".join(json.dumps(r) for r in rows))
    want |= {("rows.json", r["item"]): r for r in rows}
    got, bad = _read(spark, tmp_path)
    assert not bad and got == want


def test_unreadable_files_give_one_row(spark, tmp_path):
    broken = ['{"a": 1,}', "[1]", "  ", "{oops", '{"a": 1} x', '{"a": 1}{"b": 2}', '{"a": 1}, {"b": 2}', '{"a": [1}}', '{"a": "x}', '{"a": }', '{"a": 1 2}',
              '{"a": 1}}', '{,"a": 1}', '{"a": 1}\n[2]', '"a"', '{"a": {"b": 1}\n{"c": 2}}', '{1: 2}']
    for i, text in enumerate(broken):
        (tmp_path / f"{i}.json").write_text(text)
    for name, text in (("empty", " {} "), ("nothing", '{"a": null}'), ("twice", '{"a": 1, "b": 2, "a": 3}')):
        (tmp_path / f"{name}.json").write_text(text)
    got, bad = _read(spark, tmp_path)
    assert set(bad) == {f"{i}.json" for i in range(len(broken))}
    assert got == {("nothing.json", "a"): None, ("twice.json", "a"): 3, ("twice.json", "b"): 2}


def test_rows_that_labeling_writes_are_entries(spark, tmp_path):
    rows = spark.createDataFrame([("x.py", '{"f":"yes"}'), ("y, z", "none"), ("w", None)], "item string, final_label string")
    sinks.result_rows(rows.repartition(2), str(tmp_path / "out"))
    entries = files.entries_of(stored_label_members(spark, str(tmp_path / "out")))
    assert {r["item"]: r["final_label"] for r in entries.collect()} == {"x.py": '{"f":"yes"}', "y, z": None, "w": "{}"}
