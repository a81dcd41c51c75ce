import json
import re
import sys

from pyspark import cloudpickle

from quillspark.plans import extraction
from quillspark.sources import files

# Workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _pattern(name, indices, confidence=0.5, category="c"):
    return {"pattern_name": name, "pattern_description": "d", "pattern_category": category, "confidence_score": confidence,
            "distinguishing_features": ["f"], "code_indicators": [], "example_indices": indices}


def _miner():
    def ask(prompt):
        n = prompt.count("--- Example ")
        return [_pattern("mock agent", [1, n, n + 1], 0.5), _pattern(f"only {n} here now", [2], 2.0 if n == 5 else 0.4)], f"saw {n}"

    return ask


def _consolidator():
    return lambda prompt: ([_pattern("all", [1, 2, 99])], f"{prompt.count('--- Pattern ')}")


def _entries(spark, n=45):
    body = {f"t{i:03d}.py": {"doc_id": i, "code": "x" * 600, "final_label": {"f": "none", "why": "because"}} for i in range(n)}
    return files.label_entries(spark.createDataFrame([("/o/proj/a.json", json.dumps(body))], "path string, body string"))


def test_chunks_map_back_to_examples(spark):
    out = extraction.extract_patterns(_entries(spark), "f", "none", "why", _miner, max_examples=45, chunk_size=20)
    rows = {r["pattern_name"]: r for r in out.patterns.collect()}
    # The out-of-range confidence of the last chunk is refused; equal names merge.
    assert set(rows) == {"mock agent", "only 20 here now"} and out.total_examples == 45
    assert rows["mock agent"]["members"] == 3 and rows["mock agent"]["example_count"] == 6
    refs = {r["file_path"] for r in out.references.where(f"seed = {rows['mock agent']['seed']}").collect()}
    assert refs == {"t000.py", "t019.py", "t020.py", "t039.py", "t040.py", "t044.py"}
    assert "Processed 45 examples in 3 chunks" in out.summary and "Chunk 3: saw 5" in out.summary


def test_limit_and_nothing_found(spark):
    out = extraction.extract_patterns(_entries(spark), "f", "none", "why", _miner, max_examples=10)
    assert out.total_examples == 10
    none = extraction.extract_patterns(_entries(spark), "f", "other", "why", _miner)
    assert none.total_examples == 0 and none.patterns.count() == 0


def _many():
    return lambda prompt: ([_pattern(f"{w} thing", [i + 1], category=w) for i, w in enumerate("abcde")], "s")


def test_consolidation_merges_references(spark):
    out = extraction.extract_patterns(_entries(spark, 10), "f", "none", "why", _many, _consolidator)
    row = out.patterns.first()
    assert row["pattern_name"] == "all" and row["example_count"] == 2
    assert {r["file_path"] for r in out.references.collect()} == {"t000.py", "t001.py"}


def _numbered():
    return lambda prompt: ([{**_pattern(f"case {re.search('File: t([0-9]+)', prompt)[1]}", [1, 2]), "code_indicators": []}], "s")


def _halves():
    def ask(prompt):
        n = prompt.count("--- Pattern ")
        return [_pattern(f"odd {prompt[:60]}", list(range(1, n + 1, 2))), _pattern(f"even {prompt[:60]}", list(range(2, n + 1, 2)))], "s"

    return ask


def test_consolidation_by_levels_keeps_all_references(spark):
    out = extraction.extract_patterns(
        _entries(spark, 60), "f", "none", "why", _numbered, _halves, max_examples=None, chunk_size=3, prompt_patterns=4)
    assert out.merged == 20 and out.patterns.count() == 2  # 20, 10, 6, 4, 2
    assert sum(r["example_count"] for r in out.patterns.collect()) == 40
    assert sorted(r["file_path"] for r in out.references.collect()) == sorted(f"t{i:03d}.py" for i in range(60) if i % 3 < 2)


def test_consolidation_that_does_not_shrink_ends(spark):
    same = lambda: lambda prompt: ([_pattern(f"kept {i}", [i + 1]) for i in range(prompt.count("--- Pattern "))], "s")
    out = extraction.extract_patterns(
        _entries(spark, 18), "f", "none", "why", _numbered, same, max_examples=None, chunk_size=3, prompt_patterns=4)
    assert out.patterns.count() == 6 and out.references.count() == 12
