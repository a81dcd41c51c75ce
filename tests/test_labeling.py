import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import labeling, ratelimit, usage
from quillspark.operators.labeling import Agent, LabelConfig, Reply
from quillspark.plans import corpus

SCHEMA = T.StructType([T.StructField("ok", T.BooleanType())])


def _client(word, fail=None):
    """A labeler that looks for a word in its prompt and counts two tokens per call."""

    def make():
        def ask(prompt):
            if fail and fail in prompt:
                raise RuntimeError("down")
            return Reply(json.dumps({"ok": word in prompt}), None, 2, 1)

        return ask

    return make


def _config(**how):
    base = dict(
        schema=SCHEMA, labeler_a=Agent("a", "s", "{code}", client=_client("red")), labeler_b=Agent("b", "s", "{code}", client=_client("round", "BAD")),
        adjudicator=Agent("judge", "s", "{a}{b}{code}", client=_client("tie", "HUNG")), retrieval=False,
    )
    return LabelConfig(**{**base, **how})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "red round"), (2, "red"), (3, "red tie"), (4, "BAD red"), (5, "red HUNG"), (6, "red"), (7, "plain")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_decisions_of_called_labelers(docs):
    got = {r["doc_id"]: (r["final_label"], r["decided_by"]) for r in labeling.label_documents(docs, _config()).collect()}
    yes, no = '{"ok":true}', '{"ok":false}'
    assert got == {
        1: (yes, "agreement"), 2: (no, "adjudicator:judge"), 3: (yes, "adjudicator:judge"), 4: (None, "error"),
        5: (yes, "error_fallback_to_a"), 6: (no, "adjudicator:judge"), 7: (no, "agreement"),
    }


def test_equal_prompts_are_called_once_and_cache_is_used(spark, docs):
    config = _config()
    first = labeling.answer(docs, config.labeler_a, config)
    by_id = {r["doc_id"]: r for r in first.collect()}
    assert not by_id[2]["from_cache"] and by_id[6]["from_cache"] and by_id[6]["input_tokens"] == 0
    row = usage.usage_summary(first).first()
    assert (row["total_calls"], row["cached_calls"], row["input_tokens"], row["cache_hit_rate"]) == (7, 1, 12, "14.3%")
    prompt = "[SYSTEM]\ns\n\n[HUMAN]\nred"
    key = labeling.cache_key(F.lit("default"), F.lit(0.1), F.lit(prompt))
    cache = spark.range(1).select(key.alias("key"), F.lit('{"ok":false}').alias("label_json"), F.lit(None).cast("string").alias("error"),
                                  *[F.lit(9).cast("long").alias(c) for c in usage.COUNTERS])
    again = {r["doc_id"]: r for r in labeling.answer(docs, config.labeler_a, config, cache).collect()}
    assert again[2]["from_cache"] and again[2]["label_json"] == '{"ok":false}' and again[2]["input_tokens"] == 0
    assert len(again) == 7


def test_usage_of_nothing(spark):
    none = spark.createDataFrame([], "input_tokens long, output_tokens long, cached_input_tokens long, cached_output_tokens long, from_cache boolean")
    row = usage.usage_summary(none).first()
    assert row["total_calls"] == 0 and row["cache_hit_rate"] == "0%"


def test_percent_rounds_like_binary_text(spark):
    from quillspark.functions.text import one_decimal

    values = [31.25, 31.75, 0.15, 0.25, 0.35, 99.95, 66.66666666666667, 0.0, 100.0, 12.349999999999999, 1.05, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(one_decimal(F.col("x"))).collect()] == [f"{v:.1f}" for v in values]


def test_validation_hook_and_custom_equality(docs):
    config = _config(validation=lambda label, text: F.when(F.contains(text, F.lit("plain")), F.array(F.lit("made up"))),
                     label_equality=lambda a, b: F.lit(True))
    got = {r["doc_id"]: r for r in labeling.label_documents(docs, config).collect()}
    assert got[7]["hallucination_issues"] == ["made up"] and got[1]["hallucination_issues"] == []
    assert got[2]["decided_by"] == "agreement" and got[4]["decided_by"] == "error"


def test_unit_metadata_keeps_given_values(spark):
    units = spark.createDataFrame([("m", "u1", None)], "unit_type string, unit_id string, source string")
    row = labeling.unit_documents(units, F.lit("body"), metadata=F.create_map(F.lit("unit_id"), F.lit("mine"))).first()
    assert row["metadata"] == {"unit_id": "mine", "unit_type": "m"} and row["index_text"] == "body"


def test_store_grows_by_batches_and_replays(spark, tmp_path):
    store = corpus.Store(str(tmp_path / "store"))
    vectors = lambda rows: spark.createDataFrame(rows, "source string, text string, embedding array<float>")
    config = _config(retrieval=True, examples_k=1, index_fields=("ok",),
                     labeler_a=Agent("a", "s", "{examples}|{code}", client=_client("red")),
                     labeler_b=Agent("b", "s", "{code}", client=_client("red")))
    first = vectors([("x", "red one", [0.0, 0.0]), ("y", "blue", [9.0, 9.0])])
    corpus.label_corpus(first, config, store, fresh=True)
    second = vectors([("z", "near red", [0.1, 0.0])])
    out = corpus.label_corpus(second, config, store, batch=1).first()
    assert out["doc_id"] == 3 and "Example doc_id=1" in out["prompt_a"] and "doc_id=2" not in out["prompt_a"]
    corpus.label_corpus(second, config, store, batch=1)
    assert sorted(r["doc_id"] for r in store.read(spark, "documents").collect()) == [1, 2, 3]
    assert store.read(spark, "labels").count() == 6 and store.next_batch(spark) == 2
    stored = spark.read.parquet(store.path("final_labels"))
    assert {r["doc_id"]: r["ok"] for r in stored.collect()} == {1: "true", 2: "false", 3: "true"}


def test_admission_times(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(61)] + [(61, 100.0)], "id long, at double")
    got = {r["id"]: r["admitted_at"] for r in ratelimit.admission_times(df, 60, "at", "id").collect()}
    assert got[0] == 0 and got[59] == 0 and abs(got[60] - 1.0) < 1e-9 and got[61] == 100.0
    assert {r["admitted_at"] for r in ratelimit.admission_times(df, None, "at", "id").collect()} == {0.0, 100.0}


def test_token_bucket():
    now = [0.0]
    bucket = ratelimit.TokenBucket(60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert all(bucket.try_acquire() for _ in range(60)) and not bucket.try_acquire()
    bucket.acquire()
    assert abs(now[0] - 1.0) < 1e-6
    bucket.reset()
    assert bucket.try_acquire(60)


def test_limit_holds_with_more_tasks_than_slots(spark):
    """28 calls at 24 a minute: the burst covers 24, the other four wait for tokens of their tasks."""
    rows = spark.range(28).select((F.col("id") + 1).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    config = _config(requests_per_minute=24)
    start = time.monotonic()
    assert labeling.answer(rows.repartition(16), config.labeler_a, config).count() == 28
    assert 9 < time.monotonic() - start < 60  # each of four tasks waits ten seconds for one token


def test_second_run_is_answered_by_the_cache(spark, tmp_path):
    store = corpus.Store(str(tmp_path / "store"))
    docs = spark.createDataFrame([("x", "red round"), ("y", "red"), ("z", "BAD red")], "source string, text string")
    own = dict(labeler_a=Agent("a", "first", "{code}", client=_client("red")))  # equal prompts would be one call
    corpus.label_corpus(docs, _config(**own), store, fresh=True)
    first = store.read(spark, "usage")
    assert first.where("NOT from_cache").count() == 7 and store.read(spark, "cache").count() == 6  # a failed call is not kept
    corpus.label_corpus(docs, _config(**own, labeler_b=Agent("b", "s", "{code}", client=_client("round"))), store)
    used = store.read(spark, "usage").where("doc_id > 3")
    # the call that failed, and the adjudicator that its label now needs
    assert used.where("NOT from_cache").count() == 2 and store.read(spark, "cache").count() == 8


def test_promoted_columns_survive_reading_and_fresh_clears_all(spark, tmp_path):
    store = corpus.Store(str(tmp_path / "store"))
    docs = spark.createDataFrame([("x", "red round", [0.0])], "source string, text string, embedding array<float>")
    corpus.label_corpus(docs, _config(retrieval=True, index_fields=("ok",)), store)
    assert store.read(spark, "final_labels").first()["ok"] == "true" and store.read(spark, "index").count() == 1
    corpus.label_corpus(docs.drop("embedding"), _config(), store, fresh=True)
    assert store.read(spark, "index").count() == 0 and store.read(spark, "documents").count() == 1


def test_document_hook(spark, tmp_path):
    builder = lambda files: files.select("source", F.upper("text").alias("text"))
    docs = spark.createDataFrame([("x", "red")], "source string, text string")
    got = corpus.label_corpus(docs, _config(document_builder=builder), corpus.Store(str(tmp_path / "s")), fresh=True).first()
    assert got["text"] == "RED"


def test_a_run_keeps_few_copies_of_the_texts(spark, tmp_path):
    from pathlib import Path

    from quillspark.catalog.labels import called_config
    from quillspark.session import _tables_folder

    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f" {i}")), 512) for i in range(40)])
    docs = spark.range(300).select(F.lit("s").alias("source"), text.alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    stored = lambda where: sum(p.stat().st_size for p in Path(where).rglob("*.parquet"))
    tables = _tables_folder(spark)
    before = stored(tables)
    out = corpus.label_corpus(spark.read.parquet(str(tmp_path / "docs")), called_config(), corpus.Store(str(tmp_path / "store")), fresh=True)
    assert stored(tables) - before < 2 * stored(tmp_path / "docs")
    row = out.where("decided_by = 'agreement'").first()
    assert row["prompt_a"].endswith("CODE:" + row["text"]) and row["prompt_adjudicator"] == ""
