import duckdb

from quillspark.plans import corpus
from quillspark.streaming import incremental
from test_labeling import _config


def test_labels_documents_as_they_arrive(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red round"), ("b", "red"), ("c", "plain")], "source string, text string").repartition(1)
    for name in "abc":
        docs.where(f"source = '{name}'").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    store = corpus.Store(str(tmp_path / "store"))
    before = spark.createDataFrame([("old", f"red {i}") for i in range(5)], "source string, text string")
    corpus.label_corpus(before, _config(), store)
    query = incremental.label_stream(stream, _config(), store, str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(120)
    assert query.exception() is None
    labels = {r["doc_id"] for r in store.read(spark, "final_labels").collect()}
    assert labels == set(range(1, 9)) and store.next_batch(spark) == 1  # nothing that was stored is lost
    stored = store.read(spark, "documents")
    assert stored.count() == 8 and stored.select("doc_id").distinct().count() == 8


def _plain(batches, keep=0.8):
    """One example after the other, by batch and inside a batch by ``at``."""
    state = {}
    for batch in batches:
        for key, _, score in sorted(batch, key=lambda r: r[1]):
            old, used = state.get(key, (score, 0))
            state[key] = (old if used == 0 else keep * old + (1 - keep) * score, used + 1)
    return state


def _check(spark, state, batches):
    got = {r["pattern_id"]: (r["confidence_score"], r["usage_count"]) for r in state.read(spark).collect()}
    want = _plain(batches)
    assert got.keys() == want.keys()
    for key, (score, used) in want.items():
        assert got[key][1] == used and abs(got[key][0] - score) < 1e-9


def test_pattern_state_over_batches(spark, tmp_path):
    """A hot pattern, patterns that come and stay away, a batch replayed, late examples, and composing on the way."""
    state = incremental.PatternState(str(tmp_path / "state"))
    assert state.read(spark).count() == 0
    state.compact(spark)
    batches = [
        [("hot" if i % 3 else f"p{i % 7}", 1000 * b + i, (i * 37 + b * 11) % 100 / 100) for i in range(60 if b != 2 else 0)] for b in range(6)
    ]
    batches[4] = [(k, at - 3900, score) for k, at, score in batches[4]]  # late: counts where it arrives
    schema = "pattern_id string, at long, confidence_score double"
    for number, batch in enumerate(batches):
        state.add(spark.createDataFrame(batch, schema), number, ["at"])
        if number == 3:
            state.add(spark.createDataFrame(batch, schema), number, ["at"])  # as after a failure
            state.compact(spark)
        _check(spark, state, batches[: number + 1])
    assert spark.read.parquet(f"{state.path}/batches/batch=0").where("pattern_id = 'hot'").count() == 1
    (tmp_path / "state/batches/batch=6").mkdir()  # cut off before it was written: not there yet
    state.compact(spark)
    state.compact(spark)
    _check(spark, state, batches)


def test_confidence_stream(spark, tmp_path):
    schema = "pattern_id string, at long, confidence_score double"
    batches = [[(f"p{i % 3}", 100 * b + i, (i + b) % 10 / 10) for i in range(20)] for b in range(3)]
    state = incremental.PatternState(str(tmp_path / "state"))
    for batch in batches[:2], batches[2:]:
        for rows in batch:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = incremental.confidence_stream(stream, state, str(tmp_path / "cp"), ["at"], compact_every=2, availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None
    _check(spark, state, batches)
    assert (tmp_path / "state/composed/upto=1/_SUCCESS").exists()


def test_streamed_query_on_events_in_many_files(spark, tmp_path):
    """Files that overlap in time: each third of the events is one batch, in however many files it comes."""
    from __spark_entry__ import oracle_sql, queries
    from compare import differences

    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    events.repartition(6, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{source}/events.parquet')")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # every file is a task, as files are at size
    try:
        assert differences(con, oracle_sql()["streamed_confidence"], queries()["streamed_confidence"](spark, str(tmp_path))) == []
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
