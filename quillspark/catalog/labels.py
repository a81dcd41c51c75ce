"""Labeling, agreement, retrieval and pattern queries over the given tables."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import labels as L
from quillspark.functions import text as X
from quillspark.functions.prompts import chat_prompt, examples_block as example_text
from quillspark.operators import agreement, alter, labeling, neighbors, ordered, patterns, quality, ratelimit, store, usage
from quillspark import sinks
from quillspark.plans import corpus, extraction
from quillspark.session import checkpoint_root, materialize, new_folder
from quillspark.sources import files
from quillspark.sources.label_files import stored_label_members
from quillspark.streaming import incremental


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _at(seconds):
    return F.timestamp_seconds(F.lit(1704067200) + seconds)


def _pick(options, index):
    return F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))


def _micros(ts):
    """Microseconds since the epoch of a timestamp without time zone, whatever the session's zone."""
    gap = F.col(ts).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole = (F.extract(F.lit("DAY"), gap) * 24 + F.extract(F.lit("HOUR"), gap)) * 60 + F.extract(F.lit("MINUTE"), gap)
    return (whole.cast("bigint") * 60000000 + (F.extract(F.lit("SECOND"), gap) * 1000000).cast("bigint")).cast("bigint")


# Agreement ------------------------------------------------------------------------------------------


def kappa_overall(spark, sf):
    out = agreement.kappa(table(spark, sf, "labels"), "quality", "toxic")
    return out.select("n", F.round("kappa", 9).alias("kappa"))


def kappa_by_lang(spark, sf):
    rated = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return agreement.kappa(rated, "quality", "toxic", ["lang"]).select("lang", "n", F.round("kappa", 9).alias("kappa"))


def rolling_kappa_w50(spark, sf):
    rated = table(spark, sf, "labels").select("doc_id", F.lit("label").alias("field"), F.col("quality").alias("a"), F.col("toxic").alias("b"))
    out = agreement.rolling_kappa(rated, 50, order=["doc_id"])
    return out.select("doc_id", "field", F.col("n").cast("bigint").alias("n"), F.round("kappa", 9).alias("kappa"))


def _review(seed):
    """Label JSON of one reviewer; documents in one language lack a confidence."""
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    conf = F.when(F.col("lang") != "es", F.concat(F.lit(',"confidence_score":'), ((seed % 100) / 100).cast("string"))).otherwise("")
    return F.concat(
        F.lit('{"is_integration_test":'), flag(seed % 3 != 0), F.lit(',"is_self_contained":'), flag(seed % 2 == 0),
        F.lit(',"is_test_executed_against_deployed_services":'), flag(seed % 5 != 0), F.lit(',"detail":{"fit":"'),
        F.when(seed % 7 < 5, "yes").otherwise("no"), F.lit('"}'), conf, F.lit("}"),
    )


def _reviews(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", _at(F.col("doc_id")).alias("created_at"), _review(F.col("n_chars")).alias("a_label_json"),
        _review(F.col("n_chars") + F.col("doc_id") % 4).alias("b_label_json"),
    )


def rolling_kappa_multi_field(spark, sf):
    out = agreement.rolling_kappa_for_fields(_reviews(spark, sf), ["detail.fit", "confidence_score"], window=30)
    return out.select("doc_id", F.unix_seconds("created_at").alias("at"), "field", F.col("n").cast("bigint").alias("n"),
                      F.round("kappa", 9).alias("kappa"))


def combination_filter(spark, sf):
    return _reviews(spark, sf).where(L.matches_combination("a_label_json") & L.matches_combination("b_label_json")).select("doc_id")


# Store ----------------------------------------------------------------------------------------------


def _label_rows(spark, sf):
    rated = table(spark, sf, "labels")
    one = lambda agent, value, when: F.struct(
        F.lit(agent).alias("agent_id"), F.concat(F.lit('{"value":'), F.col(value).cast("string"), F.lit("}")).alias("label_json"),
        _at(when).alias("created_at"))
    both = F.array(one("a", "quality", F.col("doc_id")), one("b", "toxic", F.col("doc_id") * 7 % 1000))
    return rated.select("doc_id", F.explode(both).alias("r")).select("doc_id", "r.*")


def pairwise_labels(spark, sf):
    out = store.pairwise_labels(_label_rows(spark, sf), "a", "b")
    return out.select("doc_id", F.unix_seconds("created_at").alias("at"), "a_label_json", "b_label_json")


def upsert_latest_label(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("agent_id"), F.col("props").alias("label_json"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    stored = F.col("seq") % 3 != 0  # the others arrive later and may be older or newer
    return store.upsert_labels(rows.where(stored), rows.where(~stored)).select("doc_id", "agent_id", "label_json", "seq")


def upsert_final_label(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("decided_by"), F.col("props").alias("label_json"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    stored = F.col("seq") % 3 != 0
    return store.upsert_final_labels(rows.where(stored), rows.where(~stored)).select("doc_id", "decided_by", "label_json", "seq")


def promoted_fields(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("props").alias("label_json"))
    return store.with_index_fields(rows, ["k", "missing"]).select("event_id", "k", "missing")


def assigned_ids(spark, sf):
    """Ids of appended documents: consecutive after the largest id present, copies kept."""
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("line"))
    return store.assign_ids(docs, ["source", "line"], after=1000).select("source", "line", "doc_id")


def confidence_bucket(spark, sf):
    shown = F.when(F.col("l_returnflag") == "N", F.lit("n/a")).otherwise((F.col("l_quantity") / 50).cast("string"))
    bucketed = table(spark, sf, "lineitem").select(L.bucket_confidence(shown).alias("bucket"))
    return bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))


def unlabeled_docs(spark, sf):
    return store.unlabeled(table(spark, sf, "documents"), table(spark, sf, "labels")).select("doc_id")


def _final_labels(spark, sf):
    return table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == F.col("toxic"), "agreement").otherwise("adjudicator:adjudicator_1").alias("decided_by"),
        F.concat(F.lit('{"quality":'), F.col("quality").cast("string"), F.lit("}")).alias("label_json"),
        _at(F.col("doc_id") * 13 % 997).alias("created_at"))


def fetch_examples(spark, sf):
    wanted = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    out = store.examples_for(wanted, table(spark, sf, "documents"), _final_labels(spark, sf))
    return out.select("doc_id", "source", "decided_by", "label_json", F.unix_seconds("labeled_at").alias("labeled_at"), F.md5("text").alias("text_md5"))


# Labeling -------------------------------------------------------------------------------------------

LABEL = T.StructType([T.StructField("is_good", T.BooleanType())])


def _flag(test):
    return F.concat(F.lit('{"is_good":'), F.when(test, "true").otherwise("false"), F.lit("}"))


def rule_config() -> labeling.LabelConfig:
    """Deterministic labelers: length, word count, and word variety as the adjudicator."""
    tokens = lambda: X.words(F.col("text"))
    variety = lambda: F.try_divide(F.size(F.array_distinct(tokens())), F.size(tokens()))
    agent = labeling.Agent
    return labeling.LabelConfig(
        schema=LABEL,
        labeler_a=agent("labeler_a", "You are {agent_id}. {patterns}", "{examples}\n{code}", rule=lambda: _flag(F.col("n_chars") >= 400)),
        labeler_b=agent("labeler_b", "You are {agent_id}. {patterns}", "{examples}\n{code}", rule=lambda: _flag(F.size(tokens()) >= 100)),
        adjudicator=agent("adjudicator_1", "You are {agent_id}.", "{a}{b}\n{code}", rule=lambda: _flag(variety() >= 0.85)),
        patterns="good or not", retrieval=False,
    )


def _caller(test):
    """A client that reads the text after the last line mark of its prompt, at two tokens a call."""

    def make():
        def ask(prompt: str) -> labeling.Reply:
            good = test(prompt.rsplit("CODE:", 1)[-1])
            return labeling.Reply(json.dumps({"is_good": good}, separators=(",", ":")), None, len(prompt), 2)

        return ask

    return make


def called_config() -> labeling.LabelConfig:
    """The labelers of ``rule_config`` as clients that are called: by length, and an adjudicator by parity."""
    agent = labeling.Agent
    return labeling.LabelConfig(
        schema=LABEL,
        labeler_a=agent("labeler_a", "a", "CODE:{code}", client=_caller(lambda text: len(text) >= 400)),
        labeler_b=agent("labeler_b", "b", "CODE:{code}", client=_caller(lambda text: len(text) >= 1000)),
        adjudicator=agent("adjudicator_1", "j", "{a}{b}CODE:{code}", client=_caller(lambda text: len(text) % 2 == 0)),
        retrieval=False,
    )


def label_documents(spark, sf):
    out = labeling.label_documents(table(spark, sf, "documents"), rule_config())
    return out.select("doc_id", "lang", "source", "label_a", "label_b", "final_label", "decided_by")


def agreement_summary(spark, sf):
    out = labeling.label_documents(table(spark, sf, "documents"), rule_config())
    return labeling.decision_summary(out, "lang").select("lang", "decided_by", "documents", "percent")


def flag_summary(spark, sf):
    out = labeling.label_documents(table(spark, sf, "documents"), rule_config())
    return labeling.flag_summary(out, L.json_path("final_label", "is_good") == "true")


def decided_by_errors(spark, sf):
    """Decisions when a labeler fails (one language) and when the adjudicator fails (another)."""
    docs = table(spark, sf, "documents")
    text = _flag(F.col("n_chars") >= 400)
    other = _flag(F.col("n_chars") % 2 == 0)
    both = docs.select("doc_id", text.alias("label_a"), other.alias("label_b"),
                       F.when(F.col("lang") == "es", "timeout").alias("error"))
    judged = docs.select("doc_id", F.lit("p").alias("prompt"), F.when(F.col("lang") != "fr", _flag(F.col("doc_id") % 3 == 0)).alias("label_json"),
                         F.when(F.col("lang") == "fr", "timeout").alias("error"))
    return labeling.decide(both, judged, rule_config()).select("doc_id", "final_label", "decided_by")


def prompt_render(spark, sf):
    docs = table(spark, sf, "documents")
    config = rule_config()
    return docs.select("doc_id", F.md5(labeling.prompts(docs, config.labeler_a, config)).alias("prompt_md5"),
                       X.content_hash(F.col("text")).alias("content_hash"))


def snippets(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.snippet(text)).alias("snippet_md5"), F.md5(X.code_snippet(text)).alias("code_md5"),
        F.length(X.short_reference(text)).cast("bigint").alias("reference_length"))


def cache_lookup(spark, sf):
    """Calls answered by a cache filled from one language, and distinct prompts still to call."""
    docs = table(spark, sf, "documents")
    key = labeling.cache_key(F.lit("default"), F.lit("0.1"), F.col("text"))
    requests = docs.select("doc_id", "lang", "source", key.alias("key"))
    cache = requests.where("lang = 'en'").select("key").distinct()
    hits, misses = labeling.split_cached(requests, cache)
    count = F.count(F.lit(1))
    a = hits.groupBy("source").agg(count.alias("hits"))
    b = misses.groupBy("source").agg(F.count_distinct("key").alias("to_call"))
    return a.join(b, "source", "full").select("source", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("to_call", F.lit(0)).alias("to_call"))


def _calls(spark, sf):
    n = F.length("text").cast("bigint")
    own = F.col("role") == "user"
    return table(spark, sf, "conversations").select(
        "role", F.when(own, n).otherwise(0).alias("input_tokens"), F.when(own, 0).otherwise(n).alias("output_tokens"),
        (n % 7).alias("cached_input_tokens"), F.lit(0).cast("bigint").alias("cached_output_tokens"), (F.col("turn") % 3 == 1).alias("from_cache"))


def token_usage_summary(spark, sf):
    return usage.usage_summary(_calls(spark, sf))


def token_usage_by_role(spark, sf):
    return usage.usage_summary(_calls(spark, sf), ["role"])


def report_units(spark, sf):
    """Units of one report per document; a missing test-module flag keeps the module."""
    flag = F.when(F.col("doc_id") % 3 == 0, False).when(F.col("doc_id") % 3 == 1, True)
    module = F.struct(
        F.lit("m").alias("module_path"), F.concat(F.lit("/repo/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
        flag.alias("is_test_module"))
    project = F.struct(F.when(F.col("lang") != "en", F.col("source")).alias("project_name"), F.array(module).alias("test_modules"))
    report = table(spark, sf, "documents").select(F.array(project).alias("projects"))
    units = files.units_of_report(report)
    built = labeling.unit_documents(units, F.col("file_path"), metadata=F.create_map(F.lit("source"), F.col("project_name")))
    return built.select("unit_type", "unit_id", "source", F.col("metadata")["source"].alias("meta_source"),
                        F.col("metadata")["unit_type"].alias("meta_type"))


def rate_limit_admission(spark, sf):
    events = table(spark, sf, "events").select("event_id", (_micros("ts") / 1e6).alias("at"))
    out = ratelimit.admission_times(events, 1, "at", "event_id")
    return out.select("event_id", F.round("admitted_at", 3).alias("admitted_at"))


def rate_limit_by_user(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", (_micros("ts") / 1e8).alias("at"))
    out = ratelimit.admission_times(events, 2, "at", "event_id", ["user_id"])
    return out.select("event_id", "user_id", F.round("admitted_at", 3).alias("admitted_at"))


def worker_assignment(spark, sf):
    docs = ordered.with_position(table(spark, sf, "documents").select("doc_id"), [], ["doc_id"])
    return docs.select("doc_id", ((F.col("position") - 1) % 4).alias("worker"))


# Retrieval ------------------------------------------------------------------------------------------


def _near(spark, sf, k=5, **how):
    index = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return neighbors.nearest(index, index, k, "vec_id", "vec_id", **how)


def _ranked(df):
    return df.select("vec_id", "neighbor_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


def knn_top5(spark, sf):
    return _ranked(_near(spark, sf))


def knn_oversampled(spark, sf):
    """Oversample by five with the query itself in the index, then drop it and repeats."""
    return _ranked(neighbors.first_distinct(_near(spark, sf, 8, exclude_self=False), "vec_id", 3))


def knn_earlier(spark, sf):
    return _ranked(_near(spark, sf, 3, earlier_only=True))


def knn_repeated_ids(spark, sf):
    """Four index rows share each id; a query has no row of its own id."""
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("id"), F.col("vec_id"), "embedding")
    out = neighbors.nearest(rows.where("vec_id % 4 = 0"), rows, 5, "id", "id")
    return out.select("id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance"))


def knn_missing_vector(spark, sf):
    """Rows without a vector are found by nobody, and find nothing."""
    vector = lambda n: F.when(F.col("vec_id") % n != 0, F.col("embedding")).alias("embedding")
    rows = table(spark, sf, "embeddings")
    out = neighbors.nearest(rows.select("vec_id", vector(7)), rows.select("vec_id", vector(5)), 3, "vec_id", "vec_id")
    return _ranked(out)


def knn_two_batches(spark, sf):
    """Three nearest rows of every vector: in an index of the even ids, and after the odd ones were added to it."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    index = neighbors.CellIndex(spark, new_folder(spark))
    asked = []
    for batch in (0, 1):
        index.add(rows.where(F.col("vec_id") % 2 == batch), "vec_id", batch=batch)
        asked.append(_ranked(materialize(index.nearest(rows, 3, "vec_id"))).withColumn("batch", F.lit(batch)))
    return asked[0].unionByName(asked[1])


def knn_confident(spark, sf):
    scored = neighbors.with_score(_near(spark, sf, metric="l2"), 0.5)
    best = neighbors.best_matches(scored, "vec_id")
    return best.select("vec_id", "neighbor_id", F.round("score", 6).alias("score"), "is_confident", "has_confident_matches")


def knn_label_vote(spark, sf):
    """Most frequent label among the five nearest vectors, the smaller label on ties."""
    label = table(spark, sf, "embeddings").select(F.col("vec_id").alias("neighbor_id"), "label")
    votes = _near(spark, sf).join(label, "neighbor_id").groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("label", "n"), F.struct(F.col("n"), -F.col("label"))).alias("b")
    return votes.groupBy("vec_id").agg(best).select("vec_id", F.col("b.label").cast("bigint").alias("label"), F.col("b.n").alias("votes"))


def examples_block(spark, sf):
    """Prompt block of each vector's labeled neighbours, most recently labeled first."""
    near = _near(spark, sf)
    shown = table(spark, sf, "documents").withColumn("text", F.substring("text", 1, 1000))  # cut before the join
    found = store.examples_for(near.select(F.col("neighbor_id").alias("doc_id")), shown, _final_labels(spark, sf))
    rows = near.select("vec_id", F.col("neighbor_id").alias("doc_id")).join(found, "doc_id", "left")
    hit = F.col("label_json").isNotNull()
    entry = F.struct((-F.unix_seconds("labeled_at")).alias("age"), "doc_id", "text", "label_json")
    listed = rows.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.when(hit, entry))).alias("examples"))
    block = example_text(F.col("examples"))
    prompt = chat_prompt("s", "{examples}", {"examples": block})
    return listed.select("vec_id", F.size("examples").cast("bigint").alias("examples"), F.md5(prompt).alias("prompt_md5"))


# Patterns -------------------------------------------------------------------------------------------


def normalized_names(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.normalize_name(F.col("text"))).alias("name_md5"))


def similar_names(spark, sf):
    sets = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), X.word_set(F.col("p_name")).alias("tokens"))
    return patterns.similar_sets(sets, 0.3).select("item_a", "item_b", F.round("similarity", 6).alias("similarity"))


def same_names(spark, sf):
    """The parts that ``similar_names`` takes as one: those with the same words, by their smallest key."""
    sets = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), X.word_set(F.col("p_name")).alias("tokens"))
    return patterns.same_sets(sets).select("item", "first_item")


def word_similarity(spark, sf):
    """Jaccard and overlap of every document's words with its benchmark item's words."""
    bench = table(spark, sf, "benchmark")
    n_items = bench.agg(F.count(F.lit(1))).scalar()
    items = bench.select(F.col("item_id"), X.word_set(F.col("text")).alias("b"))
    docs = table(spark, sf, "documents").select("doc_id", F.pmod("doc_id", n_items).alias("item_id"), X.word_set(F.col("text")).alias("a"))
    both = docs.join(items, "item_id")
    return both.select("doc_id", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(X.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


def _cases(spark, sf):
    """Pattern candidates of parts: a two- to three-word name, a description and a confidence."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 4 == 0, F.lower("p_type"))).alias("pattern_name"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"), F.col("p_partkey").alias("doc_id"),
        (F.col("p_size") / 50).alias("confidence_score"))


def pattern_groups(spark, sf):
    return patterns.group_similar(_cases(spark, sf))


def created_patterns(spark, sf):
    out = patterns.create_patterns(_cases(spark, sf))
    return out.select("pattern_seq", "pattern_name", F.round("confidence_score", 6).alias("confidence_score"), "usage_count", "example_count")


def stored_patterns(spark, sf):
    """Created patterns, stored and loaded again."""
    made = patterns.create_patterns(_cases(spark, sf)).withColumn("pattern_id", F.concat(F.lit("p"), "pattern_seq"))
    path = f"{checkpoint_root(spark)}/patterns/{uuid.uuid4().hex}"
    sinks.save_patterns(made, path)
    good, _ = files.pattern_rows(spark, path)
    return good.select("pattern_seq", "pattern_id", "pattern_name", F.round("confidence_score", 6).alias("confidence_score"), "usage_count", "example_count")


def _found(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("pattern"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("pattern_name"), F.col("p_type").alias("pattern_description"),
        F.col("p_brand").alias("pattern_category"), (size / 50).alias("confidence_score"), F.array("p_type").alias("distinguishing_features"),
        F.array((size % 5).cast("string"), (size % 7).cast("string"), F.lower("p_type")).alias("code_indicators"))


def merged_patterns(spark, sf):
    found = _found(spark, sf)
    refs = found.select("pattern", F.col("pattern_name").alias("file_path"), F.col("pattern").cast("string").alias("doc_id"),
                        F.col("pattern_category").alias("project"))
    out, _ = patterns.merge_similar(found, refs)
    return out.select("seed", "pattern_name", "pattern_category", F.round("confidence_score", 6).alias("confidence_score"), "members", "example_count",
                      F.array_join("code_indicators", ",").alias("code_indicators"))


def pattern_statistics(spark, sf):
    vectors = table(spark, sf, "embeddings")
    per = vectors.groupBy("label").agg(
        F.count(F.lit(1)).alias("example_count"), F.avg(F.col("vec_id") % 100 / 100).alias("confidence_score"),
        F.max("vec_id").alias("usage_count"))
    out = patterns.statistics(per)
    return out.select("total_patterns", "total_examples", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("avg_usage", 6).alias("avg_usage"))


def pattern_confidence(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("pattern_id"), "ts", "event_id", F.col("value").alias("confidence_score"))
    out = patterns.evolve(rows, ["ts", "event_id"])
    return out.select("pattern_id", F.round("confidence_score", 6).alias("confidence_score"), "usage_count")


def streamed_confidence(spark, sf):
    """The same from a stream: events come in three parts by time, and the state is composed once on the way."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("pattern_id"), "ts", "event_id", F.col("value").alias("confidence_score"))
    root = new_folder(spark)
    low, high = events.select(F.percentile_approx(_micros("ts"), [0.33, 0.67]).alias("at")).first()["at"] or (0, 0)
    parted = materialize(events.withColumn("third", F.when(_micros("ts") > high, 2).when(_micros("ts") > low, 1).otherwise(0)), "third")
    state = incremental.PatternState(f"{root}/state")
    for number in range(3):  # a part is one batch, in however many files it is
        parted.where(F.col("third") == number).drop("third").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        query = incremental.confidence_stream(stream, state, f"{root}/checkpoint", ["ts", "event_id"], compact_every=2, availableNow=True)
        query.awaitTermination()
    return state.read(spark).select("pattern_id", F.round("confidence_score", 6).alias("confidence_score"), "usage_count")


def chunk_assign(spark, sf):
    return ordered.chunked(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 20)


def _chunk_patterns(spark, sf):
    """One extracted pattern per chunk citing a few examples, two of them out of range."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("project"), F.col("lang").alias("source"))
    chunks = ordered.chunked(docs, ["doc_id"], 20)
    found = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("chunk").alias("pattern"), "chunk", F.array(F.lit(1), (F.col("chunk") % 20 + 1).cast("int"), F.lit(0), F.lit(25)).alias("example_indices"))
    return found, chunks


def example_references(spark, sf):
    found, chunks = _chunk_patterns(spark, sf)
    return patterns.resolve_examples(found, chunks).select("pattern", F.col("ref").cast("bigint").alias("ref"), "file_path", "doc_id", "project")


def consolidated_references(spark, sf):
    found, chunks = _chunk_patterns(spark, sf)
    refs = patterns.resolve_examples(found, chunks).withColumnRenamed("pattern", "seed")
    # one prompt holds all inputs; the last index cited is out of its range at any size
    inputs = ordered.with_position(found.select(F.col("pattern").alias("seed"), F.lit(0).cast("bigint").alias("chunk")), [], ["seed"], "index_in_chunk")
    merged = inputs.select(F.floor(F.col("seed") / 3).alias("pattern"), "chunk", F.array("index_in_chunk", F.lit(1).cast("bigint"), F.lit(1 << 40)).alias("example_indices"))
    out = patterns.resolve_consolidated(merged, inputs, refs)
    return out.select("pattern", "file_path", "doc_id", "project")


# Labeled output files -------------------------------------------------------------------------------


def _label_files(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        F.concat(F.lit("/out/"), "source", F.lit("/"), text("doc_id"), F.lit(".json")).alias("path"),
        F.concat(F.lit('{"doc":{"doc_id":'), text("doc_id"), F.lit(',"code":"lang '), "lang", F.lit('","decided_by":"agreement","final_label":{"quality":'),
                 text("quality"), F.lit(',"toxic":'), text("toxic"), F.lit('}},"note":3}')).alias("body"))


def _altered(spark, sf):
    marked = alter.mark_entries(files.label_entries(_label_files(spark, sf)), [("toxic", 1), ("quality", 0)])
    code = alter.entry_content(F.col("entry"))
    new = marked.where("matches").select("path", "item", F.when(code != "lang fr", F.lit('{"quality":1,"toxic":0}')).alias("new_label"))
    return alter.alter(marked, new)


def typed_conditions(spark, sf):
    """Which of four spellings of a value the number, the text and the null condition meet."""
    value = _pick(('1', '"1"', 'true', '1.0', 'null', '"null"', '[1]'), F.col("doc_id") % 8)
    label = F.concat(F.lit("{"), F.when(value.isNotNull(), F.concat(F.lit('"v":'), value)).otherwise(F.lit('"w":1')), F.lit("}"))
    rows = table(spark, sf, "documents").select("doc_id", label.alias("label"))
    meets = lambda want: L.meets_any("label", [("v", want)])
    return rows.select("doc_id", meets(1).alias("number"), meets("1").alias("text"), meets(None).alias("absent"), meets(True).alias("flag"))


def label_corpus_twice(spark, sf):
    """The documents labeled into a store by called labelers, then once more: the second run is all from the cache."""
    store_of = corpus.Store(f"{checkpoint_root(spark)}/stores/{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents").select("source", "text")
    corpus.label_corpus(docs, called_config(), store_of, created_at=_at(F.lit(0)), fresh=True)
    again = corpus.label_corpus(docs, called_config(), store_of, created_at=_at(F.lit(60)))
    rows = again.groupBy("source", "decided_by").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.crc32("final_label")).alias("labels"))
    return rows.select("source", "decided_by", "documents", "labels")


def label_corpus_usage(spark, sf):
    """Token usage of both runs by agent: the second makes no call."""
    store_of = corpus.Store(f"{checkpoint_root(spark)}/stores/{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents").select("source", "text")
    corpus.label_corpus(docs, called_config(), store_of, created_at=_at(F.lit(0)), fresh=True)
    corpus.label_corpus(docs, called_config(), store_of, created_at=_at(F.lit(60)))
    out = usage.usage_summary(store_of.read(spark, "usage"), ["agent_id"])
    return out.select("agent_id", "input_tokens", "output_tokens", "total_calls", "cached_calls")


def alteration_counts(spark, sf):
    return alter.alteration_counts(_altered(spark, sf))


def altered_entries(spark, sf):
    return _altered(spark, sf).select("path", "project", "item", "status", "final_label", "decided_by", "relabeled")


def alteration_errors(spark, sf):
    return alter.alteration_errors(_altered(spark, sf))


def field_value_examples(spark, sf):
    out = alter.field_examples(files.label_entries(_label_files(spark, sf)), "toxic", "1", "why", 10)
    return out.select("source", "project", "doc_id", "code", "reasoning", "path")


def label_file_entries(spark, sf):
    """Labels written as result rows, one a line, and as one object of items a language and line, and read back by both layouts."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    label = F.to_json(F.struct("quality", "toxic"))
    item = F.concat(F.lit('doc "'), F.col("doc_id").cast("string"), F.lit('", {\\'))
    root = new_folder(spark)
    sinks.result_rows(rows.select(item.alias("item"), "doc_id", label.alias("final_label")), f"{root}/rows")
    record = F.to_json(F.struct("doc_id", F.struct("quality", "toxic").alias("final_label"), F.lit("a, [b").alias("code")))
    member = F.concat(F.regexp_replace(F.to_json(F.array(item)), r"^\[|\]$", ""), F.lit(":"), record)
    bodies = rows.groupBy("lang", F.pmod("doc_id", F.lit(50)).alias("part")).agg(F.collect_list(member).alias("m"))
    body = F.concat(F.lit("{"), F.array_join("m", ","), F.lit("}"))
    bodies.select(body.alias("value")).write.text(f"{root}/objects.json")
    # Spark's text files end in .txt
    entries = files.entries_of(stored_label_members(spark, f"{root}/rows")).select(F.lit("rows").alias("layout"), "*").unionByName(
        files.entries_of(stored_label_members(spark, f"{root}/objects.json", ".txt")).select(F.lit("objects").alias("layout"), "*"))
    return entries.groupBy("layout", "item", "final_label").agg(F.count(F.lit(1)).alias("files"))


def _counting_miner():
    """A miner by rule: one pattern a chunk, named by how many examples its prompt shows, citing all of them."""

    def ask(prompt: str):
        n = prompt.count("--- Example ")
        pattern = {
            "pattern_name": f"seen {n} examples", "pattern_description": "counted", "pattern_category": "count", "confidence_score": 0.5,
            "distinguishing_features": ["count"], "code_indicators": [], "example_indices": list(range(1, n + 1)),
        }
        return [pattern], f"saw {n}"

    return ask


def extracted_patterns(spark, sf):
    """Patterns mined from the entries labeled toxic, chunk by chunk, and merged."""
    entries = files.label_entries(_label_files(spark, sf))
    found = extraction.extract_patterns(entries, "toxic", "1", "why", _counting_miner, max_examples=None)
    return found.patterns.select("pattern_name", "members", "example_count")


def _naming_miner():
    """A miner by rule: one pattern a chunk, named by its first document, citing the first and the last example."""

    def ask(prompt: str):
        n, first = prompt.count("--- Example "), re.search(r"Doc ID: (\S+)", prompt)[1]
        pattern = {
            "pattern_name": f"case {first}", "pattern_description": "named", "pattern_category": "case", "confidence_score": 0.5,
            "distinguishing_features": [], "code_indicators": [], "example_indices": [1, n],
        }
        return [pattern], f"named {first}"

    return ask


def _grouping_consolidator():
    """A consolidator by rule: all patterns of a prompt become one, named by their number."""

    def ask(prompt: str):
        n = prompt.count("--- Pattern ")
        pattern = {
            "pattern_name": f"group of {n}", "pattern_description": "grouped", "pattern_category": "case", "confidence_score": 0.5,
            "distinguishing_features": [], "code_indicators": [], "example_indices": list(range(1, n + 1)),
        }
        return [pattern], f"took {n}"

    return ask


def consolidated_patterns(spark, sf):
    """One pattern for each five entries labeled toxic, consolidated in prompts of four, level by level."""
    found = extraction.extract_patterns(
        files.label_entries(_label_files(spark, sf)), "toxic", "1", "why", _naming_miner, _grouping_consolidator, max_examples=None,
        chunk_size=5, prompt_patterns=4)
    return found.patterns.select("pattern_name", "example_count")


# Text and assertions --------------------------------------------------------------------------------


def ncloc_documents(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", X.code_line_count(lines).cast("bigint").alias("ncloc"))


def assertion_names(spark, sf):
    name = F.concat(F.when(F.col("p_size") % 5 == 0, "check").otherwise("assert"), F.initcap("p_name"), F.initcap(F.lower("p_type")))
    return table(spark, sf, "part").select("p_partkey", quality.classify_assertion_name(F.replace(name, F.lit(" "), F.lit(""))).alias("assertion_type"))


def statement_kinds(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", quality.classify_assert_statement(F.col("text")).alias("assertion_type"), quality.mentions_mock(F.col("text")).alias("mocks"))


def nearest_earlier_value(spark, sf):
    """For each purchase the value of the user's last click at or before it."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", _micros("ts").alias("at"))
    out = ordered.asof_backward(
        events.where("event_type = 'purchase'"), events.where("event_type = 'click'"), ["user_id"], "at", "event_id", "event_id", "value")
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), "user_id", "value")


def source_ranking(spark, sf):
    """Documents per source, ranked, with the grand total."""
    per = table(spark, sf, "documents").rollup("source").agg(F.count(F.lit(1)).alias("documents"), F.grouping("source").alias("_total"))
    counted = per.where("_total = 0").select("source", "documents")
    placed = ordered.with_position(counted.withColumn("_neg", -F.col("documents")), [], ["_neg", "source"], "rank")
    total = per.where("_total = 1").select(F.lit(None).cast("bigint").alias("rank"), F.lit("TOTAL").alias("source"), "documents")
    return placed.select("rank", "source", "documents").unionByName(total)


QUERIES = {
    f.__name__: f for f in (
        kappa_overall, kappa_by_lang, rolling_kappa_w50, rolling_kappa_multi_field, combination_filter, pairwise_labels,
        upsert_latest_label, upsert_final_label, promoted_fields, assigned_ids, confidence_bucket, unlabeled_docs, fetch_examples,
        label_documents, agreement_summary, flag_summary, decided_by_errors, prompt_render, snippets, cache_lookup, token_usage_summary,
        token_usage_by_role, report_units, rate_limit_admission, rate_limit_by_user, worker_assignment, knn_top5, knn_oversampled, knn_earlier,
        knn_repeated_ids, knn_missing_vector, knn_two_batches, same_names, typed_conditions, label_corpus_twice, label_corpus_usage,
        knn_confident, knn_label_vote, examples_block, normalized_names, similar_names, word_similarity, pattern_groups, created_patterns, stored_patterns,
        merged_patterns, pattern_statistics, pattern_confidence, streamed_confidence, chunk_assign, example_references, consolidated_references,
        alteration_counts, extracted_patterns, consolidated_patterns, altered_entries, alteration_errors, field_value_examples, label_file_entries, ncloc_documents, assertion_names, statement_kinds,
        nearest_earlier_value, source_ranking,
    )
}
