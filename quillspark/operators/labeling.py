"""Two independent labelers, adjudication of their disagreements, and a call cache.

Labelers see a frozen snapshot of the label store, so documents are independent of one another. Each
stage that calls a labeler is stored before anything reads it, so a lost executor repeats no finished call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.prompts import chat_prompt, examples_block, schema_json
from quillspark.functions.text import percent
from quillspark.operators.ratelimit import TokenBucket
from quillspark.session import materialize

REPLY = (
    "label_json string, error string, input_tokens long, output_tokens long, cached_input_tokens long, cached_output_tokens long"
)


@dataclass(frozen=True)
class Reply:
    label_json: str | None
    error: str | None = None
    input_tokens: int = 0
    output_tokens: int = 0
    cached_input_tokens: int = 0
    cached_output_tokens: int = 0


class Client(Protocol):
    def __call__(self, prompt: str) -> Reply: ...


@dataclass(frozen=True)
class Agent:
    """A labeler or adjudicator.

    ``rule`` labels in the JVM: a function from the document's columns to label JSON. ``client`` makes, once
    per task, a function from prompt to reply. Exactly one of the two is given.
    """

    agent_id: str
    system: str = "{patterns}\n{schema_json}"
    human: str = "{examples}\n{code}"
    model: str = "default"
    temperature: float = 0.1
    rule: Callable[[], Column] | None = None
    client: Callable[[], Client] | None = None


@dataclass(frozen=True)
class LabelConfig:
    schema: T.StructType
    labeler_a: Agent
    labeler_b: Agent
    adjudicator: Agent
    patterns: str = ""
    examples_k: int = 5
    retrieval: bool = True
    examples_formatter: Callable[[Column], Column] = examples_block
    label_equality: Callable[[Column, Column], Column] | None = None
    validation: Callable[[Column, Column], Column] | None = None
    index_fields: tuple[str, ...] = ()
    requests_per_minute: int | None = None
    examples_chars: int = 1000  # code points of an example's text that the formatter may show
    document_builder: Callable[[DataFrame], DataFrame] | None = None  # files or units to documents
    unit_resolver: Callable[[DataFrame], DataFrame] | None = None  # label entries to (path, item, text)
    extras: dict = field(default_factory=dict)


def unit_documents(units: DataFrame, content: Column, index_text: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Documents of labeling units; metadata already present wins over the unit's own fields."""
    own = F.map_filter(
        F.create_map(F.lit("unit_type"), F.col("unit_type"), F.lit("unit_id"), F.col("unit_id"), F.lit("source"), F.col("source")),
        lambda _, v: v.isNotNull(),
    )
    given = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    missing = F.map_filter(own, lambda k, _: ~F.map_contains_key(given, k))
    return units.select(
        "*", content.alias("text"), F.coalesce(index_text if index_text is not None else content).alias("index_text"),
        F.map_concat(given, missing).alias("metadata"),
    )


def plain_documents(files: DataFrame) -> DataFrame:
    """Default document: content and index text are the file's text, metadata its source."""
    meta = F.create_map(F.lit("source"), F.col("source"))
    return files.select("source", "text", F.col("text").alias("index_text"), meta.alias("metadata"))


def prompts(docs: DataFrame, agent: Agent, config: LabelConfig, **more: Column) -> Column:
    values = {
        "agent_id": F.lit(agent.agent_id), "patterns": F.lit(config.patterns),
        "schema_json": F.lit(schema_json(config.schema)), "code": F.col("text"),
        "examples": F.col("examples") if "examples" in docs.columns else F.lit(""), **more,
    }
    return chat_prompt(agent.system, agent.human, values)


def cache_key(model: Column, temperature: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", model, temperature.cast("string"), prompt), 256)


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache, and the distinct keys left to call."""
    hits = requests.join(cache, "key")
    misses = requests.join(cache.select("key"), "key", "left_anti")
    return hits, misses


def _invoke(requests: DataFrame, agent: Agent, rpm: int | None) -> DataFrame:
    """Call the agent's client for every ``(key, prompt)``; a failed call is a row with ``error``.

    With a limit there are as many tasks as shares of it. Each starts with its share as the burst, so all
    tasks together never exceed one bucket of ``rpm`` calls, however many of them run at once.
    """
    make = agent.client
    spark = requests.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rpm:
        tasks = max(1, min(tasks, rpm, spark.sparkContext.defaultParallelism))
    share = None if not rpm else rpm / tasks

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, bucket = make(), TokenBucket(share)
        for batch in batches:
            replies = []
            for prompt in batch["prompt"]:
                bucket.acquire()
                try:
                    replies.append(ask(prompt))
                except Exception as e:  # noqa: BLE001 - the failure is the row's value
                    replies.append(Reply(None, str(e) or type(e).__name__))
            yield pd.DataFrame([{"key": k, **r.__dict__} for k, r in zip(batch["key"], replies)],
                               columns=["key", *Reply.__dataclass_fields__])

    # dealt round robin: every task gets as many calls, so none waits for tokens that another does not use
    return requests.repartition(tasks).mapInPandas(rows, f"key string, {REPLY}")


@dataclass
class Journal:
    """What a labeling run called: rows that extend the cache, and usage rows per document and agent."""

    calls: list[DataFrame] = field(default_factory=list)
    usage: list[DataFrame] = field(default_factory=list)

    def note(self, agent: Agent, called: DataFrame | None, answers: DataFrame) -> None:
        if called is not None:
            self.calls.append(called.where("error IS NULL"))  # a failed call is tried again
        counters = [c.split()[0] for c in REPLY.split(", ")[2:]]
        self.usage.append(answers.select("doc_id", F.lit(agent.agent_id).alias("agent_id"), "from_cache", *counters))


def _answers(
    docs: DataFrame, agent: Agent, config: LabelConfig, cache: DataFrame | None = None, journal: Journal | None = None, **more: Column
) -> DataFrame:
    """``answer`` without the prompts: only keys are stored, a prompt is made again where it is called."""
    text = prompts(docs, agent, config, **more)
    if agent.rule is not None:
        return docs.select(
            "doc_id", agent.rule().alias("label_json"), F.lit(None).cast("string").alias("error"),
            F.lit(False).alias("from_cache"), *[F.lit(0).cast("long").alias(c) for c in (
                "input_tokens", "output_tokens", "cached_input_tokens", "cached_output_tokens")],
        )
    requests = materialize(docs.select("doc_id", cache_key(F.lit(agent.model), F.lit(agent.temperature), text).alias("key")))
    spark = docs.sparkSession
    known = cache if cache is not None else spark.createDataFrame([], f"key string, {REPLY}")
    missing = requests.join(known.select("key"), "key", "left_anti")
    payers = materialize(missing.groupBy("key").agg(F.min("doc_id").alias("_payer")))
    if payers.isEmpty():
        called = spark.createDataFrame([], f"key string, {REPLY}")
    else:
        asked = docs.select(F.col("doc_id").alias("_payer"), text.alias("prompt")).join(payers, "_payer").select("key", "prompt")
        called = materialize(_invoke(asked, agent, config.requests_per_minute))
    fresh = called.join(payers, "key")
    stored = known.withColumn("_payer", F.lit(None).cast("long")).unionByName(fresh)
    out = requests.join(stored, "key")
    paid = F.col("doc_id") == F.col("_payer")
    answers = out.select(
        "doc_id", "label_json", "error", F.coalesce(~paid, F.lit(True)).alias("from_cache"),
        *[F.when(paid, F.col(c)).otherwise(0).cast("long").alias(c) for c in (
            "input_tokens", "output_tokens", "cached_input_tokens", "cached_output_tokens")],
    )
    if journal is not None:
        journal.note(agent, called, answers)
    return answers


def answer(
    docs: DataFrame, agent: Agent, config: LabelConfig, cache: DataFrame | None = None, journal: Journal | None = None, **more: Column
) -> DataFrame:
    """``(doc_id, prompt, label_json, error, from_cache, token counters)`` of one agent over ``docs``.

    Equal prompts are called once. The calls made are stored as returned and noted in ``journal``.
    """
    answers = _answers(docs, agent, config, cache, journal, **more)
    shown = docs.select("doc_id", prompts(docs, agent, config, **more).alias("prompt"))
    return shown.join(answers, "doc_id").select("doc_id", "prompt", *answers.columns[1:])


def _adjudicated(config: LabelConfig) -> Column:
    return F.col("error").isNull() & ~F.coalesce(equal_labels(config), F.lit(False))


def with_prompts(labeled: DataFrame, config: LabelConfig) -> DataFrame:
    """Labeled documents with the three prompts, made from their text and labels."""
    judge = prompts(labeled, config.adjudicator, config, a=F.col("label_a"), b=F.col("label_b"))
    return labeled.withColumns({
        "prompt_a": prompts(labeled, config.labeler_a, config), "prompt_b": prompts(labeled, config.labeler_b, config),
        "prompt_adjudicator": F.when(_adjudicated(config), judge).otherwise(""),
    })


def _canonical(label: Column, schema: T.StructType) -> Column:
    """Label JSON in schema order, null when it does not parse."""
    parsed = F.from_json(label, schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(label).isNotNull(), F.to_json(parsed, {"ignoreNullFields": "false"}))


def decide(labels: DataFrame, decisions: DataFrame, config: LabelConfig) -> DataFrame:
    """Final label and who decided, from both labels and the adjudicator's answers.

    ``labels`` has ``doc_id, label_a, label_b, error``; ``decisions`` answers the documents that differ.
    """
    same = equal_labels(config)
    judged = decisions.select("doc_id", F.col("label_json").alias("_j"), F.col("error").alias("_je"), F.col("prompt").alias("prompt_adjudicator"))
    failed = F.col("error").isNotNull()
    agreed = same & ~failed
    ruling = _canonical(F.col("_j"), config.schema)
    broken = F.col("_je").isNotNull() | ruling.isNull()
    by = F.lit(f"adjudicator:{config.adjudicator.agent_id}")
    return labels.join(judged, "doc_id", "left").select(
        *labels.columns,
        F.when(failed, F.lit(None)).when(agreed | broken, F.col("label_a")).otherwise(ruling).alias("final_label"),
        F.when(failed, "error").when(agreed, "agreement").when(broken, "error_fallback_to_a").otherwise(by).alias("decided_by"),
        F.coalesce("prompt_adjudicator", F.lit("")).alias("prompt_adjudicator"),
    )


def equal_labels(config: LabelConfig) -> Column:
    if config.label_equality is not None:
        return config.label_equality(F.col("label_a"), F.col("label_b"))
    return F.col("label_a").eqNullSafe(F.col("label_b"))


def label_documents(
    docs: DataFrame, config: LabelConfig, cache: DataFrame | None = None, journal: Journal | None = None
) -> DataFrame:
    """Label every document of ``docs`` (``doc_id, text`` and, with retrieval, ``examples``).

    Adds ``label_a, label_b, final_label, decided_by``, the three prompts, ``error`` and
    ``hallucination_issues``. Only documents the labelers disagree on reach the adjudicator.
    """
    rules_only = all(a.rule is not None for a in (config.labeler_a, config.labeler_b, config.adjudicator))
    if rules_only:
        # One projection per step: an expensive rule is named once and then referred to, never repeated.
        raw = docs.select("*", config.labeler_a.rule().alias("_a"), config.labeler_b.rule().alias("_b"))
        both = raw.select(
            "*", _canonical(F.col("_a"), config.schema).alias("label_a"), _canonical(F.col("_b"), config.schema).alias("label_b"),
        )
        judged = both.select("*", equal_labels(config).alias("_same")).select(
            "*", F.when(~F.col("_same"), config.adjudicator.rule()).alias("_j")
        )
        ruling = _canonical(F.col("_j"), config.schema)
        judge = prompts(judged, config.adjudicator, config, a=F.col("label_a"), b=F.col("label_b"))
        final = judged.select("*", ruling.alias("_ruling")).select(
            *docs.columns, "label_a", "label_b", F.lit(None).cast("string").alias("error"),
            prompts(docs, config.labeler_a, config).alias("prompt_a"), prompts(docs, config.labeler_b, config).alias("prompt_b"),
            F.when(F.col("_same"), F.col("label_a")).otherwise(F.coalesce("_ruling", "label_a")).alias("final_label"),
            F.when(F.col("_same"), "agreement").when(F.col("_ruling").isNull(), "error_fallback_to_a")
            .otherwise(f"adjudicator:{config.adjudicator.agent_id}").alias("decided_by"),
            F.when(F.col("_same"), "").otherwise(judge).alias("prompt_adjudicator"),
        )
    else:
        a, b = (_answers(docs, agent, config, cache, journal) for agent in (config.labeler_a, config.labeler_b))

        def side(rows: DataFrame, tag: str) -> DataFrame:
            label = _canonical(F.col("label_json"), config.schema)
            wrong = F.when(F.col("error").isNull() & label.isNull(), F.lit("label is not valid JSON"))
            return rows.select("doc_id", label.alias(f"label_{tag}"), F.coalesce("error", wrong).alias(f"_e{tag}"))

        # Labels are stored without texts and prompts, which would be several copies of the documents.
        both = materialize(side(a, "a").join(side(b, "b"), "doc_id").withColumn("error", F.coalesce("_ea", "_eb")).drop("_ea", "_eb"))
        open_ = docs.join(both.where(_adjudicated(config)), "doc_id")
        judged = _answers(open_, config.adjudicator, config, cache, journal, a=F.col("label_a"), b=F.col("label_b"))
        decided = decide(both, judged.withColumn("prompt", F.lit(None).cast("string")), config).drop("prompt_adjudicator")
        final = with_prompts(docs.join(decided, "doc_id"), config)
    none = F.array().cast("array<string>")
    issues = none if config.validation is None else F.coalesce(config.validation(F.col("final_label"), F.col("text")), none)
    return final.withColumn("hallucination_issues", issues)


def label_rows(labeled: DataFrame, config: LabelConfig, created_at: Column) -> tuple[DataFrame, DataFrame]:
    """The store's per-agent label rows and final label rows of labeled documents."""
    per_agent = labeled.where("error IS NULL").select(
        "doc_id", created_at.alias("created_at"), F.explode(F.array(
            F.struct(F.lit(config.labeler_a.agent_id).alias("agent_id"), F.col("label_a").alias("label_json")),
            F.struct(F.lit(config.labeler_b.agent_id).alias("agent_id"), F.col("label_b").alias("label_json")),
        )).alias("r"),
    ).select("doc_id", "r.*", "created_at")
    final = labeled.where("final_label IS NOT NULL").select(
        "doc_id", "decided_by", F.col("final_label").alias("label_json"), created_at.alias("created_at")
    )
    return per_agent, final


def decision_summary(labeled: DataFrame, *keys: str) -> DataFrame:
    """Documents per key and deciding instance, with their share of the key in percent."""
    per = labeled.groupBy(*keys, "decided_by").agg(F.count(F.lit(1)).alias("documents"))
    totals = per.groupBy(*keys).agg(F.sum("documents").alias("_all"))
    joined = per.join(totals, list(keys)) if keys else per.crossJoin(F.broadcast(totals))
    share = F.try_divide(F.col("documents") * 100.0, F.col("_all"))
    return joined.select(*keys, "decided_by", "documents", F.round(share, 1).alias("percent"))


def flag_summary(labeled: DataFrame, flag: Column) -> DataFrame:
    """One row: documents, those with the flag, and both shares as ``x.y%`` (null when there are none)."""
    out = labeled.agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("related"))
    rest = F.col("total") - F.col("related")
    return out.select(
        "total", "related", percent(F.col("related"), F.col("total")).alias("related_percent"),
        rest.alias("unrelated"), percent(rest, F.col("total")).alias("unrelated_percent"),
    )


def report_rows(labeled: DataFrame, key: str = "source") -> DataFrame:
    """Rows of the labeled-output file: key, document, decision, label and prompts."""
    return labeled.select(
        F.col(key).alias("item"), "doc_id", "decided_by", "label_a", "label_b", "final_label",
        F.struct(F.col("prompt_a").alias("labeler_a"), F.col("prompt_b").alias("labeler_b"),
                 F.col("prompt_adjudicator").alias("adjudicator")).alias("prompts"),
    )
