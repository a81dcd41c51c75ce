"""Document and label store: three tables kept as parquet, latest write wins per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.labels import promote
from quillspark.operators.ordered import with_position

DOCUMENTS = "doc_id bigint, source string, text string, created_at timestamp"
LABELS = "doc_id bigint, agent_id string, label_json string, created_at timestamp"
FINAL_LABELS = "doc_id bigint, decided_by string, label_json string, created_at timestamp"


def assign_ids(docs: DataFrame, order: Sequence[str], after: int = 0, name: str = "doc_id") -> DataFrame:
    """Consecutive ids after ``after`` in a stated order; repeated documents get ids of their own."""
    return with_position(docs, [], order, name).withColumn(name, F.col(name) + F.lit(after))


def latest(rows: DataFrame, keys: Sequence[str], recency: Sequence[str]) -> DataFrame:
    """Last write per key. An aggregate, not a window: partial results combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*recency)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*rows.columns)


def earliest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order`` (first-wins dedup), by the same aggregate shape as ``latest``."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*rows.columns)


def upsert_labels(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per-agent labels keyed by (doc_id, agent_id); needs a ``seq`` column that orders equal times."""
    return latest(current.unionByName(incoming), ["doc_id", "agent_id"], ["created_at", "seq"])


def upsert_final_labels(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Final labels keyed by doc_id."""
    return latest(current.unionByName(incoming), ["doc_id"], ["created_at", "seq"])


def with_index_fields(labels: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Label rows with chosen label fields promoted to text columns."""
    return labels.select("*", *promote("label_json", fields))


def orphans(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows whose document does not exist (the foreign-key check)."""
    return rows.join(documents.select("doc_id"), "doc_id", "left_anti")


def unlabeled(documents: DataFrame, final_labels: DataFrame) -> DataFrame:
    return documents.join(final_labels.select("doc_id"), "doc_id", "left_anti")


def pairwise_labels(labels: DataFrame, agent_a: str, agent_b: str) -> DataFrame:
    """Both agents' labels per document, stamped with the later of the two times."""
    a = labels.where(F.col("agent_id") == agent_a).select(
        "doc_id", F.col("label_json").alias("a_label_json"), F.col("created_at").alias("_ta")
    )
    b = labels.where(F.col("agent_id") == agent_b).select(
        "doc_id", F.col("label_json").alias("b_label_json"), F.col("created_at").alias("_tb")
    )
    return a.join(b, "doc_id").select(
        "doc_id", F.greatest("_ta", "_tb").alias("created_at"), "a_label_json", "b_label_json"
    )


def examples_for(ids: DataFrame, documents: DataFrame, final_labels: DataFrame) -> DataFrame:
    """Labeled examples of the given doc ids, each with the time it was labeled."""
    wanted = ids.select("doc_id").distinct()
    finals = final_labels.join(wanted, "doc_id", "left_semi").select(
        "doc_id", "decided_by", "label_json", F.col("created_at").alias("labeled_at")
    )
    return finals.join(documents.select("doc_id", "source", "text"), "doc_id")
