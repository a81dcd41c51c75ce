"""Selective relabeling of labeled-output files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.labels import json_path, meets_any
from quillspark.operators.ordered import first_rows


def mark_entries(entries: DataFrame, conditions: Sequence[tuple[str, object]]) -> DataFrame:
    """Entries with ``matches``: true or false for records with a label, null for everything else."""
    return entries.withColumn("matches", F.when(F.col("final_label").isNotNull(), meets_any("final_label", conditions)))


def entry_content(entry: Column, file_text: Column | None = None, resolved: Column | None = None) -> Column:
    """Text to relabel: the record's own code, else the file, else what its unit resolves to."""
    options = [json_path(entry, "code")] + [c for c in (file_text, resolved) if c is not None]
    return F.coalesce(*[F.when(c != "", c) for c in options])


def alter(marked: DataFrame, relabeled: DataFrame) -> DataFrame:
    """Marked entries with new labels in place; ``relabeled`` is ``(path, item, new_label)``.

    ``status`` is relabeled, failed (no new label came back), skipped (no condition met) or other.
    """
    joined = marked.join(relabeled, ["path", "item"], "left")
    status = (
        F.when(F.col("matches") & F.col("new_label").isNotNull(), "relabeled").when(F.col("matches"), "failed")
        .when(~F.col("matches"), "skipped").otherwise("other")
    )
    was = json_path("entry", "decided_by")
    return joined.withColumn("status", status).select(
        "path", "project", "item", "entry", "status",
        F.when(F.col("status") == "relabeled", F.col("new_label")).otherwise(F.col("final_label")).alias("final_label"),
        F.when(F.col("status") == "relabeled", "label_alterer").otherwise(was).alias("decided_by"),
        (F.col("status") == "relabeled").alias("relabeled"),
    )


def alteration_counts(altered: DataFrame) -> DataFrame:
    """One row: all entries, those that met a condition, relabeled, failed and skipped ones."""
    state = F.col("status")
    return altered.agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(state.isin("relabeled", "failed")).alias("filtered_items"),
        F.count_if(state == "relabeled").alias("relabeled_items"), F.count_if(state == "failed").alias("failed_items"),
        F.count_if(state == "skipped").alias("skipped_items"),
    )


def alteration_errors(altered: DataFrame) -> DataFrame:
    return altered.where("status = 'failed'").select(
        F.col("path").alias("file"), "item", F.lit("Relabeling returned None").alias("error")
    )


def altered_entry(entry: Column, final_label: Column, relabeled: Column) -> Column:
    """Entry JSON to write back: unchanged, or with the new label, its decider and the relabeled mark."""
    parsed = F.try_parse_json(entry)
    fields = parsed.cast("map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin("final_label", "decided_by", "relabeled"))
    new = F.create_map(
        F.lit("final_label"), F.parse_json(final_label), F.lit("decided_by"), F.parse_json(F.lit('"label_alterer"')),
        F.lit("relabeled"), F.parse_json(F.lit("true")),
    )
    return F.when(relabeled, F.to_json(F.map_concat(kept, new))).otherwise(F.coalesce(F.to_json(parsed), entry))


def altered_files(altered: DataFrame) -> DataFrame:
    """``(path, body)`` of the files with any relabeled entry; a file's entries came from one file's text."""
    entry = altered_entry(F.col("entry"), F.col("final_label"), F.col("relabeled"))
    member = F.concat(F.regexp_replace(F.to_json(F.array("item")), r"^\[|\]$", ""), F.lit(":"), entry)
    return altered.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("item", member.alias("m")))).alias("m"), F.bool_or("relabeled").alias("_any")
    ).where("_any").select(
        "path", F.concat(F.lit("{"), F.array_join(F.transform("m", lambda x: x["m"]), ","), F.lit("}")).alias("body")
    )


def field_examples(entries: DataFrame, field: str, value: str, reasoning_field: str, max_examples: int | None) -> DataFrame:
    """First ``max_examples`` entries (None: all), by file and item, whose label field has the value."""
    hits = entries.where(json_path("final_label", field) == value)
    rows = hits if max_examples is None else first_rows(hits, ["path", "item"], max_examples)
    return rows.select(
        F.col("item").alias("source"), "project", F.coalesce(json_path("entry", "doc_id"), F.lit("unknown")).alias("doc_id"),
        F.coalesce(json_path("entry", "code"), F.lit("")).alias("code"),
        F.coalesce(json_path("final_label", reasoning_field), F.lit("No reasoning provided")).alias("reasoning"),
        F.lit(value).alias("field_value"), "path", "item",
    )
