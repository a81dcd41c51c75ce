"""Prompt text as column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping
from string import Formatter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import code_snippet, short_reference, snippet


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` marks (``{{`` for a brace) as one concatenation."""
    parts: list[Column] = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(F.coalesce(values[field], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def chat_prompt(system: str, human: str, values: Mapping[str, Column]) -> Column:
    """System and human templates in the layout that is stored with every label."""
    return F.concat(F.lit("[SYSTEM]\n"), render(system, values), F.lit("\n\n[HUMAN]\n"), render(human, values))


def schema_json(schema: T.StructType) -> str:
    return json.dumps(schema.jsonValue(), indent=2, ensure_ascii=False)


def indented_json(labels: Column) -> Column:
    """Each JSON text of an array, indented by two; other text under ``raw``, null or empty as an empty object.

    A prompt shows a handful of labels, so this small step runs in Arrow batches of Python.
    """

    def indent(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = json.loads(text or "{}")
            except ValueError:
                value = {"raw": text}
            return json.dumps(value, indent=2, ensure_ascii=False)

        return texts.map(lambda several: None if several is None else [one(t) for t in several])

    return F.pandas_udf(T.ArrayType(T.StringType()))(indent)(labels)


# The wording of the example, extraction, pattern and reference texts in this module.


def examples_block(examples: Column) -> Column:
    """First five of ``array<struct<doc_id, text, label_json>>`` as a readable block."""
    first = F.slice(examples, 1, 5)
    shown = F.zip_with(
        first, indented_json(F.transform(first, lambda e: e["label_json"])),
        lambda e, label: F.concat(
            F.lit("Example doc_id="), e["doc_id"].cast("string"), F.lit("\nDocument snippet:\n"), snippet(e["text"]),
            F.lit("\n\nFinal label:\n"), label,
        ),
    )
    none = F.lit("No similar past labeled examples were found.")
    return F.when(F.coalesce(F.size(examples), F.lit(0)) <= 0, none).otherwise(F.array_join(shown, "\n\n"))


# The wording of the cautious example block.
_RULE = "=" * 60
_HEAD = "\n".join([
    _RULE, "REFERENCE EXAMPLES (for validation only — DO NOT use to add features)", _RULE, "",
    "These are DIFFERENT test modules. Use them only to validate your analysis,",
    "NOT to add features or imports to the current test.", "", "",
])
_TAIL = "\n".join([_RULE, "REMINDER: Analyze the CURRENT test module, not these examples!", _RULE])


def cautious_examples_block(examples: Column, flag: str) -> Column:
    """All of ``array<struct<source, flag, code>>`` between warnings against copying from them."""
    shown = F.transform(
        examples,
        lambda e, i: F.concat(
            F.lit("--- Reference Example "), (i + 1).cast("string"), F.lit(" ---\nSource: "),
            F.coalesce(e["source"], F.lit("unknown")), F.lit(f"\n{flag}: "), F.coalesce(e["flag"], F.lit("unknown")),
            F.when(F.coalesce(e["code"], F.lit("")) != "", F.concat(F.lit("\nCode snippet:\n"), short_reference(e["code"])))
            .otherwise(F.lit("")), F.lit("\n\n"),
        ),
    )
    none = F.lit("No reference examples available.")
    return F.when(F.coalesce(F.size(examples), F.lit(0)) <= 0, none).otherwise(
        F.concat(F.lit(_HEAD), F.array_join(shown, ""), F.lit(_TAIL))
    )


def extraction_example(index: Column, source: Column, doc_id: Column, project: Column, reasoning: Column,
                       reasoning_field: str, code: Column) -> Column:
    """One numbered example of a pattern-extraction prompt."""
    return F.concat(
        F.lit("--- Example "), index.cast("string"), F.lit(" ---\nFile: "), source, F.lit("\nDoc ID: "), doc_id.cast("string"),
        F.lit("\nProject: "), project, F.lit(f"\nReasoning ({reasoning_field}): "),
        F.coalesce(reasoning, F.lit("No reasoning provided")), F.lit("\nCode snippet:\n"), code_snippet(code), F.lit("\n"),
    )


def pattern_entry(index: Column, p: Mapping[str, Column]) -> Column:
    """One numbered pattern of a consolidation prompt."""
    bullets = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")
    return F.concat(
        F.lit("--- Pattern "), index.cast("string"), F.lit(" ---\nName: "), p["pattern_name"], F.lit("\nCategory: "),
        p["pattern_category"], F.lit("\nDescription: "), p["pattern_description"], F.lit("\nExample Count: "),
        p["example_count"].cast("string"), F.lit("\nConfidence: "), F.format_string("%.2f", p["confidence_score"]),
        F.lit("\nDistinguishing Features:\n"), bullets(p["distinguishing_features"]), F.lit("\nCode Indicators:\n"),
        bullets(p["code_indicators"]), F.lit("\nExample References: "), p["example_count"].cast("string"), F.lit(" examples\n"),
    )


def reference_listing(references: Column) -> Column:
    """First ten references, and how many more there are."""
    lines = F.transform(
        F.slice(references, 1, 10),
        lambda r, i: F.concat((i + 1).cast("string"), F.lit(". File: "), r["file_path"], F.lit(" (Doc ID: "), r["doc_id"],
                              F.lit(", Project: "), r["project"], F.lit(")")),
    )
    more = F.when(F.size(references) > 10, F.concat(F.lit("\n... and "), (F.size(references) - 10).cast("string"),
                                                    F.lit(" more examples"))).otherwise(F.lit(""))
    return F.concat(F.array_join(lines, "\n"), more)
