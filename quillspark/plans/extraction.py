"""Pattern extraction from labeled examples: chunks, one call per chunk, merge, consolidation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.prompts import extraction_example, pattern_entry
from quillspark.operators import alter, patterns
from quillspark.operators.ordered import chunked, with_position
from quillspark.session import materialize

FOUND = (
    "chunk long, position int, pattern_name string, pattern_description string, pattern_category string, confidence_score double,"
    " distinguishing_features array<string>, code_indicators array<string>, example_indices array<int>, summary string"
)
_FIELDS = [f.split()[0] for f in FOUND.split(", ")][2:9]

# A miner takes a prompt and returns (patterns as dicts of the pattern fields, summary).
Miner = Callable[[], Callable[[str], tuple[list[dict], str]]]


@dataclass
class Extraction:
    """``notes`` has the summary of each chunk; ``merged`` is the number of patterns before they were consolidated."""

    patterns: DataFrame
    references: DataFrame
    total_examples: int
    found: int = 0
    merged: int = 0
    notes: DataFrame | None = None

    @property
    def summary(self) -> str:
        """The run in words; one line a chunk, read when it is asked for."""
        if self.notes is None:
            return "No examples found."
        lines = [f"Chunk {r['chunk'] + 1}: {r['s']}" for r in self.notes.orderBy("chunk").toLocalIterator()]
        return (
            f"Processed {self.total_examples} examples in {len(lines)} chunks.\nFound {self.found} patterns across chunks.\n"
            f"Merged to {self.merged} unique patterns.\nConsolidated to {self.patterns.count()} high-quality patterns.\n\n" + "\n".join(lines)
        )


def _mine(prompts: DataFrame, miner: Miner) -> DataFrame:
    """Patterns of each ``(chunk, prompt)``; a chunk without patterns still returns its summary."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = miner()
        for batch in batches:
            out = []
            for chunk, prompt in zip(batch["chunk"], batch["prompt"]):
                found, summary = ask(prompt)
                out += [{"chunk": chunk, "position": i, "summary": summary, **p} for i, p in enumerate(found)] or [
                    {"chunk": chunk, "position": -1, "summary": summary}
                ]
            frame = pd.DataFrame(out).reindex(columns=["chunk", "position", *_FIELDS, "summary"])
            yield frame.astype(object).where(frame.notna(), None)

    # prompts are few small rows, so the number of tasks is stated: Spark would join them up by their bytes
    n = int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prompts.repartition(n, "chunk").mapInPandas(rows, FOUND)


def in_range(found: DataFrame) -> DataFrame:
    """Extracted patterns whose confidence lies in [0, 1]."""
    return found.where(F.col("confidence_score").between(0.0, 1.0))


def extract_patterns(entries: DataFrame, field: str, value: str, reasoning_field: str, miner: Miner, consolidator: Miner | None = None,
                     max_examples: int | None = 50, chunk_size: int = 20, prompt_patterns: int | None = None) -> Extraction:
    """New patterns among label entries whose ``field`` is ``value``.

    Each chunk is one call; its example indices become references, similar patterns merge, and more than three merged
    patterns are consolidated: by one call, or level by level in prompts of at most ``prompt_patterns``.
    """
    examples = materialize(alter.field_examples(entries, field, value, reasoning_field, max_examples))
    total = examples.count()
    spark = entries.sparkSession
    if total == 0:
        none = spark.createDataFrame([], "pattern long, file_path string, doc_id string, project string")
        return Extraction(spark.createDataFrame([], FOUND), none, 0)
    parts = materialize(chunked(examples, ["path", "item"], chunk_size))
    text = extraction_example(F.col("index_in_chunk"), F.col("source"), F.col("doc_id"), F.col("project"), F.col("reasoning"), reasoning_field, F.col("code"))
    # A chunk holds at most chunk_size examples.
    prompts = parts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("index_in_chunk", text.alias("t")))).alias("x")).select(
        "chunk", F.array_join(F.transform("x", lambda e: e["t"]), "\n").alias("prompt")
    )
    mined = materialize(_mine(prompts, miner))
    found = materialize(with_position(in_range(mined.where("position >= 0")), [], ["chunk", "position"], "pattern"))
    refs = patterns.resolve_examples(found, parts)
    merged, merged_refs = patterns.merge_similar(found, refs)
    merged, merged_refs = materialize(merged), materialize(merged_refs)
    count, kept = merged.count(), merged
    if consolidator is not None and count > 3:
        kept, merged_refs = _consolidate(merged, merged_refs, consolidator, prompt_patterns or count)
    notes = mined.groupBy("chunk").agg(F.first("summary").alias("s"))
    return Extraction(kept, merged_refs, total, found.count(), count, notes)


def _consolidate(merged: DataFrame, references: DataFrame, consolidator: Miner, size: int) -> tuple[DataFrame, DataFrame]:
    """Patterns consolidated in prompts of at most ``size``, whose results meet in the prompts of the next level.

    References go up with the inputs that a result cites. The last level is one prompt, unless a level brings
    no fewer patterns than it was given; without results nothing is left.
    """
    level, refs, n = merged, references, merged.count()
    while True:
        parts = materialize(chunked(level, ["seed"], size))
        entry = pattern_entry(F.col("index_in_chunk"), {c: F.col(c) for c in level.columns})
        # A chunk holds at most size patterns.
        prompts = parts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("index_in_chunk", entry.alias("t")))).alias("x")).select(
            "chunk", F.array_join(F.transform("x", lambda e: e["t"]), "\n").alias("prompt")
        )
        mined = materialize(_mine(prompts, consolidator)).where("position >= 0")
        found = materialize(with_position(in_range(mined), [], ["chunk", "position"], "pattern"))
        refs = materialize(patterns.resolve_consolidated(found, parts, refs).withColumnRenamed("pattern", "seed"))
        counts = refs.groupBy("seed").agg(F.count(F.lit(1)).alias("example_count"))
        level = materialize(found.withColumnRenamed("pattern", "seed").join(counts, "seed", "left").select(
            "seed", "pattern_name", "pattern_description", "pattern_category", "confidence_score",
            F.coalesce("example_count", F.lit(0)).alias("example_count"), "distinguishing_features", "code_indicators",
        ))
        given, n = n, level.count()
        if given <= size or n >= given or n == 0:
            return level, refs
