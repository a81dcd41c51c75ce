"""License scans by diagonal voting.

Every run of ``GRAM`` words of a text is hashed and joined to the positions where license templates hold the
same words. A hit votes for the diagonal ``position in text - position in template``: a template that stands
in the text gathers its votes on one diagonal, or on neighbouring ones where words were put in or left out.
Neighbouring diagonals are merged and the span they cover is checked against the template; a run of diagonals that is
longer than the template may be, as of a notice repeated back to back, is cut into spans that are checked one by one.

Templates are fixed short notices, so their positions are a table of a few hundred rows (``check_templates``
holds the bound): it is broadcast, and its hashes drop runs of words found in no template before the join.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, whole
from quillspark.llm.words import Words, byte_class, grams
from quillspark.session import materialize

GRAM = 3
MAX_POSITIONS = 20_000


@dataclass(frozen=True)
class Template:
    """Words to be found. ``exact``: only as they stand; else ``min_share`` of its runs within ``slack`` words."""

    label: str
    text: str
    exact: bool = False


# Phrases and labels of the contract.
BASE = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)
# Public wording of license notices.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mit", "released under the mit license"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("reserved", "all rights reserved"),
)

WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def check_templates(templates: Sequence[Template]) -> None:
    """The bound behind the broadcast; a larger set would need a join of two large tables."""
    sizes = [len(t.text.split()) for t in templates]
    if min(sizes, default=GRAM) < GRAM or sum(sizes) > MAX_POSITIONS:
        raise ValueError(f"templates need {GRAM} words or more each, and {MAX_POSITIONS} words or fewer together")


def template_positions(templates: Sequence[Template]) -> list[tuple]:
    """Rows (template, label, exact, its number of runs, position, hash, words)."""
    words, out = Words(WORD_BYTES), []
    for number, template in enumerate(templates):
        parts = template.text.split()
        hashes = grams(words.of(np.frombuffer(template.text.encode(), dtype=np.uint8))[2], GRAM).view(np.int64)
        out += [
            (number, template.label, template.exact, len(hashes), j, int(h), " ".join(parts[j : j + GRAM]))
            for j, h in enumerate(hashes)
        ]
    return out


def word_hits(docs: DataFrame, wanted: Sequence[int], doc_id: str, text: str) -> DataFrame:
    """Per row: ``n_words`` and the runs of words whose hash is in ``wanted``, with their place and words."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    known = np.array(sorted(set(wanted)), dtype=np.int64)
    hit = pa.struct([("pos", pa.int64()), ("gram", pa.int64()), ("words", pa.string())])
    is_word = WORD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(is_word)
        for batch in batches:
            counts, hits = [], []
            for _, data, starts, ends, hashes in words.each(batch.column(1).to_pylist()):
                counts.append(len(hashes))
                found: list = []
                if len(known) and len(hashes) >= GRAM:
                    runs = grams(hashes, GRAM).view(np.int64)
                    at = np.searchsorted(known, runs)
                    for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == runs).tolist():
                        said = b" ".join(bytes(words.lower[data[starts[k] : ends[k]]]) for k in range(i, i + GRAM))
                        found.append({"pos": i, "gram": int(runs[i]), "words": said.decode()})
                hits.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(hit))], ["doc_id", "n_words", "hits"]
            )

    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, hits array<struct<pos: bigint, gram: bigint, words: string>>"
    )


def _spans(hits: list[tuple[int, int]], runs: int, min_share: float, longest: int) -> Iterator[tuple[int, int, float]]:
    """Spans (first word, last word, share) of at most ``longest`` words in a run of hits (pos, j), none over another.

    From each place the shortest span with the most of the template; of all these the best share first, then the
    shortest, then the first.
    """
    hits = sorted(hits)
    found = []
    for i, (first, _) in enumerate(hits):
        met, last = set(), first
        for k in range(i, len(hits)):
            pos, j = hits[k]
            if pos + GRAM - first > longest or len(met) == runs:
                break
            if j not in met:
                met.add(j)
                last = pos
        if len(met) / runs >= min_share and (i == 0 or hits[i - 1][0] < first):
            found.append((-len(met), last - first, first))
    starts: list[int] = []
    lasts: list[int] = []
    for met, size, first in sorted(found):
        last = first + size + GRAM - 1
        at = bisect_left(starts, first)
        if (at == 0 or lasts[at - 1] < first) and (at == len(starts) or starts[at] > last):
            starts.insert(at, first)
            lasts.insert(at, last)
            yield first, last, -met / runs


def scan_licenses(
    docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, min_share: float = 0.7,
    slack: int = 3, doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """All rows as ``(row, doc_id, n_words)``, and the spans found in them.

    A span has ``row, template, label, exact, first_word, last_word`` (of the span, words from 0) and ``share``:
    the part of the template's runs of words that stand in it. Exact templates (``base``) need all of them on
    one diagonal; the others ``min_share`` of them on diagonals at most ``slack`` apart, over no more than
    twice the template's length. A longer run of such diagonals gives the spans of that length that stand in it.

    * A-Z are lower-cased; words are runs of digits, letters and anything beyond ASCII.
    * Null or empty text: no words, no spans. Equal rows are rows of their own. An empty table gives no rows.
    * The rows are numbered in a stored table without texts, so a lost executor never changes a number.
    * Hits of one text are grouped by (row, template): at most as many as the text has words.
    """
    spark = docs.sparkSession
    templates = [*base, *notices]
    check_templates(templates)
    places = template_positions(templates)
    rows = materialize(
        word_hits(docs, [p[5] for p in places], doc_id, text).withColumn("row", F.monotonically_increasing_id())
    )
    known = spark.createDataFrame(
        places, "template int, label string, exact boolean, runs int, j int, gram bigint, words string"
    )
    votes = (
        rows.select("row", F.inline("hits")).join(F.broadcast(known), ["gram", "words"])
        .withColumn("diagonal", F.col("pos") - F.col("j"))
        .groupBy("row", "template", "label", "exact", "runs", "diagonal")
        .agg(F.collect_set("j").alias("js"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along)
    fresh = (apart.isNull() | F.col("exact") | (apart > slack)).cast("long")
    merged = (
        votes.withColumn("_new", fresh).withColumn("_group", F.sum("_new").over(along))
        .groupBy("row", "template", "label", "exact", "runs", "_group")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("_met"),
            F.collect_list(F.struct("diagonal", "js")).alias("_lines"), F.min("low").alias("first_word"), (F.max("high") + GRAM - 1).alias("last_word"),
        )
    )
    share = F.col("_met") / F.col("runs")
    enough = F.when(F.col("exact"), F.col("_met") == F.col("runs")).otherwise(share >= min_share)
    fits = F.col("exact") | (F.col("last_word") - F.col("first_word") + 1 <= 2 * (F.col("runs") + GRAM - 1))
    stands = merged.where(enough).select(
        "row", "template", "label", "exact", "first_word", "last_word", share.alias("share"), "runs",
        F.when(~fits, F.col("_lines")).alias("_lines"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["_lines"] is None:
                    out.append(r)
                    continue
                hits = [(line["diagonal"] + j, j) for line in r["_lines"] for j in line["js"]]
                for first, last, part in _spans(hits, r["runs"], min_share, 2 * (r["runs"] + GRAM - 1)):
                    out.append(r | {"first_word": first, "last_word": last, "share": part})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema).select(kept)

    kept = ["row", "template", "label", "exact", "first_word", "last_word", "share"]
    spans = stands.mapInArrow(cut, T.StructType([stands.schema[c] for c in kept]))
    return rows.select("row", "doc_id", "n_words"), spans


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document row: counts and first words of the base phrases, labels, and the best share.

    ``n_base`` places of base phrases with their smallest and largest start (else null); ``base_labels`` and
    ``labels`` distinct, sorted and comma-joined (empty without any); ``score`` the largest share (0 without).
    """
    rows, spans = scan_licenses(docs, doc_id=doc_id, text=text, **options)
    base = F.when(F.col("exact"), F.col("first_word"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("row").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.max("share").alias("score"),
    )
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
