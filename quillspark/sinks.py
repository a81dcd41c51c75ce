"""Sinks: tables, result rows, nested reports and rewritten label files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.files import relative_path
from quillspark.sources.schemas import PATTERN_ROWS


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace_table(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Fresh build of a table. Never point it at a path that ``rows`` reads from."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_index(vectors: DataFrame, path: str) -> None:
    """Append vectors ``(doc_id, embedding, metadata)`` to the stored index, one batch at a time."""
    append_table(vectors, path)


def save_patterns(patterns: DataFrame, path: str) -> None:
    """Store patterns as one JSON object a line, the form that ``files.pattern_rows`` loads; it replaces what was there."""
    named = dict(f.split(" ") for f in PATTERN_ROWS.split(", "))
    have = set(patterns.columns)
    columns = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in named.items()]
    patterns.select(*columns).write.mode("overwrite").json(path)


def result_rows(rows: DataFrame, path: str) -> None:
    """One JSON object per result, keyed by its ``item``."""
    rows.write.mode("overwrite").json(path)


def results_document(rows: DataFrame, key: str = "item") -> DataFrame:
    """Results of each project as one JSON object ``{item: {...}}``; bounded by one project's results.

    For whole corpora use ``result_rows``.
    """
    rest = F.to_json(F.struct(*[c for c in rows.columns if c not in (key, "project")]))
    member = F.concat(F.regexp_replace(F.to_json(F.array(key)), r"^\[|\]$", ""), F.lit(":"), rest)
    listed = rows.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(key, member.alias("m")))).alias("m"))
    return listed.select("project", F.concat(F.lit("{"), F.array_join(F.transform("m", lambda x: x["m"]), ","), F.lit("}")).alias("body"))


def write_files(files: DataFrame, root: str) -> int:
    """Write ``(path, body)`` rows as files below ``root``; returns how many.

    Every row becomes one file, so a repeated task writes the same file again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"]):
                target = f"{base}/{path.lstrip('/')}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(body.encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    done = files.select("path", "body").mapInPandas(write, "n long").agg(F.sum("n")).first()[0]
    return int(done or 0)


def rewrite_label_files(originals: DataFrame, altered: DataFrame, input_root: str, output_root: str, backup: bool = True) -> int:
    """Altered label files at their relative paths below another root, each beside its ``.json.bak`` original."""
    if output_root.rstrip("/") == input_root.rstrip("/"):
        raise ValueError("label files are never rewritten in place")
    relative = relative_path(F.col("path"), input_root)
    new = altered.select(relative.alias("path"), "body")
    if backup:
        kept = originals.join(altered.select("path"), "path", "left_semi")
        name = F.regexp_replace(relative, r"\.json$", ".json.bak")
        new = new.unionByName(kept.select(name.alias("path"), "body"))
    return write_files(new, output_root)
