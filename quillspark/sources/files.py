"""File sources: source trees, safe text reads, report and label JSON, ranking text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources import schemas

# Well-formed UTF-8 sequences, matched on bytes shown as ISO-8859-1 characters; any other byte is dropped.
_WELL_FORMED = (
    r"(?s)([\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})|."
)


def decode_ignoring(content: Column) -> Column:
    """UTF-8 text of binary content without the malformed bytes; well-formed content is not rewritten."""
    text = content.cast("string")
    kept = F.regexp_replace(F.decode(content, "ISO-8859-1"), _WELL_FORMED, "$1")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.encode(kept, "ISO-8859-1").cast("string"))


def decode_replacing(content: Column) -> Column:
    """UTF-8 text of binary content with malformed bytes shown as the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def decode_strict(content: Column) -> Column:
    """UTF-8 text of binary content, null when malformed."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def binary_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``(path, content)`` of all files below ``root`` ending in ``suffix`` (case-sensitive).

    Given one file, the suffix is compared without case and a mismatch yields no rows.
    """
    reader = spark.read.format("binaryFile")
    if _is_file(spark, root):
        loaded = reader.load(root).where(F.lower("path").endswith(suffix.lower()))
    else:
        loaded = reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return loaded.select("path", "content")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this path or URI, as its own file system says."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path names one file, as its own file system says; false for anything that is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.exists(where) and system.getFileStatus(where).isFile()


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``, whichever scheme and host spell the two."""
    bare = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/", root).rstrip("/")
    return F.regexp_replace(path, rf"^.*?\Q{bare}\E/", "")


def text_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``(source, text)`` of documents below ``root``, malformed bytes ignored."""
    return binary_files(spark, root, suffix).select(
        F.col("path").alias("source"), decode_ignoring(F.col("content")).alias("text")
    )


def python_sources(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """``(project, file_path, qualified_name, text)`` of every ``.py`` file below ``root``.

    Without a project name the first folder below ``root`` names the project, so one scan covers many
    repositories. ``text`` is null for files that are not UTF-8.
    """
    files = binary_files(spark, root, ".py")
    plain = F.regexp_replace("path", "^file:/+", "/")
    named = files.withColumn("_tail", F.replace(relative_path(F.col("path"), root), F.lit("\\"), F.lit("/")))
    if project is not None:
        owner, name = F.lit(project), F.col("_tail")
    else:
        owner = F.substring_index("_tail", "/", 1)
        name = F.expr("substring(_tail, length(substring_index(_tail, '/', 1)) + 2)")
    return named.select(
        owner.alias("project"), plain.alias("file_path"), name.alias("qualified_name"),
        decode_strict(F.col("content")).alias("text"),
    )


def source_text(spark: SparkSession, text: str, name: str = "input.py") -> DataFrame:
    """A single in-memory source as a one-file project."""
    return spark.createDataFrame([(name, name, name, text)], schemas.SOURCES)


def read_safely(units: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Units with ``content``: the file's text, or a bracketed note when there is no path or file.

    ``files`` is ``(path, content)`` as bytes; a file that is there but has no content was not readable, and an
    ``error`` column of its own says why.
    """
    why = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    texts = files.select(
        F.col("path").alias("_p"), decode_replacing(F.col("content")).alias("_text"), why.alias("_why"),
    )
    where = F.col(path)
    note = (
        F.when(F.coalesce(where, F.lit("")) == "", F.lit("[No file path provided]"))
        .when(F.col("_p").isNull(), F.concat(F.lit("[File not found: "), where, F.lit("]")))
        .otherwise(F.concat(F.lit("[Error reading "), where, F.lit(": "), F.coalesce("_why", F.lit("no content")), F.lit("]")))
    )
    return units.join(texts, where == F.col("_p"), "left").select(
        *units.columns, F.coalesce("_text", note).alias("content")
    )


def report_units(spark: SparkSession, path: str) -> DataFrame:
    """One labeling unit per test module of a project report."""
    return units_of_report(spark.read.schema(schemas.REPORT).option("multiLine", True).json(path))


def units_of_report(report: DataFrame) -> DataFrame:
    projects = report.select(F.explode("projects").alias("p"))
    modules = projects.select(
        F.coalesce("p.project_name", F.lit("unknown")).alias("project_name"), F.explode("p.test_modules").alias("m")
    ).where(F.coalesce("m.is_test_module", F.lit(True)))
    path = F.coalesce("m.file_path", F.lit(""))
    return modules.select(
        F.lit("test_module").alias("unit_type"),
        F.to_json(F.struct("project_name", path.alias("file_path"))).alias("unit_id"),
        path.alias("source"), "project_name", path.alias("file_path"),
    )


def label_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, body)`` of the label JSON files below ``root``."""
    return binary_files(spark, root, ".json").select("path", decode_ignoring(F.col("content")).alias("body"))


MEMBER_BATCH_BYTES = 4 << 20
_SPACE = re.compile(r"[ \t\n\r]*")


def _members(text: str) -> dict[str, tuple[int, int]]:
    """Span of the value of each top-level member of a JSON object; of repeated names the last counts."""
    scan = json.JSONDecoder().raw_decode
    skip = lambda i: _SPACE.match(text, i).end()
    at, found = skip(0), {}
    if text[at : at + 1] != "{":
        raise ValueError("not a JSON object")
    at = skip(at + 1)
    while text[at : at + 1] != "}":
        name, at = scan(text, at)
        at = skip(at)
        if not isinstance(name, str) or text[at : at + 1] != ":":
            raise ValueError(f"no member at character {at}")
        start = skip(at + 1)
        _, at = scan(text, start)
        found[name] = (start, at)
        at = skip(at)
        if text[at : at + 1] == ",":
            at = skip(at + 1)
            if text[at : at + 1] == "}":
                raise ValueError(f"no member at character {at}")
        elif text[at : at + 1] != "}":
            raise ValueError(f"no end of the object at character {at}")
    if skip(at + 1) != len(text):
        raise ValueError(f"more text at character {at + 1}")
    return found


def label_members(files: DataFrame) -> DataFrame:
    """``path, item, value, error``: the members of label files as JSON text, a row each, in batches bounded by bytes.

    A body is one JSON object of items, taken apart by position. A body that cannot be read gives one row with
    ``error``. Files that hold one object a line, or are too large for one value, are read by
    ``label_files.stored_label_members``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                try:
                    text = body.as_py()
                    if text is None:
                        raise ValueError("no content")
                    for item, (start, end) in _members(text).items():
                        rows.append((path, item, text[start:end], None))
                        held += end - start
                        if held >= MEMBER_BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                except ValueError as e:
                    rows.append((path, None, None, str(e)))
                if rows:
                    yield _batch(rows)

    return files.select("path", "body").mapInArrow(run, "path string, item string, value string, error string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["path", "item", "value", "error"])


def label_entries(files: DataFrame) -> DataFrame:
    """Entries of label files (``entries_of``); ``unread_files`` tells which files gave none."""
    return entries_of(label_members(files))


def unread_files(members: DataFrame) -> DataFrame:
    """``path, error`` of the label files among ``label_members`` that could not be read."""
    return members.where("item IS NULL").select("path", "error")


def entries_of(members: DataFrame) -> DataFrame:
    """``path, project, item, entry, is_record, final_label`` of the members of label files.

    ``entry`` and ``final_label`` are JSON text. ``is_record`` tells records from stray values, and
    ``final_label`` is null for a stray value or a label that is not an object; a record without one has an
    empty label. The label of a result row (``line``) may be an object as text.
    """
    each = members.where("item IS NOT NULL").withColumn("_e", F.try_parse_json("value"))
    is_record = F.coalesce(F.schema_of_variant("_e").startswith("OBJECT"), F.lit(False))
    label = F.when(is_record, F.try_variant_get("_e", "$.final_label", "variant"))
    if "line" in members.columns:  # rows of results hold their label as text
        written = F.try_parse_json(F.try_variant_get("_e", "$.final_label", "string"))
        label = F.when(F.col("line") & (F.schema_of_variant(label) == "STRING") & written.isNotNull(), written).otherwise(label)
    label_json = F.when(label.isNull() & is_record, F.lit("{}")).when(
        F.schema_of_variant(label).startswith("OBJECT"), F.to_json(label)
    )
    return each.select(
        "path", F.element_at(F.split("path", "/"), -2).alias("project"), "item",
        F.coalesce(F.to_json("_e"), F.col("value")).alias("entry"), is_record.alias("is_record"),
        label_json.alias("final_label"),
    )


def ranking_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(rank, project, tests)`` of a fixed-width ranking text; headings and the total line drop out."""
    shape = r"^\s*(\d+)\.?\s+(\S.*?)\s+(\d+)\s*$"
    part = [F.regexp_extract(column, shape, i) for i in (1, 2, 3)]
    return lines.where(F.col(column).rlike(shape)).select(
        part[0].cast("int").alias("rank"), part[1].alias("project"), part[2].cast("int").alias("tests")
    )


def pattern_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored patterns, and the lines that could not be parsed (kept aside as the backup)."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    broken = F.try_parse_json("value").isNull()
    parsed = F.from_json("value", schemas.PATTERN_ROWS, {"mode": "PERMISSIVE"}).alias("p")
    good = lines.where(~broken).select(parsed).where("p.pattern_id IS NOT NULL").select("p.*")
    return good, lines.where(broken)


def stored_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table with all columns that were ever stored, or an empty one when nothing was stored yet.

    Any other failure to read is an error: a store that cannot be read is not an empty store.
    """
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        # no folder, or a folder without a file
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    wanted = T._parse_datatype_string(schema)
    have = set(stored.columns)
    columns = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return stored.select(*columns, *[c for c in stored.columns if c not in wanted.names])
