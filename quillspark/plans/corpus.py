"""Labeling runs: documents in, store tables, index and results out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import sinks
from quillspark.functions.labels import json_path
from quillspark.operators import labeling, neighbors, store
from quillspark.operators.labeling import LabelConfig
from quillspark.session import drop_folder, materialize, new_folder
from quillspark.sources import schemas
from quillspark.sources.files import stored_or_empty


CALLS = f"key string, {labeling.REPLY}"
USAGE = "doc_id bigint, agent_id string, from_cache boolean, " + ", ".join(labeling.REPLY.split(", ")[2:])
_SCHEMAS = {
    "documents": store.DOCUMENTS, "labels": store.LABELS, "final_labels": store.FINAL_LABELS, "index": schemas.VECTORS,
    "cache": CALLS, "usage": USAGE,
}
_KEYS = {"labels": ["doc_id", "agent_id"], "final_labels": ["doc_id"]}
RUN = "batch"


def _before(run: str, batch: int) -> Column:
    """Rows of other runs, and of earlier batches of this one."""
    return (F.col("run") != run) | (F.col("batch") < batch)


@dataclass(frozen=True)
class Store:
    """Folders of one label store. A table is a series of batches of runs; writing a batch again replaces it.

    Every writer has a run name of its own, so batch numbers of a stream never meet those of another writer.
    """

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _rows(self, spark: SparkSession, name: str, before: tuple[str, int] | None) -> DataFrame:
        rows = stored_or_empty(spark, self.path(name), f"{_SCHEMAS[name]}, run string, batch long")
        return rows if before is None else rows.where(_before(*before))

    def read(self, spark: SparkSession, name: str, before: tuple[str, int] | None = None) -> DataFrame:
        """The table's rows with all columns ever stored, the last write per key.

        ``before`` = (run, batch) leaves out this and later batches of the run, which are about to be replaced.
        """
        rows = self._rows(spark, name, before)
        keys = _KEYS.get(name)
        return (store.latest(rows, keys, ["created_at", "run", "batch"]) if keys else rows).drop("run", "batch")

    def next_batch(self, spark: SparkSession, run: str = RUN) -> int:
        newest = self._rows(spark, "documents", None).where(F.col("run") == run).agg(F.max("batch")).first()[0]
        return 0 if newest is None else newest + 1

    def write(self, name: str, rows: DataFrame, batch: int, run: str = RUN) -> None:
        sinks.replace_table(rows, f"{self.path(name)}/run={run}/batch={batch}")

    def cells(self, spark: SparkSession) -> neighbors.CellIndex:
        """The index in cells, to which each batch adds its own rows; made from the index table where a store has none yet."""
        cells = neighbors.CellIndex(spark, self.path("cells"))
        if not len(cells.pivots()):
            cells.add(self._rows(spark, "index", None), "doc_id")
        return cells

    def clear(self, spark: SparkSession) -> None:
        """Start every table of the store anew."""
        neighbors.CellIndex(spark, self.path("cells")).clear()
        for name, schema in _SCHEMAS.items():
            empty = spark.createDataFrame([], f"{schema}, run string, batch long")
            empty.write.mode("overwrite").partitionBy("run", "batch").parquet(self.path(name))


def with_examples(
    docs: DataFrame, index: DataFrame | neighbors.CellIndex, documents: DataFrame, finals: DataFrame, config: LabelConfig, admit: Column | None = None,
) -> DataFrame:
    """Documents with the prompt block of their nearest labeled predecessors in ``index``.

    ``index`` is a table that is cut for this call, or a stored index of cells, of which ``admit`` says which runs and batches
    count. ``docs`` has ``doc_id`` and ``embedding``. Ids come oversampled by five, without the document itself and
    without repeats; examples are listed by label time, the latest first. Texts are cut to what the formatter
    may show before they are joined.
    """
    if isinstance(index, DataFrame):
        near = neighbors.nearest(docs, index, config.examples_k + 5, "doc_id", "doc_id", exclude_self=False)
    else:
        near = index.nearest(docs, config.examples_k + 5, "doc_id", exclude_self=False, admit=admit)
    near = neighbors.first_distinct(near, "doc_id", config.examples_k)
    ids = near.select("doc_id", F.col("neighbor_id"))
    shown = documents.withColumn("text", F.substring("text", 1, config.examples_chars))
    found = store.examples_for(ids.select(F.col("neighbor_id").alias("doc_id")), shown, finals)
    rows = ids.join(found.withColumnRenamed("doc_id", "neighbor_id"), "neighbor_id")
    entry = F.struct((-F.unix_micros("labeled_at")).alias("age"), F.col("neighbor_id").alias("doc_id"), "source", "text", "label_json")
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return docs.join(listed, "doc_id", "left").withColumn("examples", config.examples_formatter(F.col("_e"))).drop("_e")


def _numbered(docs: DataFrame, after: int) -> DataFrame:
    """Documents with ids in the order of source, text hash and place; the texts themselves are not sorted."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession)
    placed = materialize(docs.withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id()), folder=folder)
    ids = store.assign_ids(placed.select("source", "_h", "_row"), ["source", "_h", "_row"], after=after)
    numbered = materialize(placed.join(ids.select("_row", "doc_id"), "_row").select("doc_id", *docs.columns))
    drop_folder(spark, folder)  # a copy of all texts
    return numbered


def label_corpus(
    docs: DataFrame, config: LabelConfig, where: Store, created_at: Column | None = None, batch: int | None = None,
    fresh: bool = False, cache: DataFrame | None = None, run: str = RUN,
) -> DataFrame:
    """Label new documents ``(source, text[, embedding])`` against a snapshot of the store and add the outcome as a batch.

    Returns the labeled rows. Documents get new ids after the largest stored one, copies included. With
    retrieval on, ``docs`` must carry ``embedding``. The snapshot is everything but ``batch`` and later ones of
    the same ``run``, so running a batch again gives the same ids and replaces its rows. ``fresh`` starts from an
    empty store at batch 0. Calls answered before are taken from the store's cache (and ``cache``); new ones
    that succeeded are added to it, and the run's token usage is stored beside the labels.
    """
    spark = docs.sparkSession
    stamp = created_at if created_at is not None else F.current_timestamp()
    if config.document_builder is not None:
        docs = config.document_builder(docs)
    if fresh:
        where.clear(spark)
    number = 0 if fresh else (where.next_batch(spark, run) if batch is None else batch)
    known, finals, calls = (where.read(spark, n, before=(run, number)) for n in ("documents", "final_labels", "cache"))
    if cache is not None:
        calls = cache.unionByName(calls.join(cache.select("key"), "key", "left_anti"))
    calls = materialize(calls.dropDuplicates(["key"]))
    last = known.agg(F.max("doc_id")).first()[0] or 0
    numbered = _numbered(docs.withColumn("created_at", stamp), last)
    asked = numbered
    if config.retrieval:
        cells = where.cells(spark)
        asked = materialize(with_examples(numbered, cells, known, finals, config, admit=_before(run, number)))
    journal = labeling.Journal()
    found = labeling.label_documents(asked, config, calls, journal)
    own = [c for c in found.columns if c not in asked.columns and not c.startswith("prompt_")]
    light = materialize(found.select("doc_id", "created_at", *own))
    labeled = labeling.with_prompts(asked.join(light.drop("created_at"), "doc_id"), config)  # made when it is read
    per_agent, final = labeling.label_rows(light, config, F.col("created_at"))
    rows = {
        "documents": numbered.select("doc_id", "source", "text", "created_at"),
        "labels": store.with_index_fields(per_agent, config.index_fields),
        "final_labels": store.with_index_fields(final, config.index_fields),
    }
    if journal.calls:
        rows["cache"] = reduce(DataFrame.unionByName, journal.calls).dropDuplicates(["key"])
        rows["usage"] = reduce(DataFrame.unionByName, journal.usage)
    if config.retrieval:
        meta = F.create_map(F.lit("source"), F.col("source"))
        rows["index"] = numbered.select("doc_id", "embedding", meta.alias("metadata"))
    for name, part in rows.items():
        where.write(name, part, number, run)
    if config.retrieval:
        cells.add(numbered.select("doc_id", "embedding"), "doc_id", run=run, batch=number)
    return labeled


def alter_corpus(spark: SparkSession, input_root: str, output_root: str, conditions, config: LabelConfig, dry_run: bool = False, sources: DataFrame | None = None):
    """Relabel matching entries of label files; returns the counts row and the error rows.

    A dry run labels too, it only writes nothing. ``sources`` is ``(file, content)`` of the files that entries
    without code are about. Label files that cannot be read are among the errors. A file of one object a line is
    written as one object of items.
    """
    from quillspark.operators import alter
    from quillspark.sources import files
    from quillspark.sources.label_files import stored_label_members

    originals = files.label_files(spark, input_root)
    members = materialize(stored_label_members(spark, input_root))
    marked = materialize(alter.mark_entries(files.entries_of(members), conditions))
    wanted = marked.where("matches").select("path", "item", "entry")
    # a record without code falls back on the file it names, then on what its unit resolves to
    paths = F.coalesce(json_path("entry", "file_path"), F.col("item")).alias("_file")
    named = wanted.select("path", "item", "entry", paths)
    texts = sources if sources is not None else spark.createDataFrame([], "file string, content string")
    texts = texts.select(F.col("file").alias("_file"), F.col("content").alias("_content"))
    units = config.unit_resolver(wanted) if config.unit_resolver else spark.createDataFrame([], "path string, item string, text string")
    units = units.select("path", "item", F.col("text").alias("_resolved"))
    chosen = named.join(texts, "_file", "left").join(units, ["path", "item"], "left").select(
        "path", "item", alter.entry_content(F.col("entry"), F.col("_content"), F.col("_resolved")).alias("text")
    ).where("text IS NOT NULL")
    numbered = materialize(store.assign_ids(materialize(chosen), ["path", "item"]))
    labeled = labeling.label_documents(numbered, config)
    altered = materialize(alter.alter(marked, labeled.select("path", "item", F.col("final_label").alias("new_label"))))
    if not dry_run:
        bodies = materialize(alter.altered_files(altered))
        sinks.rewrite_label_files(originals, bodies, input_root, output_root)
    unread = files.unread_files(members).select(F.col("path").alias("file"), F.lit(None).cast("string").alias("item"), "error")
    return alter.alteration_counts(altered).first(), alter.alteration_errors(altered).unionByName(unread)
