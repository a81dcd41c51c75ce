"""Line dedup: lines found in many documents stay in one of them only.

Lines are exploded with their position, hashed by their key, counted by distinct document per hash, and
documents are put together again by the positions that stay. Only hashes and positions are shuffled for the
count; a text moves once, to meet the positions that it loses.

Every step is a DataFrame operation. A line held by a third of all documents is counted after partial
aggregation, and the join back to its places is a sort-merge join whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, key128, named, whole

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def repeated_places(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Places that lose their line, as ``_id``, ``_t1``, ``_t2`` (hash of the text) and ``_pos`` (from 0)."""
    t1, t2 = key128(whole(text))
    lines = docs.select(
        F.col(doc_id).alias("_id"), t1.alias("_t1"), t2.alias("_t2"),
        F.posexplode(F.split(whole(text), "\n", -1)).alias("_pos", "_line"),
    ).select("_id", "_t1", "_t2", "_pos", line_key(F.col("_line")).alias("_key"))
    k1, k2 = key128(F.col("_key"))
    places = lines.where(F.length("_key") >= min_chars).select(
        "_id", "_t1", "_t2", "_pos", k1.alias("_k1"), k2.alias("_k2")
    )
    n_docs = F.count_distinct("_id") + F.max(F.col("_id").isNull().cast("int"))
    common = (
        places.groupBy("_k1", "_k2").agg(n_docs.alias("_n"), F.max("_id").alias("_keeper"))
        .where(F.col("_n") >= min_docs).drop("_n")
    )
    lost = places.join(common, ["_k1", "_k2"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    return lost.select("_id", "_t1", "_t2", "_pos")


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text",
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` with ``text`` rewritten and two counts added: lines before, and lines dropped.

    A text is split at every line feed. Keys (``line_key``) of at least ``min_chars`` code points found in at
    least ``min_docs`` documents lose all their lines except in the largest ``doc_id`` holding them, which
    keeps every one of its own. The other lines stay, joined by line feeds.

    * Null or empty text: one empty line, so the result is the empty text.
    * Rows with the same id are one document for the count; each row is rewritten by its own text, and equal
      rows give equal rows.
    * Rows without an id are together one document, smaller than every other.
    * Very long texts are exploded like any other; the positions that a text loses are never more than its lines.
    * An empty table gives no rows. Other columns stay as they are, whatever their names; columns named like
      the two counts are replaced (choose other names to keep them).
    """
    lost = (
        repeated_places(docs, min_chars, min_docs, doc_id, text)
        .groupBy("_id", "_t1", "_t2").agg(F.collect_set("_pos").alias("_lost"))
    )
    t1, t2 = key128(whole(text))
    rows = docs.select(F.struct(*named(docs.columns)).alias("_row"), t1.alias("_t1"), t2.alias("_t2"))
    r, l = rows.alias("r"), lost.alias("l")
    same = (
        F.col("r._row")[doc_id].eqNullSafe(F.col("l._id"))
        & (F.col("r._t1") == F.col("l._t1")) & (F.col("r._t2") == F.col("l._t2"))
    )
    joined = r.join(l, same, "left").select("r._row", "l._lost")
    lines = F.split(whole(F.col("_row")[text]), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_lost", F.array().cast("array<int>")))
    kept = F.when(F.col("_lost").isNull(), whole(F.col("_row")[text])).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    out = {n_lines: F.size("_lines").cast("long"), n_dropped: F.coalesce(F.size("_lost"), F.lit(0)).cast("long")}
    columns = [kept.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c not in out]
    return joined.withColumn("_lines", lines).select(*columns, *[v.alias(k) for k, v in out.items()])

