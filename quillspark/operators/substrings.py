"""Substring joins as equi joins on rare grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A needle is looked up by grams of the largest of these sizes that it reaches. With one small size, names that differ
# in their digits only meet all texts that share three of them, which grows with names times texts.
GRAMS = (1, 2, 3, 6, 12)


def _grams(text: str | Column, size: str | Column) -> Column:
    """Distinct substrings of one length; none when the text is shorter."""
    text, size = (F.col(c) if isinstance(c, str) else c for c in (text, size))
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda p: F.substring(text, p, size)))


def _size(needle: str) -> Column:
    return F.greatest(*[F.when(F.length(needle) >= size, size).otherwise(0) for size in GRAMS])


def candidates(texts: DataFrame, needles: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """``(_k, _t1, _t2, _needle)``: needles and the hashes of the texts of their key that hold the needle's rarest gram.

    A needle has one size of gram, a text offers its distinct grams of all sizes there are, at most as many as it has
    characters for each.
    """
    wanted = needles.select(F.col(key).alias("_k"), F.col(needle).alias("_needle")).where(F.length("_needle") > 0).distinct()
    wanted = wanted.withColumn("_size", _size("_needle"))
    whole = _hashed(texts, key, text)
    sizes = wanted.select("_k", "_size").distinct()  # at most len(GRAMS) rows a key
    offered = whole.join(sizes, "_k").select("_k", "_t1", "_t2", "_size", F.explode(_grams("_text", "_size")).alias("_gram"))
    common = offered.groupBy("_k", "_size", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    # A needle with a gram that no text holds occurs in none.
    own = wanted.select("_k", "_needle", "_size", F.explode(_grams("_needle", "_size")).alias("_gram"))
    anchors = own.join(common, ["_k", "_size", "_gram"], "left").groupBy("_k", "_needle", "_size").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_a")
    ).where("_a.n > 0").select("_k", "_needle", "_size", F.col("_a._gram").alias("_gram"))
    return offered.join(anchors, ["_k", "_size", "_gram"]).select("_k", "_t1", "_t2", "_needle")


def _hashed(texts: DataFrame, key: str, text: str) -> DataFrame:
    whole = texts.select(F.col(key).alias("_k"), F.col(text).alias("_text")).distinct()
    return whole.withColumn("_t1", F.xxhash64("_text")).withColumn("_t2", F.xxhash64(F.lit("second"), "_text"))


def substring_pairs(texts: DataFrame, needles: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """``(key, text, needle)`` for every needle occurring in a text of the same key; empty needles occur in none.

    Needles meet texts by their rarest gram (``candidates``). What meets is compared in full. Texts and needles
    travel by hash until then.
    """
    met = candidates(texts, needles, key, text, needle)
    return met.join(_hashed(texts, key, text), ["_k", "_t1", "_t2"]).where(F.contains("_text", "_needle")).select(
        F.col("_k").alias(key), F.col("_text").alias(text), F.col("_needle").alias(needle)
    )
