"""Token counts: an exact histogram of encoded lengths, from which any context limit is answered.

Documents are encoded whole and reduced to their length at once; the histogram has one row per length that
occurs, and suffix sums over it say how many documents and tokens lie at or above each length. Totals,
quantiles and truncated totals for every limit follow from one row each.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, whole
from quillspark.session import materialize

# Fixed value: the public pattern that parts a text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTHS_PER_BUCKET = 4096


def rank_file_encoder(path: str, pattern: str = SPLIT_PATTERN) -> Callable[[str], list[int]]:
    """Encoder of a byte-level rank file (one base64 token and its rank a line); no special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def with_token_count(
    docs: DataFrame, vocabulary: str, pattern: str = SPLIT_PATTERN, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row; the whole text is encoded, null counts as empty (0 tokens).

    ``vocabulary`` is the path of a rank file that every executor can open.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_file_encoder(vocabulary, pattern)
        for batch in batches:
            lengths = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).mapInArrow(
        count, f"doc_id {id_type}, n_tokens bigint"
    )


def length_histogram(counts: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, with suffix sums; an empty table gives no rows.

    * ``n_docs``, ``total_tokens``: documents of exactly this length, and their tokens.
    * ``docs_at_least``, ``tokens_at_least``: documents of this length or more, and their tokens.
    * ``truncated_total``: tokens left if every document is cut to this length.
    * ``quantile_from``, ``quantile_to``: the range of quantiles (0 to 1] that this length answers.

    Lengths are taken in buckets of ``LENGTHS_PER_BUCKET``, so no window sees more rows than that, or than the
    longest document has buckets; the bucket totals that are broadcast are as few.
    """
    # stored: what follows reads it three times, and the texts would be encoded as often
    exact = materialize(counts.groupBy(F.col(n_tokens).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")).select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("total_tokens"),
        F.floor(F.col("n_tokens") / LENGTHS_PER_BUCKET).alias("_bucket"),
    ))
    above = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0))
    buckets = exact.groupBy("_bucket").agg(F.sum("n_docs").alias("_d"), F.sum("total_tokens").alias("_t")).select(
        "_bucket",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_d_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t_above"),
        F.sum("_d").over(everywhere).alias("_docs"), F.sum("_t").over(everywhere).alias("_tokens"),
    )
    onward = Window.partitionBy("_bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = exact.join(F.broadcast(buckets), "_bucket").select(
        "n_tokens", "n_docs", "total_tokens", "_docs", "_tokens",
        (F.sum("n_docs").over(onward) + F.col("_d_above")).alias("docs_at_least"),
        (F.sum("total_tokens").over(onward) + F.col("_t_above")).alias("tokens_at_least"),
    )
    below = F.col("_docs") - F.col("docs_at_least")
    return sums.select(
        "n_tokens", "n_docs", "total_tokens", "docs_at_least", "tokens_at_least",
        (F.col("_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        (below / F.col("_docs")).alias("quantile_from"),
        ((below + F.col("n_docs")) / F.col("_docs")).alias("quantile_to"),
    )


def truncated_totals(histogram: DataFrame, limits: DataFrame, limit: str = "context_limit") -> DataFrame:
    """Tokens left and documents cut for each row of ``limits``, from the histogram alone.

    Documents longer than the limit are those at or above the next length that occurs; a bucket join finds it
    without comparing every limit with every length. Limits below 0 count as 0; null limits give no row.
    """
    wanted = limits.select(F.col(limit).alias("_limit")).where("_limit is not null").distinct().select(
        "_limit", (F.greatest(F.col("_limit"), F.lit(0)) + 1).alias("_least")
    )
    ladder = histogram.select("n_tokens", "total_tokens", "docs_at_least", "tokens_at_least")
    merged = wanted.select(F.col("_least").alias("_at"), "_limit").unionByName(
        ladder.select(F.col("n_tokens").alias("_at"), F.struct("docs_at_least", "tokens_at_least").alias("_next"), "total_tokens"),
        allowMissingColumns=True,
    ).withColumn("_bucket", F.floor(F.col("_at") / LENGTHS_PER_BUCKET))
    here = Window.partitionBy("_bucket").orderBy(F.col("_at")).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = merged.groupBy("_bucket").agg(
        F.min_by("_next", F.when(F.col("_next").isNotNull(), F.col("_at"))).alias("_head"), F.sum("total_tokens").alias("_t"),
    ).select(
        "_bucket", F.last("_head", ignorenulls=True).over(later).alias("_beyond"),
        F.coalesce(F.sum("_t").over(Window.partitionBy(F.lit(0))), F.lit(0)).alias("_tokens"),
    )
    found = merged.withColumn("_found", F.first("_next", ignorenulls=True).over(here)).where("_next is null")
    over = F.coalesce("_found", "_beyond")
    cut = F.coalesce(over["docs_at_least"], F.lit(0))
    return (
        found.join(F.broadcast(heads), "_bucket")
        .select(
            F.col("_limit").alias(limit), cut.alias("docs_cut"),
            (F.col("_tokens") - F.coalesce(over["tokens_at_least"], F.lit(0)) + F.greatest("_limit", F.lit(0)) * cut).alias("tokens_left"),
        )
    )
