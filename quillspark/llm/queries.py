"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import (
    collocations, decontamination, fingerprints, hard_negatives, licenses, line_dedup, neardup, pieces, sharding, token_counts, toxicity, url_rules, warc,
)
from quillspark.llm.common import table, whole

TOKENIZERS = "/opt/tokenizers"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train_chain(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_chain(docs, chain)
    return scored.select("doc_id", "p_low_quality", "p_toxic", "rejected")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether their decoding is that text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(whole("text"), 256).alias("text_sha256"))
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    back = pieces.decode_documents(pieces.encode_documents(docs, model), model)
    return back.select(
        "doc_id", "n_tokens", "score", "ids", F.length("text").cast("long").alias("n_chars"),
        (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), warc.archive_folder(spark))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.with_token_count(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return token_counts.length_histogram(counts)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by source, one of which holds a third of all rows, to 24 of even size."""
    n_old = 16
    old = F.pmod(F.xxhash64("source"), F.lit(n_old))
    shards = sharding.reshard(table(spark, sf_dir, "documents"), old, n_old, n_new=24)
    text = whole("text")
    return shards.select(
        "doc_id", (F.octet_length(text) + sharding.ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_report(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_toxicity, op3_fingerprints, op4_decontamination, op5_sentencepiece, op6_warc, op7_license_scan, op8_token_counts, op9_minhash,
        op10_sharding, op11_collocations, op12_url_filter, op13_hard_negatives,
    )
}
