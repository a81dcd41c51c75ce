"""From raw documents to token ids: five stages, each a step of the training-data operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, line_dedup, neardup, pieces, toxicity
from quillspark.llm.common import named, table
from quillspark.session import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train the chain on the labels and leave out the documents that it rejects."""
    chain = toxicity.train_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_chain(docs, chain).where(~F.col("rejected")).select(*named(docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one; a document that loses all its lines stays with an empty text."""
    done = line_dedup.dedup_lines(docs, n_lines="_n_lines", n_dropped="_n_dropped").select(*named(docs.columns))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five words, similarity 0.8 or more."""
    return neardup.without_near_duplicates(docs, shingle=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with the item's own parameters or others."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; the other columns stay."""
    return pieces.encode_documents(docs, MODEL)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_texts),
]

#: SQL can express neither the classifier nor the encoder; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
