"""Small helpers of the operators: Arrow batch limits, row keys, task shapes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: a batch of very long texts would not fit a Python worker by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: Iterable[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unpacked(struct: str, columns: Iterable[str]) -> list[Column]:
    """The columns of these names out of a struct that carries a caller's row, so that no helper column can clash with them."""
    return [F.col(struct).getField(c).alias(c) for c in columns]


def whole(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(named([text])[0] if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the fast built-in way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def key128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: equal for equal values, and otherwise never equal in practice."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
