"""Token usage of labeler calls: per-call columns, summed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import percent

COUNTERS = ("input_tokens", "output_tokens", "cached_input_tokens", "cached_output_tokens")


def usage_summary(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Token sums, call counts and cache hit rate of calls with the four counters and ``from_cache``."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]
    total, cached = F.count(F.lit(1)), F.count_if("from_cache")
    out = calls.groupBy(*keys).agg(*sums, total.alias("total_calls"), cached.alias("cached_calls"))
    return out.select(
        *keys, *COUNTERS, (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "total_calls",
        "cached_calls", F.coalesce(percent(F.col("cached_calls"), F.col("total_calls")), F.lit("0%")).alias("cache_hit_rate"),
    )
