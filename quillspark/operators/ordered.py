"""Order-dependent operators without a single-task window.

A window over a whole table, or over one hot key, runs in one task. Here rows are range-partitioned on
``(keys, order)`` into segments of even size (the order must end in a unique column, so that equal
timestamps split too). Work happens inside segments, and only one small row per segment crosses a
border. At most one key spans each border, so every carry table below holds at most one row per
segment, which is the proven bound behind each ``broadcast``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

_ROW_BITS = (1 << 33) - 1


def ordered_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_seg`` (segment number, increasing in key/order) and ``_idx`` (0-based row in segment)."""
    cols = [*keys, *order]
    segments = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(segments, *cols).sortWithinPartitions(*cols)
    row = F.monotonically_increasing_id()
    return materialize(
        ranged.select("*", F.spark_partition_id().alias("_seg"), row.bitwiseAND(F.lit(_ROW_BITS)).alias("_idx"))
    )


def _spans(keys: Sequence[str], seg: DataFrame, *aggs: Column) -> DataFrame:
    """One row per (key, segment) of the keys found in more than one segment."""
    per = seg.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    everywhere = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return per.withColumn("_segs", F.count(F.lit(1)).over(everywhere)).where("_segs > 1").drop("_segs")


def _before(keys: Sequence[str]):
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return part.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def _join_carry(seg: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    on = F.col("s._seg") == F.col("c._seg")
    for key in keys:
        on = on & F.col(f"s.{key}").eqNullSafe(F.col(f"c.{key}"))
    kept = [c for c in carry.columns if c not in (*keys, "_seg")]
    return (
        seg.alias("s")
        .join(F.broadcast(carry).alias("c"), on, "left")
        .select("s.*", *[F.col(f"c.{c}") for c in kept])
    )


def _local(keys: Sequence[str]):
    return Window.partitionBy(*keys, "_seg").orderBy("_idx")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """1-based position of each row within its key (or the whole table), in ``order``."""
    seg = ordered_segments(df, keys, order)
    carry = _spans(keys, seg).select(
        *keys, "_seg", F.coalesce(F.sum("_rows").over(_before(keys)), F.lit(0)).alias("_off")
    )
    inside = F.row_number().over(_local(keys)) if keys else F.col("_idx") + 1
    numbered = seg.withColumn("_in", inside.cast("long"))
    joined = _join_carry(numbered, keys, carry)
    return joined.withColumn(name, F.col("_in") + F.coalesce("_off", F.lit(0))).drop("_in", "_off", "_seg", "_idx")


def chunked(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Fixed-size chunks in ``order``: ``chunk`` (0-based) and ``index_in_chunk`` (1-based)."""
    zero = F.col("position") - 1
    return with_position(df, [], order).select(
        *df.columns,
        F.floor(zero / size).cast("long").alias("chunk"),
        (zero % size + 1).cast("long").alias("index_in_chunk"),
    )


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in ``order``; Spark runs it as per-partition top-n, then a merge."""
    return df.orderBy(*order).limit(n)


def rolling_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], window: int, block_rows: int = 8192
) -> tuple[DataFrame, object]:
    """Rows arranged for a trailing window of ``window`` rows.

    Each key is cut into blocks; the last ``window - 1`` rows of a block are repeated in the next one
    (``_halo``), so a window partitioned by (key, block) sees exactly its rows. Returns the rows and the
    window; drop rows with ``_halo`` after evaluating.
    """
    size = max(block_rows, window)
    zero = F.col("_pos") - 1
    placed = with_position(df, keys, order, "_pos").withColumn("_home", F.floor(zero / size))
    tail = zero % size >= size - (window - 1)
    copies = F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    spread = placed.withColumn("_block", F.explode(copies)).withColumn("_halo", F.col("_block") != F.col("_home"))
    frame = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-(window - 1), 0)
    return spread, frame


def asof_backward(
    queries: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, query_id: str, fact_id: str, value: str
) -> DataFrame:
    """For each query the ``value`` of the last fact of the same key with ``at`` not after the query's.

    Facts and queries are merged into one ordered sequence, so a hot key costs no join and no pairs.
    """
    merged = facts.select(
        *keys, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.col(fact_id).cast("string").alias("_id"),
        F.struct(F.col(value).alias("v")).alias("_fact"),
    ).unionByName(
        queries.select(
            *keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(query_id).cast("string").alias("_id"),
        ),
        allowMissingColumns=True,
    )
    seg = ordered_segments(merged, keys, ["_at", "_kind", "_id"])
    last_here = F.max_by("_fact", F.when(F.col("_fact").isNotNull(), F.col("_idx"))).alias("_last")
    carry = _spans(keys, seg, last_here).select(
        *keys, "_seg", F.last("_last", ignorenulls=True).over(_before(keys)).alias("_carried")
    )
    upto = _local(keys).rowsBetween(Window.unboundedPreceding, 0)
    local = seg.withColumn("_seen", F.last("_fact", ignorenulls=True).over(upto))
    found = _join_carry(local.where("_kind = 1"), keys, carry)
    hit = F.coalesce("_seen", "_carried")
    return found.select(*keys, F.col("_at").alias(at), F.col("_id").alias(query_id), hit["v"].alias(value))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], expr: Column, name: str) -> DataFrame:
    """Largest value of ``expr`` from the key's first row to this one."""
    seg = ordered_segments(df.withColumn("_x", expr), keys, order)
    carry = _spans(keys, seg, F.max("_x").alias("_top")).select(
        *keys, "_seg", F.max("_top").over(_before(keys)).alias("_carried")
    )
    upto = _local(keys).rowsBetween(Window.unboundedPreceding, 0)
    local = seg.withColumn("_here", F.max("_x").over(upto))
    return (
        _join_carry(local, keys, carry)
        .withColumn(name, F.greatest("_here", "_carried"))
        .select(*df.columns, name)
    )


def moving_maps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, keep: float = 0.8) -> DataFrame:
    """What each key's rows, in ``order``, do to a moving average: ``(keys, rows, weighted, first)``.

    The update ``c = keep * c + (1 - keep) * value`` is an affine map, and affine maps compose: each segment reduces to
    its row count and its weighted sum, and the few per-key segments combine afterwards. A hot key is spread over segments.
    """
    seg = ordered_segments(df, keys, order)
    back = Window.partitionBy(*keys, "_seg").orderBy(F.col("_idx").desc())
    weighted = seg.withColumn("_w", F.pow(F.lit(keep), F.row_number().over(back) - 1))
    per = weighted.groupBy(*keys, "_seg").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(value) * F.col("_w")).alias("weighted"),
        F.min_by(value, "_idx").alias("first"),
    )
    return composed_maps(per, keys, "_seg", keep)


def composed_maps(maps: DataFrame, keys: Sequence[str], at: str, keep: float = 0.8) -> DataFrame:
    """One map per key from maps ``(keys, at, rows, weighted, first)`` that follow each other in the order of ``at``."""
    after = Window.partitionBy(*keys).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    later = maps.withColumn("_later", F.coalesce(F.sum("rows").over(after), F.lit(0)))
    return later.groupBy(*keys).agg(
        F.sum("rows").cast("long").alias("rows"),
        F.sum(F.col("weighted") * F.pow(F.lit(keep), F.col("_later"))).alias("weighted"),
        F.min_by("first", at).alias("first"),
    )


def averaged(maps: DataFrame, keys: Sequence[str], keep: float = 0.8, name: str = "confidence") -> DataFrame:
    """The average each map ends with when it starts at its key's first value, and ``usage_count``."""
    started = F.col("weighted") * (1 - keep) + F.col("first") * F.pow(F.lit(keep), F.col("rows"))
    return maps.select(*keys, started.alias(name), F.col("rows").alias("usage_count"))


def moving_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, keep: float = 0.8, name: str = "confidence"
) -> DataFrame:
    """Final value per key of ``c = keep * c + (1 - keep) * value``, started at the first value."""
    return averaged(moving_maps(df, keys, order, value, keep), keys, keep, name)
