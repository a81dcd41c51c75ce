"""Ordered greedy grouping as joins.

The semantics: walk items in order; an item joins a seed it matches among those seen before, or becomes
a seed itself. An item is therefore a seed exactly when no earlier seed matches it.

First every bucket's ``front`` items are compared with the bucket's members: a bucket of mutual matches costs
members x front comparisons and collapses at once. What is still open afterwards matches few others; its match
edges are verified once, and the rest is decided on that small table. An item with one open earlier neighbour is
a seed exactly when that neighbour is not, so chains of such items are followed by pointer doubling, and a chain
of n items takes log n steps. Each phase settles all items without open earlier neighbours and all chains that
hang on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

Verify = Callable[[str, str], Column]
DOUBLINGS = 4  # pointer doublings in one stored table


def candidates(early: DataFrame, late: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``(early, late)`` of bucket rows (``item, bucket, held, size, rest``) that share a bucket, the earlier item first.

    The smaller set of a pair must hold the bucket. Two sets of ``threshold`` Jaccard share at least
    threshold / (1 + threshold) of their sizes' sum, the first shared token and at most the shorter ``rest``. Rows of
    size 0 are no sets and meet all others.
    """
    left, right = (df.select("bucket", *[F.col(c).alias(f"{tag}_{c}") for c in ("item", "held", "size", "rest")]) for df, tag in ((early, "e"), (late, "l")))
    smaller_first = left.where("e_held").join(right, "bucket").where("e_item < l_item AND e_size <= l_size")
    larger_first = left.where("e_size > 0").join(right.where("l_held AND l_size > 0"), "bucket").where("e_item < l_item AND l_size < e_size")
    small, large = F.least("e_size", "l_size"), F.greatest("e_size", "l_size")
    least = F.ceil((small + large) * (threshold / (1.0 + threshold)) - 1e-9)
    fits = (small == 0) | ((small >= large * F.lit(threshold) - 1e-9) & (F.least("e_rest", "l_rest") + 1 >= least))
    return smaller_first.unionByName(larger_first).where(fits).select(F.col("e_item").alias("early"), F.col("l_item").alias("late"))


def _matches(items: DataFrame, early: DataFrame, late: DataFrame, verify: Verify, threshold: float) -> DataFrame:
    """Verified ``(early, late, rank)`` of bucket rows that share a bucket, the earlier item first."""
    pairs = candidates(early, late, threshold).distinct()
    left = items.select(*[F.col(c).alias(f"l_{c}") for c in items.columns])
    right = items.select(*[F.col(c).alias(f"r_{c}") for c in items.columns])
    return (
        pairs.join(left, F.col("early") == F.col("l_item")).join(right, F.col("late") == F.col("r_item"))
        .select("early", "late", verify("l_", "r_").cast("double").alias("rank")).where("rank IS NOT NULL")
    )


def _chains(single: DataFrame) -> DataFrame:
    """``(item, anc, flip)`` of items with one open earlier neighbour: the first one up the chain that has not.

    ``flip``: whether the item is a seed exactly when ``anc`` is not.
    """
    at = materialize(single.select("item", "anc", F.lit(True).alias("flip")))

    def ended() -> bool:
        return at.join(at.select(F.col("item").alias("anc")), "anc", "left_semi").isEmpty()

    while not ended():
        step = at
        for _ in range(DOUBLINGS):
            up = step.select(F.col("item").alias("anc"), F.col("anc").alias("_a"), F.col("flip").alias("_f"))
            step = step.join(up, "anc", "left").select(
                "item", F.coalesce("_a", "anc").alias("anc"),
                F.when(F.col("_a").isNull(), F.col("flip")).otherwise(F.col("flip") != F.col("_f")).alias("flip"),
            )
        at = materialize(step)
    return at


def _decide(open_items: DataFrame, deps: DataFrame) -> DataFrame:
    """``(item, is_seed)`` of the open items, from ``deps`` = (late, early) matches among them."""
    spark = open_items.sparkSession
    decided = spark.createDataFrame([], "item long, is_seed boolean")
    while not open_items.isEmpty():
        parents = deps.groupBy(F.col("late").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.min("early").alias("anc"))
        roots = open_items.join(parents.select("item"), "item", "left_anti")
        chains = _chains(parents.where("n = 1"))
        hanging = chains.join(roots.withColumnRenamed("item", "anc"), "anc", "left_semi")
        known = roots.select("item", F.lit(True).alias("is_seed")).unionByName(
            hanging.select("item", (~F.col("flip")).alias("is_seed"))
        )
        seeds = known.where("is_seed").select(F.col("item").alias("early"))
        covered = deps.join(seeds, "early", "left_semi").select(F.col("late").alias("item")).distinct().join(
            known.select("item"), "item", "left_anti"
        )
        settled = materialize(known.unionByName(covered.select("item", F.lit(False).alias("is_seed"))))
        decided = decided.unionByName(settled)
        gone = settled.select("item")
        open_items = materialize(open_items.join(gone, "item", "left_anti"))
        deps = materialize(
            deps.join(gone.withColumnRenamed("item", "late"), "late", "left_anti")
            .join(gone.withColumnRenamed("item", "early"), "early", "left_anti")
        )
    return decided


def greedy_seeds(items: DataFrame, buckets: DataFrame, verify: Verify, front: int = 16, threshold: float = 0.0) -> DataFrame:
    """``(item, seed)`` for every item; a seed is its own seed.

    ``items`` has a unique, ordered long ``item`` plus whatever ``verify`` reads. ``buckets`` is
    ``(item, bucket)``: any two matching items must share a bucket. ``verify(left, right)`` gets the
    aliases of the earlier and the later item and returns their match rank, or null when they do not
    match; an item joins the matching seed of highest rank, then the earliest. Buckets that come from
    ``jaccard_prefixes`` with this ``threshold`` meet only where that allows a match.
    """
    if "held" not in buckets.columns:
        buckets = plain(buckets)
    buckets = materialize(buckets.select("item", "bucket", "held", "size", "rest").distinct())
    ordered = Window.partitionBy("bucket").orderBy("item")
    lead = buckets.withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") <= front).drop("_r")
    # An item in the front of all its buckets sees all its earlier matches.
    complete = (
        buckets.groupBy("item").agg(F.count(F.lit(1)).alias("_all"))
        .join(lead.groupBy("item").agg(F.count(F.lit(1)).alias("_in")), "item").where("_all = _in").select("item")
    )
    matched = materialize(_matches(items, lead, buckets, verify, threshold))
    blocked = matched.select(F.col("late").alias("item")).distinct()
    # An item without buckets can match nothing.
    alone = items.select("item").join(buckets, "item", "left_anti")
    seeds = materialize(complete.join(blocked, "item", "left_anti").unionByName(alone))
    won = matched.join(seeds.withColumnRenamed("item", "early"), "early", "left_semi")

    rest = items.select("item").join(seeds, "item", "left_anti")
    open_items = materialize(rest.join(won.select(F.col("late").alias("item")), "item", "left_anti"))
    edges = materialize(_matches(
        items, buckets.join(open_items, "item", "left_semi"), buckets.join(rest, "item", "left_semi"), verify, threshold
    ))
    deps = edges.join(open_items.withColumnRenamed("item", "late"), "late", "left_semi").select("late", "early")
    decided = materialize(_decide(open_items, deps))
    later = decided.where("is_seed").select("item")
    every = won.unionByName(edges.join(later.withColumnRenamed("item", "early"), "early", "left_semi"))
    joined = every.groupBy(F.col("late").alias("item")).agg(F.max(F.struct("rank", (-F.col("early")).alias("back")))["back"].alias("_b"))
    own = seeds.unionByName(later).select("item", F.col("item").alias("seed"))
    return own.unionByName(
        joined.join(own, "item", "left_anti").select("item", (-F.col("_b")).alias("seed"))
    )


def better_later(items: DataFrame, buckets: DataFrame, seeds: DataFrame, verify: Verify, threshold: float = 0.0) -> DataFrame:
    """``(item, later)``: what a repetition of an item joins when it comes after a better seed than the item's own.

    ``seeds`` is what ``greedy_seeds`` gave for the same ``items`` and ``buckets``; an item never becomes a seed when it
    comes again, but may match a seed found since. ``later`` lists ``(after, seed)`` in order, at most one for each
    value of the rank: a repetition joins the last ``seed`` with ``after`` before it. Items without such seeds are left out.
    """
    joined = seeds.where("item <> seed")
    own = joined.join(items.select(*[F.col(c).alias(f"l_{c}") for c in items.columns]), F.col("seed") == F.col("l_item")).join(
        items.select(*[F.col(c).alias(f"r_{c}") for c in items.columns]), F.col("item") == F.col("r_item")
    ).select("item", verify("l_", "r_").cast("double").alias("_own"))
    if "held" not in buckets.columns:
        buckets = plain(buckets)
    heads = seeds.where("item = seed").select("item")
    # Here the joining item is the earlier one of a pair.
    found = _matches(
        items, buckets.join(joined, "item", "left_semi"), buckets.join(heads, "item", "left_semi"), verify, threshold
    ).select(F.col("early").alias("item"), F.col("late").alias("seed"), "rank").join(own, "item").where("rank > _own")
    so_far = Window.partitionBy("item").orderBy("seed").rowsBetween(Window.unboundedPreceding, -1)
    best = found.withColumn("_top", F.max("rank").over(so_far)).where("_top IS NULL OR rank > _top")
    return best.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("seed").alias("after"), "seed"))).alias("later"))


def plain(buckets: DataFrame) -> DataFrame:
    """Bucket rows that meet all others of their bucket."""
    return buckets.select("item", "bucket", F.lit(True).alias("held"), F.lit(0).alias("size"), F.lit(0).alias("rest"))


def jaccard_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(item, token, held, size, rest)``: prefixes of each set, rarest tokens first, for a self-join of ``threshold`` Jaccard.

    A set of size s shares at least ``threshold * s`` tokens with a larger or smaller match, so one of its
    ``s - ceil(threshold * s) + 1`` rarest is shared. With a match at least as large it shares even
    ``2 * threshold / (1 + threshold) * s``: the fewer tokens that this needs are ``held``, the others only meet what
    smaller sets hold. A token that is common in all its sets is held by none, and makes no candidates at all.
    """
    tokens = sets.select("item", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    rare_first = Window.partitionBy("item").orderBy("_n", "token")
    ranked = tokens.join(rarity, "token").withColumn("_r", F.row_number().over(rare_first))
    upto = lambda share: F.col("size") - F.ceil(F.col("size") * F.lit(share) - 1e-9) + 1
    return ranked.where(F.col("_r") <= upto(threshold)).select(
        "item", "token", (F.col("_r") <= upto(2 * threshold / (1 + threshold))).alias("held"), "size", (F.col("size") - F.col("_r")).alias("rest"),
    )


def prefix_tokens(sets: DataFrame, min_shared: Column, group: str | None = None) -> DataFrame:
    """``(item, token)``: each set's rarest tokens, enough that any two qualifying sets share one.

    Exact prefix filter: with at least ``min_shared`` of its own tokens shared, a set of size s must share
    one of its ``s - min_shared + 1`` globally rarest tokens.
    """
    keys = [group] if group else []
    tokens = sets.select("item", *keys, F.size("tokens").alias("_size"), min_shared.alias("_min"),
                         F.explode("tokens").alias("token"))
    rarity = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("_n"))
    # Per-item window: a set is one record's tokens.
    rare_first = Window.partitionBy("item").orderBy("_n", "token")
    ranked = tokens.join(rarity, [*keys, "token"]).withColumn("_r", F.row_number().over(rare_first))
    return ranked.where(F.col("_r") <= F.col("_size") - F.col("_min") + 1).select("item", *keys, "token")
