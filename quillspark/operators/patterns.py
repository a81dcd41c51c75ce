"""Learned patterns: similarity, grouping, merging, evolution and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import jaccard, name_similarity, normalize_name, overlap, word_set, words
from quillspark.operators.ordered import moving_average, with_position
from quillspark.operators.seeds import better_later, candidates, greedy_seeds, jaccard_prefixes, plain, prefix_tokens
from quillspark.operators.substrings import substring_pairs
from quillspark.session import materialize


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(item_a, item_b, similarity)`` of token sets with word Jaccard of at least ``threshold``.

    Identical sets are taken as one, by the smallest item; ``same_sets`` says which items that are.
    """
    distinct = (
        sets.select("item", F.array_sort("tokens").alias("tokens")).where(F.size("tokens") > 0)
        .groupBy("tokens").agg(F.min("item").alias("item"))
    )
    rare = jaccard_prefixes(distinct, threshold).withColumnRenamed("token", "bucket")
    pairs = candidates(rare, rare, threshold).select(F.col("early").alias("item_a"), F.col("late").alias("item_b")).distinct()
    a = distinct.select(F.col("item").alias("item_a"), F.col("tokens").alias("_a"))
    b = distinct.select(F.col("item").alias("item_b"), F.col("tokens").alias("_b"))
    return (
        pairs.join(a, "item_a").join(b, "item_b")
        .select("item_a", "item_b", jaccard(F.col("_a"), F.col("_b")).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def same_sets(sets: DataFrame) -> DataFrame:
    """``(item, first_item)``: the items that ``similar_sets`` takes as one, with the smallest of them; empty sets drop out.

    Pairs of one group are not listed: a popular set would give as many as the square of its items.
    """
    filled = sets.select("item", F.array_sort("tokens").alias("tokens")).where(F.size("tokens") > 0)
    first = filled.groupBy("tokens").agg(F.min("item").alias("first_item"))
    return filled.join(first, "tokens").select("item", "first_item")


def match_rank(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """How well a new pattern fits an existing one: 2 for the same name, else the combined score, else null.

    Fits when names are at least 0.8 similar, or names 0.5 and descriptions 0.6; combined = 0.7 name + 0.3
    description. Both sides give ``name``, ``name_words`` and ``description_words``.
    """
    by_name = name_similarity(new["name"], old["name"], new["name_words"], old["name_words"])
    by_desc = jaccard(new["description_words"], old["description_words"])
    fits = (by_name >= 0.8) | ((by_name >= 0.5) & (by_desc >= 0.6))
    return F.when(new["name"] == old["name"], F.lit(2.0)).when(fits, by_name * 0.7 + by_desc * 0.3)


def group_similar(cases: DataFrame) -> DataFrame:
    """``(seq, pattern_seq)``: the pattern each case creates or joins, taken in ``seq`` order.

    ``cases`` has ``seq, pattern_name, description``. Of equal (name, description) cases only the first enters the
    search: the others create nothing, and join what it joined or a better pattern created since; cases with an
    equal name always join that name's pattern.
    """
    named = cases.select("seq", normalize_name(F.col("pattern_name")).alias("name"),
                         F.coalesce("description", F.lit("")).alias("description"))
    items = named.groupBy("name", "description").agg(F.min("seq").alias("item"))
    token_sets = items.select("item", word_set(F.col("name")).alias("tokens")).where(F.size("tokens") > 0)
    shared_word = jaccard_prefixes(token_sets, 0.5).select(
        "item", F.concat(F.lit("w:"), "token").alias("bucket"), "held", "size", "rest"
    )
    # Equal names share a bucket, and so do a name and those that contain it; containment counts from a length
    # ratio of 0.5 on.
    names = items.select(F.lit(0).alias("all"), "name", F.col("name").alias("inner")).distinct()
    contained = substring_pairs(names.select("all", "name"), names.select("all", "inner"), "all", "name", "inner").where(
        (F.col("name") != F.col("inner")) & (F.length("inner") * 2 >= F.length("name"))
    )
    own = items.select("item", F.concat(F.lit("s:"), "name").alias("bucket"))
    outer = items.join(contained, "name").select("item", F.concat(F.lit("s:"), "inner").alias("bucket"))
    buckets = shared_word.unionByName(plain(own.unionByName(outer)))

    columns = ("name", "name_words", "description_words")

    def verify(early: str, late: str) -> Column:
        return match_rank({c: F.col(late + c) for c in columns}, {c: F.col(early + c) for c in columns})

    worded = items.select(
        "item", "name", word_set(F.col("name")).alias("name_words"), word_set(F.col("description")).alias("description_words")
    )
    buckets = materialize(buckets)
    seeds = materialize(greedy_seeds(worded, buckets, verify, threshold=0.5))
    later = better_later(worded, buckets, seeds, verify, threshold=0.5)
    found = items.join(seeds, "item").join(later, "item", "left").select("name", "description", "seed", "later")
    passed = F.filter("later", lambda s: s["after"] < F.col("seq"))
    return named.join(found, ["name", "description"]).select(
        "seq", F.coalesce(F.try_element_at(passed, F.lit(-1))["seed"], "seed").alias("pattern_seq"))


def evolve(examples: DataFrame, order: Sequence[str], key: str = "pattern_id") -> DataFrame:
    """Confidence (moving average of 0.8 old + 0.2 new) and usage count of each pattern after its examples."""
    return moving_average(examples, [key], order, "confidence_score", keep=0.8, name="confidence_score")


def distinct_examples(examples: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Each pattern's example documents as rows; one array per pattern would not fit a hot pattern."""
    return examples.select(key, "doc_id").distinct()


def create_patterns(cases: DataFrame) -> DataFrame:
    """Patterns from cases ``(seq, pattern_name, description, doc_id, confidence_score)`` in ``seq`` order.

    A case similar to an earlier pattern becomes one of its examples instead of a new pattern.
    """
    grouped = cases.join(group_similar(cases), "seq")
    confidence = evolve(grouped, ["seq"], "pattern_seq")
    documents = distinct_examples(grouped, "pattern_seq").groupBy("pattern_seq").agg(
        F.count(F.lit(1)).alias("example_count")
    )
    heads = cases.select(F.col("seq").alias("pattern_seq"), "pattern_name", "description")
    return heads.join(confidence, "pattern_seq").join(documents, "pattern_seq")


def statistics(patterns: DataFrame) -> DataFrame:
    """One row: pattern count, examples, mean confidence and mean usage; zeros when there are none."""
    return patterns.agg(
        F.count(F.lit(1)).alias("total_patterns"),
        F.coalesce(F.sum("example_count"), F.lit(0)).alias("total_examples"),
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg("usage_count"), F.lit(0.0)).alias("avg_usage"),
    )


def by_usage(patterns: DataFrame) -> DataFrame:
    """Patterns, most used first, in insertion order among equals."""
    return patterns.orderBy(F.col("usage_count").desc(), "pattern_seq")


def pattern_by_id(patterns: DataFrame, pattern_id: str) -> DataFrame:
    return patterns.where(F.col("pattern_id") == pattern_id)


def pattern_for_label(patterns: DataFrame, name: str) -> DataFrame:
    """First pattern with exactly this name."""
    return patterns.where(F.col("pattern_name") == name).orderBy("pattern_seq").limit(1)


# Extracted patterns ---------------------------------------------------------------------------------


def merge_words(name: Column) -> Column:
    return F.array_distinct(words(F.replace(F.lower(name), F.lit("_"), F.lit(" "))))


def merge_groups(found: DataFrame) -> DataFrame:
    """``(pattern, seed)``: extracted patterns grouped with the first similar seed of their category.

    Similar: same category and more than 0.6 of the larger name's words shared, or more than 0.5 of the
    larger indicator set. Patterns equal in all three act as one.
    """
    shaped = found.select(
        "pattern", F.col("pattern_category").alias("category"),
        F.array_sort(merge_words(F.col("pattern_name"))).alias("name_words"),
        F.array_sort(F.array_distinct("code_indicators")).alias("indicators"),
    )
    same = ["category", "name_words", "indicators"]
    # Two patterns with neither words nor indicators do not match even when equal.
    bare = (F.size("name_words") == 0) & (F.size("indicators") == 0)
    items = shaped.withColumn("_own", F.when(bare, F.col("pattern"))).groupBy(*same, "_own").agg(
        F.min("pattern").alias("item")
    )

    def side(tag: str, column: str, threshold: float) -> DataFrame:
        sets = items.select("item", "category", F.col(column).alias("tokens")).where(F.size("tokens") > 0)
        rare = prefix_tokens(sets, F.floor(F.size("tokens") * F.lit(threshold)) + 1, "category")
        return rare.select("item", F.to_json(F.struct(F.lit(tag).alias("t"), "category", "token")).alias("bucket"))

    def verify(early: str, late: str) -> Column:
        similar = (
            overlap(F.col(early + "name_words"), F.col(late + "name_words")) > 0.6
        ) | (overlap(F.col(early + "indicators"), F.col(late + "indicators")) > 0.5)
        alike = F.col(early + "category").eqNullSafe(F.col(late + "category")) & similar
        return F.when(alike, F.lit(1.0))

    buckets = side("n", "name_words", 0.6).unionByName(side("i", "indicators", 0.5))
    seeds = greedy_seeds(items.select("item", *same), buckets, verify)
    own = items.join(seeds, "item")
    keyed = shaped.withColumn("_own", F.when(bare, F.col("pattern")))
    on = [keyed[c].eqNullSafe(own[c]) for c in [*same, "_own"]]
    return keyed.join(own, on).select(keyed["pattern"], own["seed"])


def merge_similar(found: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged patterns and their distinct example references.

    The most confident member names the group (first on ties); confidence is the mean. Features,
    indicators and references stay tables of rows until a caller needs arrays.
    """
    groups = merge_groups(found)
    members = found.join(groups, "pattern")
    base = F.max_by(
        F.struct("pattern_name", "pattern_description", "pattern_category"),
        F.struct(F.col("confidence_score"), -F.col("pattern")),
    )
    merged = members.groupBy("seed").agg(
        base.alias("b"), F.avg("confidence_score").alias("confidence_score"), F.count(F.lit(1)).alias("members")
    ).select("seed", "b.*", "confidence_score", "members")
    refs = references.join(groups, "pattern").select("seed", "file_path", "doc_id", "project")
    refs = refs.groupBy("seed", "file_path", "doc_id").agg(F.max("project").alias("project"))
    counts = refs.groupBy("seed").agg(F.count(F.lit(1)).alias("example_count"))
    features = members.select("seed", F.explode("distinguishing_features").alias("v")).distinct().groupBy("seed").agg(
        F.sort_array(F.collect_list("v")).alias("distinguishing_features")
    )
    indicators = members.select("seed", F.explode("code_indicators").alias("v")).distinct().groupBy("seed").agg(
        F.sort_array(F.collect_list("v")).alias("code_indicators")
    )
    empty = F.array().cast("array<string>")
    out = merged.join(counts, "seed", "left").join(features, "seed", "left").join(indicators, "seed", "left").select(
        *merged.columns,
        F.coalesce("example_count", F.lit(0)).alias("example_count"),
        F.coalesce("distinguishing_features", empty).alias("distinguishing_features"),
        F.coalesce("code_indicators", empty).alias("code_indicators"),
    )
    return out, refs


def resolve_examples(found: DataFrame, examples: DataFrame) -> DataFrame:
    """References of extracted patterns: 1-based indices within a chunk to examples, out of range dropped.

    ``found`` has ``pattern, chunk, example_indices``; ``examples`` has ``chunk, index_in_chunk``.
    """
    wanted = found.select("pattern", "chunk", F.posexplode("example_indices").alias("ref", "index_in_chunk"))
    return wanted.withColumn("index_in_chunk", F.col("index_in_chunk").cast("long")).join(
        examples, ["chunk", "index_in_chunk"]
    ).select("pattern", "ref", F.col("source").alias("file_path"), "doc_id", "project")


def resolve_consolidated(consolidated: DataFrame, inputs: DataFrame, references: DataFrame) -> DataFrame:
    """References of consolidated patterns: the distinct references of the 1-based inputs of their chunk that they cite.

    ``consolidated`` has ``pattern, chunk, example_indices``; ``inputs`` has ``seed, chunk, index_in_chunk``.
    """
    cited = consolidated.select("pattern", "chunk", F.explode(F.col("example_indices").cast("array<long>")).alias("index_in_chunk")).distinct()
    return (
        cited.join(inputs.select("seed", "chunk", "index_in_chunk"), ["chunk", "index_in_chunk"]).join(references, "seed")
        .groupBy("pattern", "file_path", "doc_id").agg(F.max("project").alias("project"))
    )
