"""Cohen's kappa: overall, per group, and over a trailing window."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.labels import FIELD_TRANSFORMS, TARGET_COMBINATIONS, json_path, matches_combination
from quillspark.operators.ordered import rolling_blocks


def _kappa(n: Column, agree: Column, marginal: Column) -> Column:
    """(po - pe) / (1 - pe) in whole counts; null when both raters always give one and the same value."""
    return F.try_divide((n * agree - marginal).cast("double"), (n * n - marginal).cast("double"))


def kappa(ratings: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Kappa of two rating columns per key, from category counts (map-side combined, no group is collected)."""
    long = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    same = F.col(a) == F.col(b)
    votes = long.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col(a).cast("string").alias("category"), F.col("_rows").alias("in_a"),
                    F.lit(0).cast("long").alias("in_b"), F.when(same, F.col("_rows")).otherwise(0).alias("agree"),
                ),
                F.struct(
                    F.col(b).cast("string").alias("category"), F.lit(0).cast("long").alias("in_a"),
                    F.col("_rows").alias("in_b"), F.lit(0).cast("long").alias("agree"),
                ),
            )
        ).alias("v"),
    ).select(*keys, "v.*")
    per_category = votes.groupBy(*keys, "category").agg(
        F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"), F.sum("agree").alias("agree")
    )
    totals = per_category.groupBy(*keys).agg(
        F.sum("in_a").alias("n"), F.sum("agree").alias("agree"), F.sum(F.col("in_a") * F.col("in_b")).alias("m")
    )
    return totals.select(*keys, "n", _kappa(F.col("n"), F.col("agree"), F.col("m")).alias("kappa"))


def rolling_kappa(
    ratings: DataFrame,
    window: int = 50,
    order: Sequence[str] = ("created_at", "doc_id"),
    a: str = "a",
    b: str = "b",
    field: str = "field",
    drop_missing: bool = True,
) -> DataFrame:
    """Kappa over the last ``window`` rows at each row, separately per ``field``.

    The frame grows from one row up to ``window``. Order ties are broken by the last order column. Each block of rows
    keeps running counts, so the cost of a row does not grow with the window.
    """
    rows = ratings.select(field, *order, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b"))
    if drop_missing:
        rows = rows.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    spread, _ = rolling_blocks(rows, [field], order, window)
    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("_n", "_agree", "_marginal")])

    def count(block: pa.Table) -> pa.Table:
        block = block.sort_by("_pos")
        both = pa.concat_arrays([x for c in ("_a", "_b") for x in block[c].chunks])
        codes = pc.dictionary_encode(both, null_encoding="encode").indices.to_numpy().astype(np.int64)
        for name, values in zip(counts.names, rolling_counts(codes[: len(block)], codes[len(block) :], window), strict=True):
            block = block.append_column(name, pa.array(values, pa.int64()))
        return block.filter(pc.invert(block["_halo"]))

    seen = spread.groupBy(field, "_block").applyInArrow(count, T.StructType([*spread.schema.fields, *counts.fields]))
    return seen.select(*order, _kappa(F.col("_n"), F.col("_agree"), F.col("_marginal")).alias("kappa"), F.col("_n").cast("int").alias("n"), field)


def rolling_counts(a: np.ndarray, b: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the size of its window, how often both raters agree in it, and the sum of their marginal products.

    That sum is the number of pairs of rows in the window where one rater's value is the other's. A row that enters adds its
    pairs with the rows before it in the window, one that leaves takes away those with the rows after it; both are
    counted in the sorted places of each value, and running sums do the rest.
    """
    rows = len(a)
    at = np.arange(rows)
    places = [np.sort(x * rows + at) for x in (a, b)]

    def times(side: int, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        keys = places[side]
        return np.searchsorted(keys, value * rows + last, side="right") - np.searchsorted(keys, value * rows + first)

    low, high = np.maximum(at - window + 1, 0), np.minimum(at + window - 1, rows - 1)
    enters = np.cumsum(times(1, a, low, at) + times(0, b, low, at) - (a == b))
    leaves = np.concatenate([[0], np.cumsum(times(1, a, at, high) + times(0, b, at, high) - (a == b))])
    agree = np.concatenate([[0], np.cumsum(a == b)])
    return at - low + 1, agree[at + 1] - agree[low], enters - leaves[low]


def label_field_ratings(
    pairwise: DataFrame,
    fields: Sequence[str],
    transforms: Mapping[str, Callable[[Column], Column]] | None = None,
    combinations: Sequence[tuple[bool, ...]] | None = TARGET_COMBINATIONS,
) -> DataFrame:
    """Rating pairs ``(doc_id, created_at, field, a, b)`` of several label fields in one pass.

    ``pairwise`` holds ``a_label_json`` and ``b_label_json``. With ``combinations`` both labels must pass.
    """
    chosen = {**FIELD_TRANSFORMS, **(transforms or {})}
    if combinations is not None:
        pairwise = pairwise.where(
            matches_combination("a_label_json", combinations) & matches_combination("b_label_json", combinations)
        )

    def pair(field: str) -> Column:
        change = chosen.get(field, lambda x: x)
        return F.struct(
            F.lit(field).alias("field"),
            change(json_path("a_label_json", field)).alias("a"),
            change(json_path("b_label_json", field)).alias("b"),
        )

    one_each = F.explode(F.array(*[pair(f) for f in fields])).alias("r")
    return pairwise.select("doc_id", "created_at", one_each).select("doc_id", "created_at", "r.*")


def rolling_kappa_for_fields(
    pairwise: DataFrame,
    fields: Sequence[str],
    window: int = 50,
    transforms: Mapping[str, Callable[[Column], Column]] | None = None,
    drop_missing: bool = True,
    combinations: Sequence[tuple[bool, ...]] | None = TARGET_COMBINATIONS,
) -> DataFrame:
    """Rolling kappa of several dotted label fields; an empty input keeps the four columns."""
    ratings = label_field_ratings(pairwise, fields, transforms, combinations)
    return rolling_kappa(ratings, window, drop_missing=drop_missing).select("created_at", "kappa", "n", "field", "doc_id")
