"""Connected components of a table of links, by hooking and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize

DOUBLINGS = 3  # in one stored table


def _to_roots(parent: DataFrame) -> DataFrame:
    """``(a, p)`` with every node pointing to the root of its tree; a tree of depth d takes log d doublings."""
    at = materialize(parent)
    while True:
        above = at.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        if at.join(above, "p").where("pp <> p").isEmpty():
            return at
        for _ in range(DOUBLINGS):
            above = at.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            at = at.join(above, "p").select("a", F.col("pp").alias("p"))
        at = materialize(at)


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (columns ``a``, ``b``): the label is its smallest reachable node.

    In each round every node takes its smallest neighbour as parent if that is smaller, all nodes are led to the
    roots of the trees that this makes, and links are moved to the roots. A root has no smaller neighbour, so at
    least half of the nodes are gone after each round: n nodes take log n rounds. Nothing is collected; the
    driver asks only whether something is left. Links of nodes to themselves give single nodes.
    """
    edges = materialize(links.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")))
    while not edges.where("a <> b").isEmpty():
        both = edges.where("a <> b").union(edges.where("a <> b").select("b", "a"))
        roots = _to_roots(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        led = roots.select(F.col("a").alias("old"), F.col("p").alias("new"))
        labels = materialize(
            labels.join(led, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
        )
        first = roots.select("a", F.col("p").alias("na"))
        second = roots.select(F.col("a").alias("b"), F.col("p").alias("nb"))
        moved = edges.where("a <> b").join(first, "a").join(second, "b").where("na <> nb")
        edges = materialize(moved.select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct())
    return labels
