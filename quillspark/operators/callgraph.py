"""Call graph: edges with resolved callees, adjacency, callers and callees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.symbols import SymbolTables
from quillspark.session import materialize


def unique_names(tables: SymbolTables) -> DataFrame:
    """Simple names that stand for exactly one qualified name in their project."""
    per = tables.functions.groupBy("project", "name").agg(
        F.min("qualified_name").alias("qualified_name"), F.max("qualified_name").alias("_last")
    )
    return per.where(F.col("qualified_name") == F.col("_last")).drop("_last")


def call_edges(tables: SymbolTables) -> DataFrame:
    """Distinct ``(project, src, dst)``; a callee's name becomes its qualified name only when unambiguous."""
    raw = tables.call_sites.select("project", F.col("function").alias("src"), F.col("method_name").alias("name")).distinct()
    return raw.join(unique_names(tables), ["project", "name"], "left").select(
        "project", "src", F.coalesce("qualified_name", "name").alias("dst")
    ).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Callees per node; nodes that call nothing have an empty list."""
    nodes = edges.select("project", F.col("dst").alias("node"), F.lit(None).cast("string").alias("callee"))
    out = edges.select("project", F.col("src").alias("node"), F.col("dst").alias("callee"))
    return out.unionByName(nodes).groupBy("project", "node").agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def callers(edges: DataFrame, callee: str) -> DataFrame:
    return edges.where(F.col("dst") == callee).select("project", F.col("src").alias("caller"))


def callees(edges: DataFrame, caller: str) -> DataFrame:
    return edges.where(F.col("src") == caller).select("project", F.col("dst").alias("callee"))


def hops(edges: DataFrame, starts: DataFrame, max_hops: int, direction: str = "callees") -> DataFrame:
    """``(project, start, node, hops)``: what is reached from each start in at most ``max_hops`` calls, at its least distance.

    ``starts`` is ``(project, start)``; ``direction`` says whether ``callees`` or ``callers`` are followed. A step goes from
    the nodes that the last one reached first: a node is left out for a start that has it already, so cycles end and
    a hub is entered once for each start. Steps are stored; equal edges and starts count once. A start is reached
    by itself in 0 hops, whether it has edges or not.
    """
    here, there = ("src", "dst") if direction == "callees" else ("dst", "src")
    steps = materialize(edges.select("project", F.col(here).alias("node"), F.col(there).alias("next")).distinct())
    reached = materialize(starts.select("project", "start").distinct().select("*", F.col("start").alias("node"), F.lit(0).alias("hops")))
    edge_of = reached
    for step in range(1, max_hops + 1):
        further = edge_of.join(steps, ["project", "node"]).select("project", "start", F.col("next").alias("node")).distinct()
        edge_of = materialize(further.join(reached, ["project", "start", "node"], "left_anti").withColumn("hops", F.lit(step)))
        if edge_of.isEmpty():
            break
        reached = reached.unionByName(edge_of)
    return reached


def call_graph(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """Edges ``(project, start, src, dst)`` among the nodes within ``max_hops`` calls of each start, in either direction."""
    near = hops(edges, starts, max_hops).unionByName(hops(edges, starts, max_hops, "callers")).select("project", "start", "node").distinct()
    inside = edges.join(near.withColumnRenamed("node", "src"), ["project", "src"])
    return inside.join(near.withColumnRenamed("node", "dst"), ["project", "start", "dst"]).select("project", "start", "src", "dst").distinct()
