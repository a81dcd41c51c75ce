"""Framework identification and the import tests shared by the detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import any_contains
from quillspark.operators import rules
from quillspark.operators.symbols import SymbolTables


def matching(texts: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """Keys whose patterns occur in any of ``texts``, in the mapping's order."""
    hits = [F.when(any_contains(texts, list(p)), F.lit(name)) for name, p in patterns.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def detected_frameworks(tables: SymbolTables) -> DataFrame:
    """``(project, framework)``; a project without any gets ``unknown``.

    An import counts when it is a framework's root package or lies below it, so a root is compared with
    every dotted prefix of the imported name.
    """
    root_of = F.create_map(*[F.lit(x) for name, roots in rules.IMPORT_ROOTS.items() for r in roots for x in (r, name)])
    imported = F.transform("texts", lambda t: F.split(F.lower(F.trim(t)), r"\."))
    prefixes = F.flatten(
        F.transform(
            imported,
            lambda parts: F.transform(
                F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
            ),
        )
    )
    found = F.array_distinct(
        F.filter(F.transform(prefixes, lambda p: F.try_element_at(root_of, p)), lambda f: f.isNotNull())
    )
    # One row per framework of each module; the null marks a project whose modules match nothing.
    per_module = tables.module_imports.select("project", F.explode_outer(found).alias("framework")).distinct()
    known = per_module.groupBy("project").agg(F.count("framework").alias("_n"), F.collect_set("framework").alias("f"))
    return known.select(
        "project", F.explode(F.when(F.col("_n") > 0, F.col("f")).otherwise(F.array(F.lit(rules.UNKNOWN)))).alias("framework")
    )


def framework_lists(tables: SymbolTables, detected: DataFrame) -> DataFrame:
    """``(project, frameworks)``: each project's sorted framework list, ``['unknown']`` if none."""
    return detected.groupBy("project").agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))


def module_frameworks(tables: SymbolTables, detected: DataFrame) -> DataFrame:
    """Per module: ``all_frameworks`` its imports point to, and those of them ``detected`` in its project."""
    lists = detected.groupBy("project").agg(F.collect_set("framework").alias("_detected"))
    marked = tables.module_imports.select("project", "module", "texts", matching(F.col("texts"), rules.TOOL_IMPORTS).alias("all_frameworks"))
    return marked.join(lists, "project").select(
        "project", "module", "texts", "all_frameworks", F.col("_detected").alias("detected"),
        F.filter("all_frameworks", lambda f: F.array_contains("_detected", f)).alias("frameworks"),
    )

