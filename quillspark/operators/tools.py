"""Tool detection: decorators, base classes, functions handed to agents, lambdas, MCP and Claude SDK tools."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import any_contains, contains_any, strip
from quillspark.operators import rules
from quillspark.operators.components import connected
from quillspark.operators.frameworks import module_frameworks
from quillspark.operators.ordered import with_position
from quillspark.operators.store import earliest
from quillspark.operators.substrings import substring_pairs
from quillspark.operators.symbols import SymbolTables
from quillspark.session import materialize

TOOL_COLUMNS = (
    "project", "tool_id", "detector", "module", "ordinal", "framework", "tool_name", "tool_type", "tool_description",
    "tool_binding_method", "tool_binding_module",
)


def is_tool_decorator(text: Column) -> Column:
    return contains_any(text, list(rules.TOOL_DECORATORS)) & ~contains_any(text, list(rules.NOT_TOOL_DECORATORS))


def is_tool_base(text: Column) -> Column:
    hints = sorted({h for hints in rules.BASE_CLASS_HINTS.values() for h in hints})
    return contains_any(text, hints)


def _first_hint(text: Column, hints) -> Column:
    return F.coalesce(*[F.when(contains_any(text, list(h)), F.lit(name)) for name, h in hints.items()])


def _description(docstring: str = "docstring") -> Column:
    bare = strip(F.col(docstring))
    return F.when(bare != "", bare)


def _rows(df: DataFrame, detector: int, tool_type: str, name: Column, method: Column, framework: Column,
          tool_id: Column, description: Column) -> DataFrame:
    return df.select(
        "project", tool_id.alias("tool_id"), F.lit(detector).alias("detector"), "module", "ordinal",
        framework.alias("framework"), name.alias("tool_name"), F.lit(tool_type).alias("tool_type"),
        description.alias("tool_description"), method.alias("tool_binding_method"),
        F.col("module").alias("tool_binding_module"),
    )


def _function_rows(df: DataFrame, detector: int, tool_type: str, framework: Column) -> DataFrame:
    return _rows(df, detector, tool_type, F.col("name"), F.col("qualified_name"), framework,
                 F.concat_ws(".", "module", "name"), _description())


def _seen_once(rows: DataFrame) -> DataFrame:
    return earliest(rows, ["project", "tool_id"], ["detector", "module", "ordinal"]).select(*TOOL_COLUMNS)


def decorator_tools(tables: SymbolTables, mods: DataFrame) -> DataFrame:
    """Functions with a tool decorator in modules that import a detected framework."""
    used = F.filter("decorators", is_tool_decorator)
    marked = tables.functions.withColumn("_dec", F.get(used, F.lit(0))).where("_dec IS NOT NULL")
    rows = marked.join(mods.where(F.size("frameworks") > 0), ["project", "module"])
    framework = F.coalesce(_first_hint(F.col("_dec"), rules.DECORATOR_HINTS), F.get("frameworks", F.lit(0)))
    return _seen_once(_function_rows(rows, 1, "decorator_tool", framework))


def class_tools(tables: SymbolTables, mods: DataFrame) -> DataFrame:
    """Classes derived from a tool base class in modules that import a detected framework."""
    used = F.filter("bases", is_tool_base)
    marked = tables.classes.withColumn("_base", F.get(used, F.lit(0))).where("_base IS NOT NULL")
    rows = marked.join(mods.where(F.size("frameworks") > 0), ["project", "module"])
    hinted = [(f, contains_any(F.col("_base"), list(h)), F.array_contains("detected", f))
              for f, h in rules.BASE_CLASS_HINTS.items()]
    with_import = [F.when(hit & on & F.array_contains("frameworks", f), F.lit(f)) for f, hit, on in hinted]
    alone = [F.when(hit & on, F.lit(f)) for f, hit, on in hinted]
    framework = F.coalesce(*with_import, *alone, F.lit(rules.UNKNOWN))
    named = _rows(rows, 2, "class_tool", F.col("class_name"), F.col("qualified_name"), framework,
                  F.col("qualified_name"), _description())
    return _seen_once(named)


def function_tools(tables: SymbolTables, mods: DataFrame, taken: DataFrame) -> DataFrame:
    """Functions whose name occurs in an argument of a tool-binding call.

    Arguments in call order each take the first matching function nobody took before. A function has one name,
    so what an argument may take is the next free function of one of the names that occur in it, and the n-th function
    of a name is out of reach of fewer than n arguments. Arguments that share no name, by way of others either, don't
    affect each other: names are parted into connected groups. A name that is a group of its own loses as many functions
    as arguments ask for it, which counts tell without any order. Only groups of several names are walked in order; the
    walk streams arguments past the ids of the functions in reach, which are all it holds.
    """
    calls = tables.call_sites.where(F.col("method_name").isin(*rules.TOOL_METHODS)).select(
        "project", "module", "function_ordinal", "ordinal", F.posexplode("argument_expr").alias("arg", "expr")
    ).where((F.col("expr") != "") & ~F.col("expr").startswith('"') & ~F.col("expr").startswith("'"))
    usable = tables.functions.join(mods.where(F.size("frameworks") > 0), ["project", "module"]).withColumn(
        "tool_id", F.concat_ws(".", "module", "name")
    ).join(taken.select("project", "tool_id"), ["project", "tool_id"], "left_anti")
    functions = materialize(with_position(earliest(
        usable.select("project", "tool_id", "module", "ordinal", "name", "qualified_name", "docstring", "frameworks"),
        ["project", "tool_id"], ["module", "ordinal"],
    ), ["project", "name"], ["module", "ordinal"], "rank"))
    node = F.xxhash64("project", "name")
    wishes = materialize(
        substring_pairs(calls, functions, "project", "expr", "name").groupBy("project", "expr").agg(
            F.sort_array(F.collect_set(node)).alias("names")  # at most the names that fit into one expression
        )
    )
    first = F.get("names", F.lit(0))
    groups = connected(wishes.select(first.alias("a"), F.explode("names").alias("b"))).withColumnRenamed("label", "part")
    places = ["module", "function_ordinal", "ordinal", "arg"]
    asking = materialize(calls.join(wishes, ["project", "expr"]).select("names", *places))
    asked = asking.select(F.explode("names").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("asks"))
    sizes = groups.groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))
    parts = materialize(groups.join(sizes, "part").join(asked, "node"))
    reach = functions.withColumn("node", node).join(parts, "node").where("rank <= asks")
    several = parts.where("nodes > 1").select("node", "part")
    waiting = asking.withColumn("node", first).join(several, "node").select(
        "part", F.lit(1).alias("role"), *places, "names", F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("tool_id"),
    )
    offered = reach.where("nodes > 1").select(
        "part", F.lit(0).alias("role"), "module", F.col("ordinal").alias("function_ordinal"), F.lit(0).alias("ordinal"), F.lit(0).alias("arg"),
        F.array("node").alias("names"), "project", "tool_id",
    )
    walked = (
        offered.unionByName(waiting).repartition("part").sortWithinPartitions("part", "role", *places)
        .mapInArrow(_walk, "project string, tool_id string")
    )
    held = reach.where("nodes = 1").select("project", "tool_id").unionByName(walked)
    rows = functions.join(held, ["project", "tool_id"])
    return _function_rows(rows, 3, "function_tool", F.get("frameworks", F.lit(0))).select(*TOOL_COLUMNS)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Functions taken, of rows in the order (part, role, place): a part's functions come before its arguments."""
    part, free = None, {}
    for batch in batches:
        found: list[tuple[str, str]] = []
        columns = [batch.column(c).to_pylist() for c in ("part", "role", "module", "function_ordinal", "names", "project", "tool_id")]
        for group, role, module, ordinal, names, project, tool_id in zip(*columns, strict=True):
            if group != part:
                part, free = group, {}
            if role == 0:
                free.setdefault(names[0], deque()).append((module, ordinal, project, tool_id))
                continue
            heads = [free[n] for n in names if free.get(n)]
            if heads:
                found.append(min(heads, key=lambda h: h[0][:2]).popleft()[2:])
        projects, tools = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(projects, pa.string()), pa.array(tools, pa.string())], ["project", "tool_id"])


def lambda_tools(tables: SymbolTables, mods: DataFrame) -> DataFrame:
    """Lambdas that sit in a list or in a tool-binding call, named by their line."""
    in_call = (F.col("parent") == "Call") & F.col("parent_callee").isin(*rules.TOOL_METHODS)
    rows = tables.lambdas.where((F.col("parent") == "List") | in_call).join(mods, ["project", "module"])
    name = F.concat(F.lit("lambda_tool_"), F.col("line"))
    framework = F.coalesce(F.get("all_frameworks", F.lit(0)), F.lit(rules.UNKNOWN))
    return _seen_once(_rows(rows, 4, "lambda_tool", name, name, framework, F.concat_ws(".", F.col("module"), name),
                            F.concat(F.lit("Lambda tool at line "), F.col("line"))))


def mcp_tools(tables: SymbolTables, mods: DataFrame) -> DataFrame:
    """Server-decorated functions in modules of the built-in protocol library, unless they use its wrapper."""
    own = any_contains(F.col("texts"), ["mcp.server", "mcp.types"]) & ~any_contains(F.col("texts"), ["fastmcp"])
    rows = tables.functions.where(any_contains(F.col("decorators"), list(rules.MCP_DECORATORS))).join(
        mods.where(own & F.array_contains("detected", "mcp")), ["project", "module"]
    )
    return _seen_once(_function_rows(rows, 5, "mcp_tool", F.lit("mcp")))


def claude_sdk_tools(tables: SymbolTables, mods: DataFrame) -> DataFrame:
    lowered = F.transform("decorators", lambda d: F.lower(d))
    own = any_contains(F.col("texts"), ["anthropic.agents", "claude_agent_sdk"])
    rows = tables.functions.where(any_contains(lowered, ["tool"])).join(
        mods.where(own & F.array_contains("detected", "claude_agent_sdk")), ["project", "module"]
    )
    return _seen_once(_function_rows(rows, 6, "decorator_tool", F.lit("claude_agent_sdk")))


def detect_tools(tables: SymbolTables, detected: DataFrame) -> DataFrame:
    """All tools of the projects that use a relevant framework; an id belongs to the first detector that saw it."""
    mods = module_frameworks(tables, detected).where(F.arrays_overlap("detected", F.array(*[F.lit(f) for f in rules.TOOL_IMPORTS])))
    mods = materialize(mods)
    declared = materialize(decorator_tools(tables, mods).unionByName(class_tools(tables, mods)))
    rest = lambda_tools(tables, mods).unionByName(mcp_tools(tables, mods)).unionByName(claude_sdk_tools(tables, mods))
    return _seen_once(declared.unionByName(function_tools(tables, mods, declared)).unionByName(rest))


def merge_agent_tools(tools: DataFrame, agent_tools: DataFrame) -> DataFrame:
    """Detected tools plus the agents' own that are not among them by (module, method, name)."""
    keys = ["tool_binding_module", "tool_binding_method", "tool_name"]
    columns = ["project", "framework", "tool_name", "tool_type", "tool_description", *keys[:2]]
    have = tools.select(*columns)
    on = have["project"] == agent_tools["project"]
    for key in keys:
        on = on & have[key].eqNullSafe(agent_tools[key])
    extra = agent_tools.join(have, on, "left_anti")
    extra = earliest(extra, ["project", *keys], ["position", "framework"])
    return have.unionByName(extra.select(*columns))
