"""Whole-repository analysis: frameworks, tools, agents, tests and the nested report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import agents as A
from quillspark.operators import tools as T
from quillspark.operators.frameworks import detected_frameworks, framework_lists
from quillspark.operators.symbols import SymbolTables, build_parsed, build_tables, load_tables, save_tables
from quillspark.session import materialize


@dataclass
class Analysis:
    tables: SymbolTables
    frameworks: DataFrame
    tools: DataFrame
    agents: DataFrame
    test_methods: DataFrame
    fixtures: DataFrame


Provider = Callable[[DataFrame], SymbolTables]


def parsed_tables(sources: DataFrame) -> SymbolTables:
    """The default provider: parse the sources."""
    return build_tables(build_parsed(sources))


def analyze(sources: DataFrame, stored_at: str | None = None, provider: Provider = parsed_tables) -> Analysis:
    """Analyse any number of projects at once from ``(project, file_path, qualified_name, text)``.

    ``provider`` makes the symbol tables. With ``stored_at`` tables stored there by an earlier run are taken
    instead, and new ones are stored there.
    """
    tables = load_tables(sources.sparkSession, stored_at) if stored_at else None
    if tables is None:
        tables = provider(sources)
        if stored_at:
            save_tables(tables, stored_at)
            tables = load_tables(sources.sparkSession, stored_at)
    return analyze_tables(tables)


def analyze_tables(tables: SymbolTables) -> Analysis:
    found = materialize(detected_frameworks(tables))
    agents = materialize(A.detect_agents(tables, found))
    tools = T.merge_agent_tools(T.detect_tools(tables, found), A.agent_tools(tables, agents))
    return Analysis(
        tables, found, materialize(tools), agents, materialize(A.agent_test_methods(tables, agents)),
        A.agent_test_fixtures(tables, agents),
    )


def agent_records(analysis: Analysis) -> DataFrame:
    """Agents with their tools, calls and metrics; everything nested belongs to one function."""
    key = A.FUNCTION_KEY
    details = A.call_details(analysis.tables, analysis.agents)
    fields = [c for c in details.columns if c not in (*key, "call_kind", "ordinal")]

    def calls(kind: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("d"))))
        return details.where(F.col("call_kind") == kind).groupBy(*key).agg(
            F.transform(listed, lambda x: x["d"]).alias(f"{kind}_call_details")
        )

    own = A.agent_tools(analysis.tables, analysis.agents)
    tool = F.struct("position", F.struct("framework", "tool_name", "tool_type", "tool_description", "tool_binding_method",
                                         "tool_binding_module").alias("t"))
    tools = own.groupBy("project", "framework", F.col("tool_binding_method").alias("method_signature"), F.col("tool_binding_module").alias("module")).agg(
        F.transform(F.array_sort(F.collect_list(tool)), lambda x: x["t"]).alias("tools")
    )
    rows = analysis.agents
    for kind in ("constructor", "application", "library"):
        rows = rows.join(calls(kind), key, "left")
    rows = rows.join(tools, ["project", "framework", "method_signature", "module"], "left")
    return rows.select(
        "project", "name", "agent_type", "framework", "qualified_class_name", F.col("module").alias("qualified_module_name"),
        "method_signature", "tools", "description", "factory_agent_names", "ncloc", F.col("ncloc").alias("ncloc_with_helpers"),
        F.col("complexity").alias("cyclomatic_complexity"), F.col("complexity").alias("cyclomatic_complexity_with_helpers"),
        F.coalesce(F.when(F.size("constructor_call_details") > 0, F.size("constructor_call_details")), F.lit(0)).alias("number_of_objects_created"),
        "constructor_call_details", "application_call_details", "library_call_details",
    )


def test_records(analysis: Analysis) -> DataFrame:
    """Agent tests grouped by class or module, each method with the agents it uses."""
    m = analysis.test_methods
    agent = F.struct("name", "agent_type", "framework", F.col("agent_module").alias("qualified_module_name"), F.col("agent_signature").alias("method_signature"))
    methods = m.groupBy("project", "module", "qualified_class_name", "function_ordinal", "method_signature", "method_declaration", "annotations", "ncloc").agg(
        F.array_sort(F.collect_list(agent)).alias("agents")
    )
    entry = F.struct("function_ordinal", "method_signature", "method_declaration", "annotations", "ncloc", "agents")
    tests = methods.groupBy("project", "module", "qualified_class_name").agg(F.array_sort(F.collect_list(entry)).alias("test_methods"))
    fixture = F.struct("method_signature", "is_setup", "is_teardown", "qualified_class_name", F.col("module").alias("qualified_module_name"),
                       F.lit("").alias("method_body"), "ncloc")
    fixtures = analysis.fixtures.groupBy("project", "module", "qualified_class_name").agg(F.array_sort(F.collect_list(fixture)).alias("fixtures"))
    return tests.join(fixtures, ["project", "module", "qualified_class_name"], "left").select(
        "project", F.col("module").alias("qualified_module_name"), "qualified_class_name", "fixtures", "test_methods",
        F.array(F.lit("pyunit")).alias("testing_frameworks"),
    )


def write_report(analysis: Analysis, path: str) -> None:
    """The report as row sets below ``path``: any project's part stays one filter away and none is held whole."""
    out = {
        "frameworks": framework_lists(analysis.tables, analysis.frameworks), "tools": analysis.tools,
        "agents": agent_records(analysis), "tests": test_records(analysis),
    }
    for name, rows in out.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def project_report(analysis: Analysis, project: str) -> DataFrame:
    """One project's nested report as a single row, for export; bounded by that project's findings."""
    mine = F.col("project") == project

    def gather(rows: DataFrame, name: str) -> DataFrame:
        body = F.struct(*[c for c in rows.columns if c != "project"])
        return rows.where(mine).groupBy("project").agg(F.collect_list(body).alias(name))

    out = framework_lists(analysis.tables, analysis.frameworks).where(mine).withColumnRenamed("frameworks", "framework")
    for rows, name in ((analysis.tools, "tools"), (agent_records(analysis), "agents"), (test_records(analysis), "tests")):
        out = out.join(gather(rows, name), "project", "left")
    return out.withColumnRenamed("project", "name")


test_records.__test__ = False
