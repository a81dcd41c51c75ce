"""Python source trees derived from the given tables, so that code analysis has input that grows with them.

Each part becomes a module that may build an agent, each supplier a module calling the part's builder, each
customer a test module for it. Brands are the projects. Line numbers are fixed; ``catalog.code`` states in
SQL, from the same columns, what the analysis must find.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.symbols import SymbolTables, build_parsed, build_tables

IMPORT_LINES = (
    "from langchain import create_react_agent", "from langgraph.graph import StateGraph", "from crewai import Agent",
    "import autogen", "from semantic_kernel import ChatCompletionAgent", "from llama_index.core import ReActAgent",
    "from haystack.components import Agent", "from metagpt.roles import Role", "from swarm import Agent",
    "from agents import Agent, Runner", "import dspy", "import langroid as lr", "from camel.societies import ChatAgent",
    "from letta_client import Letta", "from mcp.server import Server", "from fastmcp import FastMCP",
    "from claude_agent_sdk import Agent",
)
BUILD_CALLS = (
    "create_react_agent(llm, tools=[lookup_{k}])", "StateGraph(dict)", "Agent(llm, tools=[lookup_{k}, helper_{k}])",
    "autogen.AssistantAgent(llm)", "ChatCompletionAgent(llm)", "ReActAgent(llm)", "Agent(llm)", "Role(llm)", "Agent(llm)",
    "Runner.run_sync(llm)", "dspy.ReAct(llm)", "lr.ChatAgent(llm)", "ChatAgent(llm)", 'llm.agents.create(name="x")',
    'Server("x")', 'FastMCP("x")', "Agent(llm, tools=[lookup_{k}])",
)
DECORATORS = ("@tool", "@function_tool", "@functools.wraps(print)", "@server.tool()", "# undecorated", "@mcp.tool()")
BASES = ("BaseTool", "FunctionTool", "Tool", "object")
BINDINGS = ("agent.bind_tools([helper_{k}])", "agent.add_tool(lambda y: y)", 'agent.describe("a", limit=2)')

PART_MODULE = """import functools
{import}
{self_import}

HOOKS = {hooks}

# {note}
{decorator}
def lookup_{k}(query):
    \"\"\"Look up {name}.\"\"\"
    return functools.reduce(max, query)

class Search{k}({base}):
    \"\"\"Search {name}.\"\"\"
    def run(self, query: str) -> str:
        return lookup_{k}(query)

def helper_{k}(value, limit=3):
    # keep going

    if value and limit and value > limit:
        return str(value)
    while limit or value:
        limit -= 1
    return len([limit])

def build_{k}(llm):
    agent = {build}
    {binding}
    return agent

def again_{k}(llm):
    return build_{k}(llm)
"""

CALLER_MODULE = """import os
from {origin} import build_{k}

def run_{k}(folder):
    return os.path.join(str(build_{k}), folder)

class Flow{k}:
    def go(self):
        return build_{k}(None)
"""

TEST_MODULE = """import unittest
from unittest.mock import patch
from {origin} import build_{k}

class TestFlow{k}(unittest.TestCase):
    def setUp(self):
        self.llm = MagicMock()

    def check(self, value):
        self.assertEqual(value, 1)

    @patch("os.getenv")
    def test_build(self, env):
        agent = build_{k}(None)
        self.check(1)
        self.check(2)
        self.assertTrue(agent)
        assert agent is not None

@pytest.fixture
def ready_{k}():
    return 1

def plain_{k}(value):
    assert isinstance(value, int)
    return value

def test_alone_{k}(ready_{k}):
    value = plain_{k}(ready_{k})
    if value and ready_{k}:
        assert value == 1
    plain_{k}(value)
"""


def _fill(template: str | Column, **values: Column) -> Column:
    """A column from a template whose ``{name}`` marks are replaced by columns.

    A fixed template is cut at its marks and joined with the values in one pass; one that differs by row is searched.
    """
    if isinstance(template, str):
        pieces = re.split(r"\{(\w+)\}", template)
        return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _pick(options: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """``(project, file_path, qualified_name, text)`` of all derived modules."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    key = F.col("p_partkey")
    k = key.cast("string")
    brand = F.substring("p_brand", 7, 10).cast("int")
    size = F.col("p_size")
    top = key % 2 == 0
    home = F.when(top, F.concat(F.lit("mod"), k)).otherwise(F.concat(F.lit("pkg/mod"), k))
    text = _fill(
        PART_MODULE,
        **{"import": _pick(IMPORT_LINES, key % 17)},
        self_import=F.when(brand % 2 == 0, F.concat(F.lit("import mod"), k)).otherwise(F.lit("# standalone")),
        hooks=F.when(brand % 3 == 0, F.lit("[lambda x: x]")).otherwise(F.lit("[]")),
        note=F.concat_ws(" ", "p_name", "p_type"), decorator=_pick(DECORATORS, size % 6), base=_pick(BASES, brand % 4),
        build=_fill(_pick(BUILD_CALLS, key % 17), k=k), binding=_fill(_pick(BINDINGS, size % 3), k=k), name=F.col("p_name"), k=k,
    )
    modules = part.select(
        F.col("p_brand").alias("project"), F.concat(F.lit("/src/"), "p_brand", F.lit("/"), home, F.lit(".py")).alias("file_path"),
        F.concat(home, F.lit(".py")).alias("qualified_name"), text.alias("text"),
    )
    owner = part.select(F.col("p_partkey").alias("_key"), F.col("p_brand").alias("project"))

    def around(table: str, column: str, template: str, path: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(column).alias("_key")).join(owner, "_key")
        n = F.col("_key").cast("string")
        origin = F.when(F.col("_key") % 2 == 0, F.concat(F.lit("mod"), n)).otherwise(F.concat(F.lit("pkg.mod"), n))
        name = F.concat(F.lit(path), n, F.lit(".py"))
        return rows.select(
            "project", F.concat(F.lit("/src/"), "project", F.lit("/"), name).alias("file_path"), name.alias("qualified_name"),
            _fill(template, origin=origin, k=n).alias("text"),
        )

    return modules.unionByName(around("supplier", "s_suppkey", CALLER_MODULE, "flows/flow")).unionByName(
        around("customer", "c_custkey", TEST_MODULE, "checks/test_flow")
    )


# Ways to make an agent, one a supplier: import line, call, framework and naming part of the description (none
# for a call that makes no agent), in the order of ``s_suppkey % 18``.
VARIANTS = (
    ("from autogen import AssistantAgent", "AssistantAgent(llm)", "autogen", "AutoGen agent created via AssistantAgent"),
    ("from autogen_agentchat.agents import UserProxyAgent", "UserProxyAgent(llm)", "autogen", "AutoGen agent created via UserProxyAgent"),
    ("from autogen import ConversableAgent as Talker", "ConversableAgent(llm)", "autogen", "AutoGen agent created via ConversableAgent"),
    ("from dspy import ReAct", "ReAct(llm)", "dspy", "DSPy agent created via ReAct"),
    ("from langroid import ChatAgent", "ChatAgent(llm)", "langroid", "Langroid agent created via ChatAgent"),
    ("from langroid import ChatAgentConfig", "ChatAgentConfig(llm)", "langroid", "Langroid agent created via ChatAgentConfig"),
    ("from langchain.agents import AgentExecutor", "AgentExecutor(llm)", "langchain", "LangChain agent created via AgentExecutor"),
    ("from langchain.schema import RunnablePassthrough", "RunnablePassthrough.assign(y=llm)", "langchain",
     "LangChain agent created via RunnablePassthrough.assign() pattern"),
    ("from langgraph.prebuilt import create_react_agent", "create_react_agent(llm)", "langgraph", "LangGraph agent created via create_react_agent"),
    ("from llama_index.core.agent import FunctionAgent", "FunctionAgent(llm)", "llama_index", "LlamaIndex agent created via FunctionAgent"),
    ("from llama_index.core.agent import AgentWorkflow", "AgentWorkflow(llm)", "llama_index", "LlamaIndex agent created via AgentWorkflow"),
    ("from metagpt.roles import ProductManager", "ProductManager(llm)", "metagpt", "MetaGPT agent created via ProductManager"),
    ("from metagpt.roles import Architect", "Architect(llm)", "metagpt", "MetaGPT agent created via Architect"),
    ("from metagpt.roles import Engineer", "Engineer(llm)", "metagpt", "MetaGPT agent created via Engineer"),
    ("from crewai import *", "Agent(llm)", "crewai", "CrewAI agent created via Agent constructor"),
    ("from . import crews", "crews.Agent(llm)", None, None),
    ("from crewai import Agent", "describe(llm)", None, None),
    ("def broken(:", "Agent(llm)", None, None),
)
VARIANT_SHAPES = (
    "{import}\n\ndef build_{k}(llm):\n    return {call}\n",
    "{import}\n\nasync def build_{k}(llm):\n    made = {call}\n    return made\n",
    "{import}\n\nclass Maker{k}:\n    def build_{k}(self, llm):\n        if llm:\n            return {call}\n",
)


def variant_files(spark: SparkSession, sf: str) -> DataFrame:
    """A project of one module for each supplier, which makes an agent in one of the known ways or in none."""
    key = F.col("s_suppkey")
    k = key.cast("string")
    pick = lambda place: _pick(tuple(v[place] for v in VARIANTS), key % len(VARIANTS))
    text = F.lit(None).cast("string")
    for n, shape in enumerate(VARIANT_SHAPES):
        text = F.when(F.floor(key / len(VARIANTS)) % len(VARIANT_SHAPES) == n, _fill(shape, **{"import": pick(0)}, call=pick(1), k=k)).otherwise(text)
    project = F.concat(F.lit("supplier"), k)
    return spark.read.parquet(f"{sf}/supplier.parquet").select(
        project.alias("project"), F.concat(F.lit("/src/"), project, F.lit("/make.py")).alias("file_path"),
        F.lit("make.py").alias("qualified_name"), text.alias("text"),
    )


# Ways to come by an object, one a part, in the order of ``p_partkey % 9``.
TYPED_SHAPES = (
    "def go():\n    x = Foo{k}(1)\n    x.run()\n",
    "def go():\n    a = Foo{k}(1)\n    b = a\n    c = b\n    d = c\n    d.run()\n",
    "def go():\n    x = Foo{k}(1)\n    x.run()\n    x = Bar{k}(2)\n    x.run()\n",
    "def go():\n    x = Foo{k}(1)\n    x = other(x)\n    x.run()\n",
    "class Box:\n    def go(self, x: Foo{k}):\n        x.run()\n\n    def stay(self, x):\n        x.run()\n",
    "def go():\n    with Foo{k}(1) as x:\n        x.run()\n",
    "def go():\n    x = lib.Foo{k}(1); x.run()\n",
    "def go():\n    a = Foo{k}(1)\n    b = a\n    a = Bar{k}(b)\n    b.run()\n    b = b.run()\n    b.run()\n",
    "def go(many):\n    for x in many:\n        x.run()\n    if (y := Foo{k}(many)):\n        y.run()\n",
)


def typed_files(spark: SparkSession, sf: str) -> DataFrame:
    """A module for each part, whose functions call objects that they made, were given or took from another name."""
    key = F.col("p_partkey")
    name = F.concat(F.lit("made/m"), key.cast("string"), F.lit(".py"))
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_brand").alias("project"), F.concat(F.lit("/src/"), "p_brand", F.lit("/"), name).alias("file_path"), name.alias("qualified_name"),
        _fill("{shape}", shape=_pick(TYPED_SHAPES, key % len(TYPED_SHAPES))).alias("_s"), key.cast("string").alias("_k"),
    ).withColumn("text", F.replace("_s", F.lit("{k}"), F.col("_k"))).drop("_s", "_k")


_tables: dict[tuple[str, str], SymbolTables] = {}


def symbol_tables(spark: SparkSession, sf: str) -> SymbolTables:
    """Symbol tables of the derived sources, parsed once per session and stored."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _tables:
        _tables[key] = build_tables(build_parsed(source_files(spark, sf), spread=True))
    return _tables[key]
