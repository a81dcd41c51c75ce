import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import agents, quality, symbols, tools
from quillspark.operators.frameworks import detected_frameworks, framework_lists, module_frameworks
from quillspark.operators.substrings import candidates, substring_pairs
from quillspark.operators.symbols import build_parsed, build_tables, local_types, with_inferred_receivers, with_local_receivers
from quillspark.plans import analysis
from quillspark.sources import pysource, schemas


def build(spark, files, project="p"):
    rows = [(project, f"/src/{name}", name, text) for name, text in files.items()]
    return build_tables(build_parsed(spark.createDataFrame(rows, schemas.SOURCES)))


APP = '''import langchain
from langchain.tools import tool
import functools

@tool
def search(q):
    """ Find it. """
    return q

@functools.wraps
def odd(q):
    return q

def helper(x):
    return x

def make(llm):
    agent = AgentExecutor(llm, tools=[search, helper])
    agent.bind_tools([helper])
    return agent

class Box(BaseTool):
    pass

def chain(x):
    return RunnablePassthrough.assign(y=x)
'''
CALLER = '''from app import make

def drive(llm):
    return go(make)

def test_not(llm):
    return go(make)
'''
TESTS = '''import unittest
from app import make

class TestMake(unittest.TestCase):
    def setUp(self):
        self.x = 1

    def test_it(self):
        if a and b and c:
            self.assertEqual(make(1), 2)
        with open("f") as f:
            assert make is not None

    async def test_later(self):
        make(1)

def other():
    make(2)
'''


@pytest.fixture(scope="module")
def found(spark):
    tables = build(spark, {"app.py": APP, "flow.py": CALLER, "checks/test_app.py": TESTS, "broken_test.py": "def f(:", "null.py": "a\0b"})
    return analysis.analyze_tables(tables)


def test_frameworks_and_modules(found):
    assert framework_lists(found.tables, found.frameworks).first()["frameworks"] == ["langchain"]
    flags = {r["module"]: r["is_test"] for r in found.tables.modules.collect()}
    assert flags["checks/test_app.py"] and not flags["broken_test.py"] and not flags["app.py"]


def test_tools(found):
    rows = {(r["tool_name"], r["tool_type"], r["framework"], r["tool_description"]) for r in found.tools.collect()}
    assert rows == {
        ("search", "decorator_tool", "langchain", "Find it."), ("odd", "decorator_tool", "langchain", None),
        ("Box", "class_tool", "langchain", None), ("helper", "function_tool", "langchain", None),
        ("search", "function_tool", "langchain", None),
    } | {("helper", "function_tool", "langchain", None)}


def test_agents_callers_and_tests(found):
    rows = {(r["name"], r["agent_type"]) for r in found.agents.collect()}
    assert rows == {("make", "factory"), ("drive", "caller")}
    used = {(r["method_declaration"], r["agent_signature"], r["ncloc"]) for r in found.test_methods.collect()}
    assert used == {("test_it", "app.make", 5), ("test_later", "app.make", 2)}
    record = analysis.agent_records(found).where("agent_type = 'factory'").first()
    assert [t["tool_name"] for t in record["tools"]] == ["helper", "search"] or [t["tool_name"] for t in record["tools"]] == ["search", "helper"]
    assert record["number_of_objects_created"] == 1 and record["constructor_call_details"][0]["line_number"] == 18
    assert record["cyclomatic_complexity"] == 1 and record["ncloc"] == 4


def test_assign_needs_the_import_somewhere_in_the_project(spark):
    files = {"app.py": APP, "more.py": "from langchain.schema import RunnablePassthrough\n"}
    tables = build(spark, files)
    names = {r["name"]: r["description"] for r in agents.factory_agents(tables, detected_frameworks(tables)).collect()}
    assert names["chain"] == "LangChain agent created via RunnablePassthrough.assign() pattern"


def test_report(spark, found, tmp_path):
    report = json.loads(analysis.project_report(found, "p").toJSON().first())
    assert report["name"] == "p" and report["framework"] == ["langchain"] and len(report["agents"]) == 2
    assert report["tests"][0]["testing_frameworks"] == ["pyunit"] and report["tests"][0]["qualified_class_name"] == "test_app.TestMake"
    analysis.write_report(found, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/tools")).count() == found.tools.count()


def test_complexity_of_tests(found):
    rows = {r["test_name"]: r for r in quality.test_complexity(found.tables).collect()}
    it = rows["test_it"]
    # One branch, one boolean chain (flat), one with, one assert.
    assert it["cyclomatic_complexity"] == 5 and it["number_of_assertions"] == 2 and it["number_of_fixtures_used"] == 1
    assert rows["test_later"]["cyclomatic_complexity"] == 1 and rows["test_later"]["is_async"]
    complexity = {r["name"]: r["complexity"] for r in found.tables.functions.collect()}
    assert complexity["test_it"] == 5  # if, with and two operators


def test_query_surface(found):
    t = found.tables
    assert t.find_function("app.make").first()["start_line"] == 17 and t.find_function("gone").count() == 0
    assert [r["method_name"] for r in t.call_targets("app.make").orderBy("start_line", "ordinal").collect()] == ["AgentExecutor", "bind_tools"]
    assert [r["start_line"] for r in t.calling_lines("app.make").orderBy("start_line").collect()] == [18, 19]
    assert {r["name"] for r in t.methods_in_class("test_app.TestMake").collect()} == {"setUp", "test_it", "test_later"}
    assert [r["name"] for r in t.parameters("app.search").collect()] == ["q"]
    assert t.classes_in_module("/src/app.py").count() == 1 and t.methods_in_module("/src/app.py").count() == 0
    assert t.functions_in_module("/src/app.py").count() == 5 and t.module("/src/app.py").count() == 1
    assert {r["qualified_name"] for r in t.test_methods().collect()} == {
        "flow.test_not", "test_app.TestMake.test_it", "test_app.TestMake.setUp", "test_app.TestMake.test_later"}


def test_nested_definitions_belong_to_the_outer_function(spark):
    t = build(spark, {"n.py": "def outer():\n    import os\n    def inner():\n        return f(1)\n    return inner\ng(2)\n"})
    assert t.functions.count() == 1 and t.imports.count() == 0
    assert [(r["function"], r["method_name"]) for r in t.call_sites.collect()] == [("n.outer", "f")]


def test_inferred_receivers(spark):
    t = build(spark, {"n.py": "import lib\n\ndef f(a):\n    a.go()\n    a.go()\n    lib.go()\n"})
    facts = spark.createDataFrame([("p", "n.py", "f", "a", 1, ["thing"]), ("p", "n.py", "f", "a", 5, ["x.Big", "y"])],
                                  "project string, module string, function_name string, variable string, line int, types array<string>")
    facts = facts.withColumn("types", F.when(F.col("line") == 5, F.array(F.lit("Big"), F.lit("y"))).otherwise(F.col("types")))
    got = {(r["start_line"]): r["receiver_type"] for r in with_inferred_receivers(t.call_sites, facts).collect()}
    assert got == {4: None, 5: "Big", 6: "lib"}


def test_assertion_goldens(spark):
    names = {"assertEqual": "equality", "assertAlmostEqual": "equality", "assertTrue": "truthiness", "assertIsNot": "truthiness", "assertThat": "truthiness",
             "assertIsNone": "nullness", "assertIs": "identity", "assertRaises": "identity", "assertIsInstance": "identity", "assertWarns": "throwable",
             "assertIn": "collection", "assertNotIsInstance": "collection", "assertGreater": "comparison", "assert_allclose": "numeric-tolerance",
             "assertRegex": "string", "raises": None, "approx": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", quality.classify_assertion_name(F.col("n"))).collect()} == names
    tests = {"x is None": "nullness", "a is b": "identity", "a == b": "equality", "a > b": "comparison", "a in b": "collection",
             "math.isclose(a, b)": "numeric-tolerance", "isinstance(a, B)": "type", "s.startswith('x')": "string", "ok": "truthiness",
             "f(a) == 1 and b is None": "nullness"}
    df = spark.createDataFrame([(n,) for n in tests], "n string")
    assert {r[0]: r[1] for r in df.select("n", quality.classify_assert_statement(F.col("n"))).collect()} == tests


def test_function_tools_equal_the_ordered_walk(spark):
    rnd = random.Random(8)
    names = ["run", "run_a", "a", "load", "load_run", "b", "zip_a"]
    files = {}
    for m in range(6):
        lines = ["import langchain" if m != 2 else "import os"]
        for n in rnd.sample(names, 4):
            lines += [f"def {n}(x):", "    return x"]
        lines += ["def wire(agent):"]
        for _ in range(4):
            picked = rnd.sample(names, rnd.randint(1, 3))
            lines += [f"    agent.bind_tools([{', '.join(picked)}])", f"    agent.add_tool({picked[0]})"]
        files[f"m{m}.py"] = "\n".join(lines) + "\n"
    got, seen = _function_tools(spark, files)
    assert got == seen and len(seen) > 5


def _function_tools(spark, files):
    """Ids of the function tools, and those a plain walk finds; functions of ``m2.py`` can't be taken."""
    t = build(spark, files)
    mods = module_frameworks(t, detected_frameworks(t))
    nothing = spark.createDataFrame([], "project string, tool_id string")
    got = {r["tool_id"] for r in tools.function_tools(t, mods, nothing).collect()}
    functions = t.functions.orderBy("module", "ordinal").collect()
    calls = t.call_sites.where("method_name IN ('bind_tools', 'add_tool')").orderBy("module", "function_ordinal", "ordinal").collect()
    seen = set()
    for call in calls:
        for expr in call["argument_expr"]:
            for f in functions:
                tool = f"{f['module']}.{f['name']}"
                if f["name"] in expr and f["module"] != "m2.py" and tool not in seen:
                    seen.add(tool)
                    break
    return got, seen


def test_function_tools_of_names_alone(spark):
    """Names that meet no other, with fewer, as many and more arguments than functions, beside names that meet."""
    asks = {"solo": 3, "even": 5, "many": 9, "none": 0, "pair": 2, "pair_up": 4}
    files = {}
    for m in range(6):
        lines = ["import os" if m == 2 else "import langchain"]
        for n in asks:
            lines += [f"def {n}(x):", "    return x"]
        files[f"m{m}.py"] = "\n".join(lines) + "\n"
    bound = [f"    agent.add_tool({n})" for n, times in asks.items() for _ in range(times)]
    files["wired.py"] = "import langchain\ndef wire_all(agent):\n" + "\n".join(bound) + "\n"
    got, seen = _function_tools(spark, files)
    assert got == seen
    taken = {n: sum(tool.endswith(f".{n}") for tool in got) for n in asks}
    assert taken["solo"] == 3 and taken["even"] == 5 and taken["many"] == 5 and taken["none"] == 0


def test_substring_pairs(spark):
    texts = spark.createDataFrame([("p", "abcabc"), ("q", "abc"), ("p", "zz")], "project string, text string")
    needles = spark.createDataFrame([("p", "bc"), ("p", "abcabc"), ("q", "zz"), ("p", "")], "project string, needle string")
    got = {tuple(r) for r in substring_pairs(texts, needles, "project", "text", "needle").collect()}
    assert got == {("p", "abcabc", "bc"), ("p", "abcabc", "abcabc")}


def test_numbered_names_meet_few_texts(spark):
    # by grams of three characters each name met every text that shares three digits with it: 1 in 30 of all here
    n = 2000
    names = [f"{word}_{i}" for word in ("lookup", "go") for i in range(100000, 100000 + n)]
    needles = spark.createDataFrame([("p", name) for name in [*names, "go"]], "project string, needle string")
    texts = spark.createDataFrame([("p", f"[{name}, x]") for name in names], "project string, text string")
    assert candidates(texts, needles, "project", "text", "needle").where("_needle <> 'go'").count() <= 4 * n
    got = {tuple(r) for r in substring_pairs(texts, needles, "project", "text", "needle").collect()}
    assert got == {("p", f"[{name}, x]", name) for name in names} | {("p", f"[{name}, x]", "go") for name in names if name.startswith("go")}


def test_substring_pairs_of_all_lengths(spark):
    letters = random.Random(5)
    words = sorted({"".join(letters.choice("ab_é") for _ in range(size)) for size in range(1, 28) for _ in range(6)})
    needles = spark.createDataFrame([("p", w) for w in words], "project string, needle string")
    texts = spark.createDataFrame([("p", a + b) for a, b in zip(words, words[7:])], "project string, text string")
    got = {tuple(r) for r in substring_pairs(texts, needles, "project", "text", "needle").collect()}
    assert got == {("p", a + b, w) for a, b in zip(words, words[7:]) for w in words if w in a + b}


def test_local_types_follow_names(spark):
    deep = "def f():\n    v0 = Foo()\n" + "".join(f"    v{i + 1} = v{i}\n" for i in range(40)) + "    v40.run()\n"
    odd = ("def f(a: 'Foo', b: lib.Bar, c: Optional[Foo]):\n    a.run(); b.run(); c.run()\n    x, y = Foo(), 1\n    x.run()\n    z: Foo = make()\n"
           "    z.run()\n    x = x\n    x.run()\n    u = w = Foo(); w.run()\n    u += 1\n    u.run()\n\ndef g():\n    a.run()\n")
    texts = {"deep.py": deep, "odd.py": odd, "none.py": "", "bad.py": "def (", "nested.py": "x = " + "(" * 5000 + ")" * 5000}
    rows = [("p", f"/src/{n}", n, text) for n, text in texts.items()]
    parsed = build_parsed(spark.createDataFrame(rows, schemas.SOURCES))
    assert {r[0] for r in parsed.where("NOT valid").select("qualified_name").collect()} == {"bad.py", "nested.py"}
    calls = with_local_receivers(build_tables(parsed).call_sites, local_types(parsed)).where("method_name = 'run'")
    got = {(r["module"], r["start_line"], r["receiver_expr"]): r["receiver_type"] for r in calls.collect()}
    assert got == {
        ("deep.py", 43, "v40"): "Foo", ("odd.py", 2, "a"): None, ("odd.py", 2, "b"): "Bar", ("odd.py", 2, "c"): None, ("odd.py", 4, "x"): None,
        ("odd.py", 6, "z"): "Foo", ("odd.py", 8, "x"): None, ("odd.py", 9, "w"): "Foo", ("odd.py", 11, "u"): None, ("odd.py", 14, "a"): None}


def test_parsing_is_spread_over_all_partitions_and_stores_what_is_used(spark):
    # small texts were merged to one task, and every table was stored whether it was asked for or not
    rows = [("p", f"/s/m{i}.py", f"m{i}.py", f"def f{i}():\n    return {i}\n") for i in range(64)]
    parsed = build_parsed(spark.createDataFrame(rows, schemas.SOURCES), spread=True)
    tasks = parsed.select(F.input_file_name().alias("file")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = build_tables(parsed)
    stored = [tables.functions, tables.functions]
    assert stored[0] is stored[1] and stored[0].count() == 64
    assert set(vars(tables)) == {"_views", "functions"}
    assert tables.methods_with_decorators(["tool"]).count() == 0


def test_decorated_functions_read_headers_alone(spark, monkeypatch):
    # all facts were collected and two tables stored to tell the decorators
    deep = "@tool\ndef f():\n    return " + ".".join(["a"] * 3000) + "()\n"
    texts = {"a.py": "@x.tool(1, 'y')\ndef f():\n    pass\nclass A(B):\n    @y\n    @fixture_of([a, b], k=c)\n    async def m(self):\n        pass\n"
                     "    @other\n    def n(self):\n        pass\n", "bad.py": "@tool\ndef (", "none.py": None, "void.py": "\0", "deep.py": deep}
    sources = spark.createDataFrame([("p", f"/src/{n}", n, text) for n, text in texts.items()], schemas.SOURCES)
    shown = lambda rows: {tuple(r) for r in rows.select("module", "qualified_name", "class_name", F.array_join("decorators", "|")).collect()}
    tables = build_tables(build_parsed(sources))
    expected = shown(tables.methods_with_decorators(["tool", "fixture"]))
    monkeypatch.setattr(symbols, "materialize", None)
    found = shown(symbols.decorated_functions(sources, ["tool", "fixture"], spread=True))
    assert {r for r in found if r[0] != "deep.py"} == {r for r in expected if r[0] != "deep.py"}
    assert found >= expected and {r[1] for r in found} == {"a.f", "a.A.m", "deep.f"}


def test_metrics_of_functions_move_no_nested_statements(spark):
    # statements and their texts were shuffled to be counted after the join, each call was classified in full to be counted
    text = "import mock\ndef test_a(x):\n    assertTrue(x)\n    ASSERT_it(x)\n    mock.Patch(x)\n    assert x\n    assert not x\n"
    rows = quality.function_metrics(build(spark, {"t.py": text}))
    lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert any("size(assert_statements" in line for line in lines[join:]) and not any("assert_statements" in line for line in lines[:join + 1])
    assert not any("truthiness" in line for line in lines)
    assert [(r["number_of_assertions"], r["number_of_mocking_used"], r["method_signature"]) for r in rows.collect()] == [(4, 1, "test_a(x)")]


def test_short_texts_are_those_of_unparse():
    for text in ("a", "a.b.c", "f(x, 'it''s', [1, None])", "f.g()(a).h", "1 .real", "u'x'", "1e999", "b'x'", "...", "[a, *b]", "f(*a)", "f(a, k=1)",
                 "(a, b)", "f((a, b))", "-1", "f(-1)", "[]", "x[0].y", "(lambda: 1)()", "(await_ or b).c", "'a'.join(b)", "True", "[(yield_)]", "\"a'b\""):
        node = ast.parse(text, mode="eval").body
        assert pysource._text(node) == ast.unparse(node)
    assert pysource._short_text(ast.parse("f.g(x, [1, 'a']).h", mode="eval").body) == "f.g(x, [1, 'a']).h"


def test_counts_of_functions_equal_a_walk_of_each():
    text = (
        "class A:\n    @deco(a and b)\n    def m(self, x=(1 if p or q else 2)):\n        def inner():\n            assert x and y or z\n"
        "        for i in x:\n            with i as j, k:\n                pass\n        return lambda: u and v\n"
        "if a or b:\n    def hidden():\n        assert 1\nasync def g():\n    try:\n        async with h() as w:\n            pass\n    except E:\n"
        "        while (n := next(w)):\n            x.y.z(n, *r, k=n or m)\n"
    )
    facts = pysource.syntax_facts(text)
    nodes = {n.name: n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    assert [f["name"] for f in facts["functions"]] == ["g", "m"]
    for f in facts["functions"]:
        inside = list(ast.walk(nodes[f["name"]]))
        bools = [n for n in inside if isinstance(n, ast.BoolOp)]
        assert f["branches"] == sum(isinstance(n, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With)) for n in inside)
        assert f["asserts"] == sum(isinstance(n, ast.Assert) for n in inside)
        assert (f["bool_ops"], f["bool_operators"]) == (len(bools), sum(len(b.values) - 1 for b in bools))
    assert [c["callee"] for c in facts["calls"]] == ["h", "next", "z"]  # a decorator is on no line of its function
