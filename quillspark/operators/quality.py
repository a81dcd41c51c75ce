"""Test complexity: size, branching, calls, mocking, fixtures, helpers and assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import any_contains, contains_any
from quillspark.operators import rules
from quillspark.operators.store import earliest
from quillspark.operators.symbols import SymbolTables
from quillspark.session import materialize

KEY = ["project", "module", "function_ordinal"]

# Ordered keyword rules of assertion names; the first that occurs decides, unless the word that
# excludes it occurs too.
NAME_RULES = (
    ("equality", ("equal",)), ("truthiness", ("true", "false")), ("nullness", ("none", "null")), ("identity", ("is",), "not"),
    ("throwable", ("raises", "exception", "error", "warns")),
    ("collection", ("in", "contains", "count", "sequence")),
    ("comparison", ("greater", "less")),
    ("numeric-tolerance", ("almost", "close")),
    ("type", ("type", "instance")),
    ("string", ("regex", "match")),
)
# Ordered text rules of assert statements.
STATEMENT_RULES = (
    ("nullness", (" is none", " is not none")), ("identity", (" is ",)), ("equality", ("==", "!=")),
    ("comparison", (">", "<")), ("collection", (" in ",)), ("numeric-tolerance", ("isclose", "allclose")),
    ("type", ("isinstance", "issubclass", "type(")), ("string", ("startswith", "endswith", "match", "search")),
)


def classify_assertion_name(name: Column) -> Column:
    """Kind of an assertion method by its name, null for other methods. Order matters more than meaning."""
    low = F.lower(name)
    kind = None
    for label, words, *excluding in NAME_RULES:
        test = contains_any(low, list(words))
        for word in excluding:
            test = test & ~F.contains(low, F.lit(word))
        kind = F.when(test, label) if kind is None else kind.when(test, label)
    return F.when(low.startswith("assert"), kind.otherwise("truthiness"))


def classify_assert_statement(test: Column) -> Column:
    """Kind of an ``assert`` statement by the text of its condition."""
    low = F.lower(test)
    kind = None
    for label, texts in STATEMENT_RULES:
        hit = contains_any(low, list(texts))
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
    return kind.otherwise("truthiness")


def mentions_mock(text: Column) -> Column:
    return contains_any(F.lower(text), list(rules.MOCK_WORDS))


def assertions(tables: SymbolTables) -> DataFrame:
    """Assertions of every function: assertion calls in call order, then assert statements by line."""
    calls = tables.call_sites.select(
        *KEY, F.lit(0).alias("form"), F.col("ordinal").alias("position"),
        classify_assertion_name(F.col("method_name")).alias("assertion_type"),
        F.col("method_name").alias("assertion_name"), F.col("method_signature").alias("assertion_code"),
    ).where("assertion_type IS NOT NULL")
    plain = tables.functions.select(
        "project", "module", F.col("ordinal").alias("function_ordinal"), F.explode("assert_statements").alias("a")
    ).select(
        *KEY, F.lit(1).alias("form"), F.col("a.ordinal").alias("position"),
        classify_assert_statement(F.col("a.test")).alias("assertion_type"), F.lit("assert").alias("assertion_name"),
        F.col("a.code").alias("assertion_code"),
    )
    return calls.unionByName(plain)


def function_metrics(tables: SymbolTables) -> DataFrame:
    """One row of metrics per function. Call kinds count independently of one another.

    What a function alone tells is told before the join, so that it moves as numbers and not as nested rows.
    """
    counts = tables.call_sites.withColumn("_low", F.lower("method_name")).groupBy(*KEY).agg(
        F.count_if("is_constructor_call").alias("number_of_constructor_call"),
        F.count_if("is_library_call").alias("number_of_library_call"),
        F.count_if("is_application_call").alias("number_of_application_call"),
        F.count_if(contains_any(F.col("_low"), list(rules.MOCK_WORDS))).alias("_mocks"),
        F.count_if(F.col("_low").startswith("assert")).alias("_asserts"),
    )
    shown = F.concat("name", F.lit("("), F.array_join(F.transform("parameters", lambda p: p["name"]), ", "), F.lit(")"))
    functions = tables.functions.withColumn("function_ordinal", F.col("ordinal")).withColumn(
        "_marked", F.size(F.filter("decorators", mentions_mock))).withColumn(
        "_statements", F.size("assert_statements")).withColumn("method_signature", shown).drop("assert_statements")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return functions.join(counts, KEY, "left").select(
        *KEY, "file_path", "name", "qualified_name", "kind", "class_ordinal", "class_name", "is_test", "is_async",
        "start_line", "end_line", "decorators", "parameters", "ncloc", F.col("test_complexity").alias("cyclomatic_complexity"),
        zero("number_of_constructor_call").alias("number_of_constructor_call"),
        zero("number_of_library_call").alias("number_of_library_call"),
        zero("number_of_application_call").alias("number_of_application_call"),
        (zero("_mocks") + F.col("_marked")).alias("number_of_mocking_used"),
        (zero("_asserts") + F.col("_statements")).alias("number_of_assertions"),
        "method_signature",
        F.when(F.col("kind") == "method", F.regexp_replace("qualified_name", r"\.[^.]*$", "")).otherwise("")
        .alias("qualified_class_name"),
    )


def lookup(tables: SymbolTables) -> DataFrame:
    """Functions by qualified name per project: the last definition, placed where the name first appeared."""
    place = F.struct("module", "ordinal")
    rest = F.struct("module", "ordinal", "name", "kind", "class_ordinal", "is_test", "parameters", "decorators")
    return tables.functions.groupBy("project", "qualified_name").agg(
        F.max_by(rest, place).alias("f"), F.min(place).alias("first_place")
    ).select("project", "qualified_name", "f.*", "first_place")


def fixture_uses(tables: SymbolTables, tests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(test, fixture)`` pairs. ``tests`` are rows of ``lookup``, ``known`` is the whole of it if at hand.

    A parameter uses the first function of its name with a fixture decorator; a test method also uses its
    class's set-up and tear-down methods.
    """
    test_key = ["project", "module", F.col("ordinal").alias("function_ordinal")]
    is_fixture = F.exists("decorators", lambda d: F.contains(d, F.lit("fixture")))
    named = earliest(
        (lookup(tables) if known is None else known).where(is_fixture).select("project", "name", "first_place", F.col("module").alias("fixture_module"),
                                                F.col("ordinal").alias("fixture_ordinal")),
        ["project", "name"], ["first_place"],
    )
    params = tests.select(*test_key, F.posexplode("parameters").alias("position", "p")).where("p.name NOT IN ('self', 'cls')")
    by_param = params.select(*KEY, "position", F.col("p.name").alias("name")).join(named, ["project", "name"]).select(
        *KEY, F.lit(0).alias("form"), "position", "fixture_module", "fixture_ordinal"
    )
    classes = tables.classes.groupBy("project", "qualified_name").agg(
        F.max(F.struct("module", "ordinal")).alias("c")
    ).select("project", F.col("qualified_name").alias("owner"), F.col("c.module").alias("fixture_module"),
             F.col("c.ordinal").alias("class_ordinal"))
    around = tables.functions.where(
        (F.col("kind") == "method") & F.lower("name").isin(*rules.SETUP_NAMES, *rules.TEARDOWN_NAMES)
    ).select("project", F.col("module").alias("fixture_module"), "class_ordinal", F.col("ordinal").alias("fixture_ordinal"))
    of_class = tests.where("kind = 'method'").select(
        *test_key, F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("owner")
    ).join(classes, ["project", "owner"]).join(around, ["project", "fixture_module", "class_ordinal"]).select(
        *KEY, F.lit(1).alias("form"), F.col("fixture_ordinal").alias("position"), "fixture_module", "fixture_ordinal"
    )
    return by_param.unionByName(of_class)


def fixture_flags(name: Column, decorators: Column, form: Column) -> tuple[Column, Column]:
    """Set-up and tear-down flags: of class fixtures by name, of others by decorator, failing that by name."""
    low = F.lower(name)
    lowered = F.transform(decorators, lambda d: F.lower(d))
    decorated = [any_contains(lowered, [w]) for w in ("setup", "teardown")]
    fallback = [F.contains(low, F.lit(w)) for w in ("setup", "teardown")]
    unmarked = ~decorated[0] & ~decorated[1]
    out = []
    for i, exact in enumerate((rules.SETUP_NAMES, rules.TEARDOWN_NAMES)):
        loose = F.when(unmarked, fallback[i]).otherwise(decorated[i])
        out.append(F.when(form == 1, low.isin(*exact)).otherwise(loose))
    return out[0], out[1]


def fixtures(tables: SymbolTables, tests: DataFrame) -> DataFrame:
    """Fixtures of each test with their metrics."""
    metrics = function_metrics(tables).withColumnRenamed("module", "fixture_module").withColumnRenamed("function_ordinal", "fixture_ordinal")
    setup, teardown = fixture_flags(F.col("name"), F.col("decorators"), F.col("form"))
    return fixture_uses(tables, tests).join(metrics, ["project", "fixture_module", "fixture_ordinal"]).select(
        *KEY, "form", "position", setup.alias("is_setup"), teardown.alias("is_teardown"), "qualified_class_name",
        F.col("fixture_module").alias("qualified_module_name"), "method_signature", "ncloc", "number_of_mocking_used",
        "cyclomatic_complexity", "number_of_constructor_call", "number_of_library_call", "number_of_application_call",
    )


def helper_uses(tables: SymbolTables, tests: DataFrame) -> DataFrame:
    """``(test, call, helper)``: application calls resolved in the test's module, then in its class.

    One row per call site, so a helper called twice counts twice. A module function hides class methods of
    its name even when it is itself a test. (A bare callee name cannot equal a dotted qualified name, so the
    lookup by qualified name never resolves and is left out.)
    """
    own = tests.select("project", "module", F.col("ordinal").alias("function_ordinal"), "kind", "class_ordinal")
    calls = tables.call_sites.where("is_application_call AND NOT startswith(method_name, 'test_')").select(
        *KEY, "ordinal", F.col("method_name").alias("name")).join(own, KEY)
    target = ["name", "is_test", F.col("ordinal").alias("helper_ordinal")]
    top = earliest(tables.functions.where("kind = 'function'").select("project", "module", *target),
                   ["project", "module", "name"], ["helper_ordinal"])
    in_class = earliest(tables.functions.where("kind = 'method'").select("project", "module", "class_ordinal", *target),
                        ["project", "module", "class_ordinal", "name"], ["helper_ordinal"])
    first = top.select("project", "module", "name", F.struct("helper_ordinal", "is_test").alias("t"))
    second = in_class.select("project", "module", "class_ordinal", "name", F.struct("helper_ordinal", "is_test").alias("m"))
    found = calls.join(first, ["project", "module", "name"], "left").join(
        second, ["project", "module", "class_ordinal", "name"], "left"
    )
    hit = F.coalesce("t", "m")
    return found.select(*KEY, "ordinal", "name", hit["helper_ordinal"].alias("helper_ordinal"), hit["is_test"].alias("_test")).where(
        "helper_ordinal IS NOT NULL AND NOT _test"
    ).drop("_test", "name")


def helpers(tables: SymbolTables, tests: DataFrame) -> DataFrame:
    """Helpers of each test with their metrics."""
    metrics = function_metrics(tables).withColumnRenamed("function_ordinal", "helper_ordinal")
    return helper_uses(tables, tests).join(metrics, ["project", "module", "helper_ordinal"]).select(
        *KEY, F.col("ordinal").alias("position"), "qualified_class_name", F.col("module").alias("qualified_module_name"),
        "method_signature", "ncloc", "number_of_mocking_used", "cyclomatic_complexity", "number_of_constructor_call",
        "number_of_library_call", "number_of_application_call", "number_of_assertions",
    )


def test_complexity(tables: SymbolTables, tests: DataFrame | None = None) -> DataFrame:
    """Complexity record of each test: its metrics and the number of fixtures and helpers it uses."""
    known = materialize(lookup(tables))
    if tests is None:
        tests = known.where("is_test OR startswith(name, 'test_')")
    keys = tests.select("project", "module", F.col("ordinal").alias("function_ordinal"))
    count = F.count(F.lit(1))
    used = fixture_uses(tables, tests, known).groupBy(*KEY).agg(count.alias("_fixtures"))
    helped = helper_uses(tables, tests).groupBy(*KEY).agg(count.alias("_helpers"))
    return (
        function_metrics(tables).join(keys, KEY, "left_semi").join(used, KEY, "left").join(helped, KEY, "left")
        .select(
            "project", F.col("name").alias("test_name"), "qualified_name", F.col("module").alias("qualified_module_name"),
            "file_path", "start_line", "end_line", "ncloc", "cyclomatic_complexity", "number_of_constructor_call",
            "number_of_library_call", "number_of_application_call", "number_of_mocking_used", "number_of_assertions",
            F.coalesce("_fixtures", F.lit(0)).alias("number_of_fixtures_used"),
            F.coalesce("_helpers", F.lit(0)).alias("number_of_helper_methods"), "is_async",
        )
    )


test_complexity.__test__ = False
