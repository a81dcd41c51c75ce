"""Agent detection: functions that build agents, and functions that call those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import any_contains, list_items, module_stem, strip
from quillspark.operators import rules
from quillspark.operators.store import earliest, latest
from quillspark.operators.substrings import substring_pairs
from quillspark.operators.symbols import SymbolTables
from quillspark.session import materialize

FUNCTION_KEY = ["project", "module", "function_ordinal"]


def _gates(texts: Column, origins: Column) -> Column:
    """Frameworks whose agents may live in a module, by what it imports."""
    imports = {r.framework: r.imports for r in rules.AGENT_RULES}
    hits = [
        F.when(any_contains(origins if name == "haystack" else texts, list(p)), F.lit(name))
        for name, p in imports.items()
    ]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _candidates() -> Column:
    """Agent rules a call site meets, as an array of structs."""
    called, receiver = F.col("method_name"), F.col("receiver_type")
    out = []
    for rank, rule in enumerate(rules.AGENT_RULES):
        met = called.isin(*rule.names)
        if rule.constructor:
            met = met & F.col("is_constructor_call")
        if rule.receiver:
            met = met & F.coalesce(F.contains(receiver, F.lit(rule.receiver)), F.lit(False)) & F.col("receiver_known")
        head, _, tail = rule.description.partition("{}")
        text = F.concat(F.lit(head), called, F.lit(tail)) if "{}" in rule.description else F.lit(rule.description)
        out.append(F.when(met, F.struct(
            F.lit(rule.framework).alias("framework"), F.lit(rank).alias("rank"), text.alias("description"),
            F.lit(rule.fills_tools).alias("fills_tools"),
        )))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def factory_agents(tables: SymbolTables, detected: DataFrame) -> DataFrame:
    """Functions holding a framework's agent-making call, once per framework, function and module.

    One plan over the rules serves all frameworks: calls by name, then the module's imports, then the
    project's detected frameworks, then the first call per function.
    """
    names = sorted({n for r in rules.AGENT_RULES for n in r.names})
    receivers = [r.receiver for r in rules.AGENT_RULES if r.receiver]
    knows = tables.module_imports.where(any_contains(F.col("texts"), receivers)).select("project").distinct()
    calls = tables.call_sites.where(F.col("method_name").isin(*names)).select(
        "project", "module", "function_ordinal", "ordinal", "method_name", "receiver_type", "is_constructor_call"
    )
    calls = calls.join(knows.withColumn("_k", F.lit(True)), "project", "left").withColumn("receiver_known", F.col("_k").isNotNull())
    hits = calls.select(*FUNCTION_KEY, "ordinal", F.explode(_candidates()).alias("r")).select(*FUNCTION_KEY, "ordinal", "r.*")
    gates = tables.module_imports.select("project", "module", F.explode(_gates(F.col("texts"), F.col("origins"))).alias("framework"))
    allowed = hits.join(gates, ["project", "module", "framework"], "left_semi").join(
        detected, ["project", "framework"], "left_semi"
    )
    owners = tables.functions.select(
        "project", "module", F.col("ordinal").alias("function_ordinal"), "name", "qualified_name", "ncloc", "complexity"
    )
    placed = allowed.join(owners, FUNCTION_KEY)
    first = earliest(placed, ["project", "framework", "module", "qualified_name"], ["rank", "function_ordinal", "ordinal"])
    return first.select(
        *FUNCTION_KEY, "framework", "name", F.lit("factory").alias("agent_type"), F.lit("").alias("qualified_class_name"),
        F.col("qualified_name").alias("method_signature"), "description", "fills_tools", "ncloc", "complexity",
        F.lit(None).cast("array<string>").alias("factory_agent_names"),
    )


def _framework_order(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in rules.FRAMEWORKS]), name)


def factory_importers(tables: SymbolTables, agents: DataFrame) -> DataFrame:
    """Non-test modules importing a module that holds factory agents.

    By text: the agent module's stem occurs in a ``from`` origin, or is one of the last two dotted parts of
    an imported name.
    """
    stems = agents.select("project", module_stem(F.col("module")).alias("stem")).where("stem <> ''").distinct()
    plain = tables.modules.where("NOT is_test").select("project", "module")
    imports = tables.imports.join(plain, ["project", "module"], "left_semi")
    origins = imports.where("from_statement <> ''").select("project", "module", "from_statement")
    by_origin = origins.join(
        substring_pairs(origins, stems, "project", "from_statement", "stem").select("project", "from_statement").distinct(),
        ["project", "from_statement"], "left_semi",
    )
    parts = imports.select("project", "module", F.explode("imports").alias("n")).select(
        "project", "module", F.explode(F.slice(F.split("n", r"\."), F.lit(-1) * F.least(F.lit(2), F.size(F.split("n", r"\."))), F.lit(2))).alias("stem")
    )
    by_name = parts.join(stems, ["project", "stem"], "left_semi")
    return by_origin.select("project", "module").unionByName(by_name.select("project", "module")).distinct()


def calling_agents(tables: SymbolTables, agents: DataFrame) -> DataFrame:
    """Non-test functions in importing modules that call a factory agent or pass one as an argument.

    A call counts when it names an agent of its own module; otherwise its argument names are compared with
    agent names. (A call's printed signature can never equal a qualified name, so that test is left out.)
    An agent name stands for the last agent of that name.
    """
    by_name = latest(
        agents.select("project", "name", F.col("module").alias("agent_module"), "method_signature",
                      _framework_order(F.col("framework")).alias("_fw"), F.col("function_ordinal").alias("_fo")),
        ["project", "name"], ["_fw", "agent_module", "_fo"],
    ).select("project", "name", "agent_module", "method_signature")
    # Read several times below, and no larger than the list of modules.
    importers = materialize(factory_importers(tables, agents))
    functions = tables.functions.where("NOT is_test").join(importers, ["project", "module"], "left_semi").select(
        "project", "module", F.col("ordinal").alias("function_ordinal"), "name", "qualified_name", "kind", "ncloc", "complexity"
    )
    calls = tables.call_sites.join(functions.select(*FUNCTION_KEY), FUNCTION_KEY, "left_semi").select(
        *FUNCTION_KEY, "ordinal", "method_name", "arguments"
    )
    own = by_name.select("project", F.col("name").alias("method_name"), F.col("agent_module").alias("module"), "method_signature")
    named = calls.join(own, ["project", "method_name", "module"], "left")
    direct = named.where("method_signature IS NOT NULL").select(
        *FUNCTION_KEY, F.struct("ordinal", F.lit(-1).alias("arg")).alias("place"), "method_signature"
    )
    # The first place of each argument name per function is all that matters, and keeps popular names small.
    passed = named.where("method_signature IS NULL").select(*FUNCTION_KEY, "ordinal", F.posexplode("arguments").alias("arg", "a"))
    passed = passed.groupBy(*FUNCTION_KEY, F.col("a.name").alias("name")).agg(F.min(F.struct("ordinal", "arg")).alias("place"))
    indirect = passed.join(by_name, ["project", "name"]).select(*FUNCTION_KEY, "place", "method_signature")
    called = direct.unionByName(indirect).groupBy(*FUNCTION_KEY, "method_signature").agg(F.min("place").alias("place"))
    frameworks = agents.groupBy("project", "method_signature").agg(F.min("framework").alias("framework"))
    listed = called.join(frameworks, ["project", "method_signature"]).groupBy(*FUNCTION_KEY).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "method_signature"))), lambda x: x["method_signature"])
        .alias("factory_agent_names"),
        F.min("framework").alias("framework"),
    )
    rows = functions.join(listed, FUNCTION_KEY)
    rows = earliest(rows, ["project", "module", "qualified_name"], ["function_ordinal"])
    owner = F.when(F.col("kind") == "method", F.regexp_replace("qualified_name", r"\.[^.]*$", "")).otherwise("")
    return rows.select(
        *FUNCTION_KEY, "framework", "name", F.lit("caller").alias("agent_type"), owner.alias("qualified_class_name"),
        F.col("qualified_name").alias("method_signature"),
        F.concat(F.lit("Calling agent that invokes: "), F.array_join("factory_agent_names", ", ")).alias("description"),
        F.lit(True).alias("fills_tools"), "ncloc", "complexity", "factory_agent_names",
    )


def detect_agents(tables: SymbolTables, detected: DataFrame) -> DataFrame:
    """Factory agents followed by their callers."""
    factories = materialize(factory_agents(tables, detected))
    return factories.unionByName(calling_agents(tables, factories))


def agent_tools(tables: SymbolTables, agents: DataFrame) -> DataFrame:
    """Tools an agent's function binds or passes as ``tools=[...]``, each name once in order of appearance."""
    wanted = agents.where("fills_tools").select(*FUNCTION_KEY, "framework", "method_signature")
    calls = tables.call_sites.where(F.col("method_name").isin(*rules.TOOL_METHODS) | F.col("is_constructor_call")).select(
        *FUNCTION_KEY, "ordinal", "is_constructor_call", F.col("method_name").isin(*rules.TOOL_METHODS).alias("binds"),
        F.posexplode(F.arrays_zip("argument_expr", "arguments")).alias("arg", "a"),
    )
    expr = F.col("a.argument_expr")
    has_list = F.contains(expr, F.lit("[")) & F.contains(expr, F.lit("]"))
    quoted = expr.startswith('"') | expr.startswith("'")
    bare = F.filter(F.array(strip(expr)), lambda t: t != "")
    bound = F.when(F.col("binds") & ~quoted, F.when(has_list, list_items(expr)).otherwise(bare))
    given = F.when(F.col("is_constructor_call") & (F.col("a.arguments.name") == "tools") & has_list, list_items(expr))
    refs = calls.select(*FUNCTION_KEY, "ordinal", "arg", F.posexplode(F.coalesce(bound, given)).alias("item", "tool_name"))
    once = refs.groupBy(*FUNCTION_KEY, "tool_name").agg(F.min(F.struct("ordinal", "arg", "item")).alias("position"))
    return wanted.join(once, FUNCTION_KEY).select(
        "project", "framework", "tool_name", F.lit("function_tool").alias("tool_type"),
        F.lit(None).cast("string").alias("tool_description"), F.col("method_signature").alias("tool_binding_method"),
        F.col("module").alias("tool_binding_module"), "position",
    )


def call_details(tables: SymbolTables, agents: DataFrame) -> DataFrame:
    """Each agent's calls, split constructor before application before library, and the objects it creates."""
    wanted = agents.select(*FUNCTION_KEY).distinct()
    kind = F.when(F.col("is_constructor_call"), "constructor").when(F.col("is_application_call"), "application").otherwise("library")
    return tables.call_sites.join(wanted, FUNCTION_KEY, "left_semi").select(
        *FUNCTION_KEY, "ordinal", kind.alias("call_kind"), "method_name",
        F.coalesce("receiver_type", F.lit("")).alias("qualified_class_name"),
        F.col("module").alias("qualified_module_name"), F.col("method_signature").alias("qualified_method_signature"),
        F.col("start_line").alias("line_number"), F.col("start_column").alias("column_number"), "receiver_type",
    )


def with_objects_created(tables: SymbolTables, agents: DataFrame) -> DataFrame:
    made = call_details(tables, agents).where("call_kind = 'constructor'").groupBy(*FUNCTION_KEY).agg(
        F.count(F.lit(1)).alias("_made")
    )
    return agents.join(made, FUNCTION_KEY, "left").withColumn(
        "number_of_objects_created", F.coalesce("_made", F.lit(0))
    ).drop("_made")


def importing_test_modules(tables: SymbolTables, agents: DataFrame) -> DataFrame:
    """Test modules importing an agent by name (or ``*``) from its module, or importing the module itself."""
    modules = tables.modules.where("is_test OR contains(lower(file_path), 'test')").select("project", "module")
    imports = tables.imports.join(modules, ["project", "module"], "left_semi")
    bare = F.replace(F.col("module"), F.lit(".py"), F.lit(""))
    spelled = F.array_distinct(F.array(F.col("module"), F.when(F.col("module").endswith(".py"), bare).otherwise(F.col("module"))))
    keys = agents.select("project", "name", F.explode(spelled).alias("agent_module")).distinct()
    origins = imports.where("from_statement <> ''")
    pairs = substring_pairs(origins, keys, "project", "from_statement", "agent_module")
    asked = origins.select("project", "module", "from_statement", F.explode("imports").alias("name"))
    near = asked.join(pairs, ["project", "from_statement"])
    by_name = near.join(keys, ["project", "agent_module", "name"], "left_semi")
    by_star = near.where("name = '*'")
    whole = imports.select("project", "module", F.explode("imports").alias("agent_module")).join(
        keys, ["project", "agent_module"], "left_semi"
    )
    picked = [d.select("project", "module") for d in (by_name, by_star, whole)]
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).distinct()


def agent_uses(tables: SymbolTables, agents: DataFrame, functions: DataFrame) -> DataFrame:
    """``(function, agent)`` pairs: the function calls the agent's name, or names its signature in a call."""
    calls = tables.call_sites.join(functions.select(*FUNCTION_KEY), FUNCTION_KEY, "left_semi")
    who = agents.select("project", "name", F.col("module").alias("agent_module"), "framework", "agent_type",
                        F.col("method_signature").alias("agent_signature"))
    by_name = calls.select(*FUNCTION_KEY, F.col("method_name").alias("name")).distinct().join(who, ["project", "name"])
    dotted = calls.where(F.contains("method_signature", F.lit("."))).select(*FUNCTION_KEY, F.col("method_signature").alias("text"))
    pairs = substring_pairs(dotted, who, "project", "text", "agent_signature")
    by_text = dotted.join(pairs, ["project", "text"]).join(who, ["project", "agent_signature"])
    columns = [*FUNCTION_KEY, "name", "agent_module", "framework", "agent_type", "agent_signature"]
    return by_name.select(*columns).unionByName(by_text.select(*columns)).distinct()


def agent_test_methods(tables: SymbolTables, agents: DataFrame) -> DataFrame:
    """Test functions that use agents, in test modules that import any; one row per function and agent."""
    modules = materialize(importing_test_modules(tables, agents))
    functions = tables.functions.join(modules, ["project", "module"], "left_semi").where(
        "(is_test OR startswith(name, 'test_')) AND (class_ordinal IS NULL OR in_test_class)"
    ).select(
        "project", "module", F.col("ordinal").alias("function_ordinal"), F.col("name").alias("method_declaration"),
        F.col("qualified_name").alias("method_signature"), F.col("decorators").alias("annotations"),
        F.when(F.col("kind") == "method", F.regexp_replace("qualified_name", r"\.[^.]*$", "")).otherwise("")
        .alias("qualified_class_name"),
        F.when(F.col("start_line") > 0, F.col("end_line") - F.col("start_line") + 1).otherwise(0).alias("ncloc"),
    )
    uses = agent_uses(tables, agents, functions)
    return functions.join(uses, FUNCTION_KEY)


def agent_test_fixtures(tables: SymbolTables, agents: DataFrame) -> DataFrame:
    """Non-test methods of test classes marked by an exact fixture decorator.

    Every method of a test class counts as a test, so this is empty unless a caller relaxes that flag.
    """
    modules = importing_test_modules(tables, agents)
    marked = F.arrays_overlap("decorators", F.array(*[F.lit(d) for d in rules.FIXTURE_DECORATORS]))
    lower = F.lower("name")
    return tables.functions.join(modules, ["project", "module"], "left_semi").where(
        "in_test_class AND NOT is_test AND NOT startswith(name, 'test_')"
    ).where(marked).select(
        "project", "module", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("qualified_class_name"),
        F.col("qualified_name").alias("method_signature"), F.contains(lower, F.lit("setup")).alias("is_setup"),
        F.contains(lower, F.lit("teardown")).alias("is_teardown"),
        (F.col("end_line") - F.col("start_line") + 1).alias("ncloc"),
    )
