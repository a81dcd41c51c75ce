"""Symbol tables of Python projects and the queries over them.

A module is one row of syntax facts; the tables are projections and explodes of those rows, so they cost
no shuffle and read only the nested columns they need. Tables are keyed by ``(project, module)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import any_contains, contains_any, is_code_line
from quillspark.operators.ordered import asof_backward
from quillspark.operators.store import earliest, latest
from quillspark.session import materialize
from quillspark.sources.pysource import parse_sources

# Built-in names, unittest lifecycle names and test decorator keywords.
BUILTINS = (
    "print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "open", "input", "type",
    "isinstance", "hasattr", "getattr", "setattr", "enumerate", "zip", "map", "filter", "sorted", "sum", "min", "max",
    "abs", "all", "any", "bool", "bytes", "chr", "ord", "dir", "eval", "exec", "format", "frozenset", "hash", "help",
    "hex", "id", "iter", "next", "object", "oct", "pow", "repr", "reversed", "round", "slice", "super", "vars",
)
LIFECYCLE = (
    "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule", "addCleanup", "assertRaises",
    "subTest",
)
TEST_DECORATOR_WORDS = (
    "test", "pytest", "unittest", "given", "parameteriz", "fixture", "mark", "setup", "teardown",
)


def is_test_path(path: Column) -> Column:
    """Test module: by file name, or by a folder whose name contains "test"."""
    name = F.substring_index(path, "/", -1)
    folders = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return (
        name.startswith("test_") | name.endswith("_test.py") | name.startswith("spec_") | name.endswith("_spec.py")
        | (name == "conftest.py") | F.exists(folders, lambda d: F.contains(d, F.lit("test")))
    )


def is_test_name(name: Column, decorators: Column) -> Column:
    lowered = F.transform(decorators, lambda d: F.lower(d))
    return name.startswith("test_") | name.endswith("_test") | any_contains(lowered, list(TEST_DECORATOR_WORDS))


def is_test_class(name: Column, bases: Column) -> Column:
    last = F.transform(bases, lambda b: F.lower(F.substring_index(b, ".", -1)))
    return name.startswith("Test") | name.endswith("Test") | any_contains(last, ["test"])


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"^(.+)\.[^.]*$", "$1")


@dataclass
class SymbolTables:
    """The tables of one or many projects."""

    modules: DataFrame
    module_imports: DataFrame
    imports: DataFrame
    classes: DataFrame
    functions: DataFrame
    call_sites: DataFrame
    lambdas: DataFrame
    asserts: DataFrame

    # Query surface; a missing key gives no rows, never an error.

    def module(self, file_path: str) -> DataFrame:
        return self.modules.where(F.col("file_path") == file_path)

    def top_level_functions(self) -> DataFrame:
        return self.functions.where("kind = 'function'")

    def methods(self) -> DataFrame:
        return self.functions.where("kind = 'method'")

    def find_class(self, qualified_name: str) -> DataFrame:
        return self.classes.where(F.col("qualified_name") == qualified_name).orderBy("module", "ordinal").limit(1)

    def find_function(self, qualified_name: str) -> DataFrame:
        return self.functions.where(F.col("qualified_name") == qualified_name).orderBy("module", "ordinal").limit(1)

    def classes_in_module(self, file_path: str) -> DataFrame:
        return self.classes.where(F.col("file_path") == file_path)

    def functions_in_module(self, file_path: str) -> DataFrame:
        return self.top_level_functions().where(F.col("file_path") == file_path)

    def methods_in_module(self, file_path: str) -> DataFrame:
        return self.methods().where(F.col("file_path") == file_path)

    def methods_in_class(self, qualified_name: str) -> DataFrame:
        owner = self.find_class(qualified_name).select("project", "module", F.col("ordinal").alias("class_ordinal"))
        return self.functions.join(owner, ["project", "module", "class_ordinal"], "left_semi")

    def parameters(self, qualified_name: str) -> DataFrame:
        return self.find_function(qualified_name).select(F.posexplode("parameters").alias("position", "p")).select(
            "position", "p.*"
        )

    def _calls_of(self, qualified_name: str) -> DataFrame:
        owner = self.find_function(qualified_name).select("project", "module", F.col("ordinal").alias("function_ordinal"))
        return self.call_sites.join(owner, ["project", "module", "function_ordinal"], "left_semi")

    def calling_lines(self, caller: str) -> DataFrame:
        return self._calls_of(caller).select("ordinal", "start_line")

    def call_targets(self, caller: str) -> DataFrame:
        return self._calls_of(caller).select("ordinal", "method_name")

    def classes_by_criteria(self, inclusions: Sequence[str] = (), exclusions: Sequence[str] = ()) -> DataFrame:
        """Classes by substrings of the qualified name; of equal names the last stays."""
        name = F.col("qualified_name")
        kept = self.classes
        if inclusions:
            kept = kept.where(contains_any(name, list(inclusions)))
        if exclusions:
            kept = kept.where(~contains_any(name, list(exclusions)))
        return latest(kept, ["project", "qualified_name"], ["module", "ordinal"])

    def test_methods(self) -> DataFrame:
        """Functions named ``test_*`` and all methods of test classes, the first per qualified name.

        Named functions come before methods of test classes when names collide.
        """
        named = F.col("name").startswith("test_")
        rows = self.functions.where(named | F.col("in_test_class")).withColumn("_late", ~named)
        return earliest(rows, ["project", "qualified_name"], ["_late", "module", "ordinal"]).drop("_late")

    def methods_with_decorators(self, substrings: Sequence[str]) -> DataFrame:
        return self.functions.where(any_contains(F.col("decorators"), list(substrings)))


def _spread(sources: DataFrame) -> DataFrame:
    """Sources over all partitions. Their number is given, because texts are small for the time that parsing takes: by
    bytes, partitions would be merged to about as many as there are cores."""
    wanted = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sources.repartition(wanted, "project", "qualified_name")


def decorated_functions(sources: DataFrame, substrings: Sequence[str], spread: bool = False) -> DataFrame:
    """Functions and methods with a decorator that holds any of ``substrings``, straight from the sources.

    It finds the rows of ``SymbolTables.methods_with_decorators`` without tables: only headers are read, nothing
    is stored. Functions of a source that parses are there even where a statement is too deep for the tables.
    """
    parsed = parse_sources(_spread(sources) if spread else sources, headers=True)
    rows = parsed.select(
        "project", F.col("qualified_name").alias("module"), "file_path", _stem(F.col("file_path")).alias("_stem"), "classes",
        F.explode("functions").alias("f"),
    ).where(any_contains(F.col("f.decorators"), list(substrings)))
    owner = F.get("classes", F.col("f.class_ordinal"))["class_name"]
    return rows.select("project", "module", "file_path", F.concat_ws(".", "_stem", owner, "f.name").alias("qualified_name"),
                       "f.name", owner.alias("class_name"), "f.decorators")


def build_parsed(sources: DataFrame, spread: bool = False) -> DataFrame:
    """Parse once and store: the analysis cache every table reads from.

    A file scan already comes in even splits, so texts are not shuffled; ``spread`` is for sources that
    arrive in few partitions.
    """
    lines = F.split("text", r"\r\n|\r|\n")
    numbered = F.transform(lines, lambda line, i: F.when(is_code_line(line), i + 1))
    code = F.coalesce(F.filter(numbered, lambda n: n.isNotNull()), F.array().cast("array<int>"))
    if spread:
        sources = _spread(sources)
    return materialize(parse_sources(sources).withColumn("code_lines", code).drop("text"))


class _StoredOnUse(SymbolTables):
    """Tables of which each is stored when it is first asked for."""

    def __init__(self, views: SymbolTables):
        self._views = views

    def __getattr__(self, name: str) -> DataFrame:
        if name not in {f.name for f in fields(SymbolTables)}:
            raise AttributeError(name)
        table = materialize(getattr(self._views, name))
        setattr(self, name, table)
        return table


def build_tables(parsed: DataFrame) -> SymbolTables:
    """The tables of parsed modules, stored flat so that each query reads only its columns and rows.

    A table is stored when it is first used: a query pays for the tables that it reads.
    """
    return _StoredOnUse(table_views(parsed))


def save_tables(tables: SymbolTables, path: str) -> None:
    """Store an analysis under a name of the caller's choice; it replaces what was stored there."""
    for f in fields(tables):
        getattr(tables, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")


def load_tables(spark: SparkSession, path: str) -> SymbolTables | None:
    """The analysis stored under ``path``, or None when none was."""
    from quillspark.sources.files import exists

    if not exists(spark, f"{path}/{fields(SymbolTables)[-1].name}/_SUCCESS"):
        return None  # the last table is written last
    return SymbolTables(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(SymbolTables)})


def table_views(parsed: DataFrame) -> SymbolTables:
    """The tables as projections of parsed modules, without storing them."""
    key = [F.col("project"), F.col("qualified_name").alias("module"), F.col("file_path")]
    # Names under which symbols were imported. It and the stem are told once a module, not for each function and call.
    pairs = F.flatten(
        F.transform(
            "imports",
            lambda i: F.transform(
                F.filter(i["imports"], lambda n: n != ""),
                lambda n: F.struct(
                    n.alias("n"),
                    F.when(i["from_statement"] == "", n).otherwise(F.concat_ws(".", i["from_statement"], n)).alias("q"),
                ),
            ),
        )
    )
    parsed = parsed.withColumn("_stem", _stem(F.col("file_path"))).withColumn("_pairs", pairs)
    stem = F.col("_stem")
    # An unreadable or invalid file is never a test module, whatever its path.
    modules = parsed.select(
        *key, stem.alias("stem"), (F.col("valid") & is_test_path(F.col("qualified_name"))).alias("is_test")
    )

    origins = F.transform("imports", lambda i: i["from_statement"])
    names = F.flatten(F.transform("imports", lambda i: i["imports"]))
    module_imports = parsed.select(
        "project", F.col("qualified_name").alias("module"), F.filter(origins, lambda o: o != "").alias("origins"),
        F.array_distinct(F.concat(origins, names)).alias("texts"),
    )
    imports = parsed.select(*key, F.explode("imports").alias("i")).select(
        "project", "module", "file_path", "i.ordinal", "i.from_statement", "i.imports"
    )

    def class_flag(c: Column) -> Column:
        return is_test_class(c["class_name"], c["bases"])

    classes = parsed.select(*key, stem.alias("stem"), F.explode("classes").alias("c")).select(
        "project", "module", "file_path", "c.ordinal",
        F.concat_ws(".", "stem", "c.class_name").alias("qualified_name"), "c.class_name", "c.bases", "c.decorators",
        "c.docstring", "c.start_line", "c.end_line", class_flag(F.col("c")).alias("is_test_class"),
    )

    def function_row(f: Column) -> Column:
        owner = F.get("classes", f["class_ordinal"])
        in_test = F.coalesce(class_flag(owner), F.lit(False))
        is_method = f["class_ordinal"].isNotNull()
        named = is_test_name(f["name"], f["decorators"]) | (is_method & f["name"].isin(*LIFECYCLE))
        ncloc = F.size(F.filter("code_lines", lambda n: (n >= f["start_line"]) & (n <= f["end_line"])))
        branches = f["branches"] + 1
        statements = F.filter("asserts", lambda a: (a["line"] >= f["start_line"]) & (a["line"] <= f["end_line"]))
        return F.struct(
            f["ordinal"].alias("ordinal"), f["class_ordinal"].alias("class_ordinal"),
            owner["class_name"].alias("class_name"),
            F.concat_ws(".", stem, owner["class_name"], f["name"]).alias("qualified_name"), f["name"].alias("name"),
            F.when(is_method, "method").otherwise("function").alias("kind"), f["parameters"].alias("parameters"),
            f["return_type"].alias("return_type"), f["decorators"].alias("decorators"),
            f["docstring"].alias("docstring"), (named | in_test).alias("is_test"), in_test.alias("in_test_class"),
            f["is_async"].alias("is_async"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line"),
            ncloc.alias("ncloc"), (branches + f["bool_operators"]).alias("complexity"),
            F.when(f["is_async"], 1).otherwise(branches + f["asserts"] + f["bool_ops"]).alias("test_complexity"),
            statements.alias("assert_statements"),
        )

    functions = parsed.select(*key, F.explode(F.transform("functions", function_row)).alias("f")).select(
        "project", "module", "file_path", "f.*"
    )

    def imported(name: Column) -> Column:
        """Qualified name under which a symbol was imported; the last import of a name wins."""
        return F.try_element_at(F.filter("_pairs", lambda p: p["n"] == name), F.lit(-1))["q"]

    def call_row(c: Column) -> Column:
        owner = F.get("functions", c["function_ordinal"])
        return F.struct(
            c.alias("c"), owner["name"].alias("function_name"),
            F.concat_ws(".", stem, F.get("classes", owner["class_ordinal"])["class_name"], owner["name"]).alias("function"),
            F.when(c["receiver_form"] == "name", imported(c["receiver"])).alias("receiver_import"),
            F.when(c["form"] == "name", imported(c["callee"])).alias("callee_import"),
        )

    raw = parsed.select(*key, F.explode(F.transform("calls", call_row)).alias("x")).select(
        "project", "module", "file_path", "x.c.*", "x.function", "x.function_name", "x.receiver_import", "x.callee_import"
    )
    return SymbolTables(
        modules=modules, module_imports=module_imports, imports=imports, classes=classes, functions=functions, call_sites=_call_sites(raw),
        lambdas=parsed.select(*key, F.explode("lambdas").alias("l")).select("project", "module", "file_path", "l.*"),
        asserts=parsed.select(*key, F.explode("asserts").alias("a")).select("project", "module", "file_path", "a.*"),
    )


def _upper_initial(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}")


def _call_sites(raw: DataFrame) -> DataFrame:
    """Call sites with receiver, argument names and the library/application classification."""
    form, callee, receiver = F.col("form"), F.col("callee"), F.col("receiver")
    by_name, by_attribute = form == "name", form == "attribute"
    constructor = by_name & _upper_initial(callee)
    static_receiver = (F.col("receiver_form") == "name") & _upper_initial(receiver)
    long_receiver = (F.col("receiver_form") == "expression") & (F.length(receiver) > 50)
    receiver_type = (
        F.when(static_receiver, receiver)
        .when(F.col("receiver_form") == "name", F.col("receiver_import"))
        .when(by_attribute & ~long_receiver, F.col("receiver_callee"))
        .when(constructor, F.substring_index("callee_import", ".", -1))
    )
    short = lambda a: F.when(F.length(a["text"]) < 20, a["text"]).otherwise("<constant>")
    argument = lambda a: F.struct(
        F.when(a["kind"] == "name", a["text"]).when(a["kind"] == "constant", short(a))
        .when(a["kind"] == "keyword", a["keyword"]).when(a["kind"] == "unpacked", "**kwargs").otherwise("<expr>")
        .alias("name"),
        F.when(a["kind"].isin("keyword", "unpacked"), a["text"]).alias("annotation"),
    )
    expression = lambda a: F.when(
        a["kind"].isin("keyword", "unpacked"), F.concat(F.coalesce(a["keyword"], F.lit("None")), F.lit("="), a["text"])
    ).otherwise(a["text"])
    named = raw.select(
        "project", "module", "file_path", "ordinal", "function_ordinal", "function", "function_name",
        F.when((form == "expression") & (F.length(callee) > 50), "<complex_call>").otherwise(callee).alias("method_name"),
        F.when(long_receiver, "<complex_expr>").otherwise(receiver).alias("receiver_expr"),
        receiver_type.alias("receiver_type"),
        F.transform("args", argument).alias("arguments"), F.transform("args", expression).alias("argument_expr"),
        (constructor | (by_attribute & static_receiver)).alias("is_static_call"),
        constructor.alias("is_constructor_call"),
        F.when(callee.isin(*BUILTINS), False).otherwise(
            F.col("callee_is_function") | F.col("receiver_is_class") | (constructor & F.col("callee_is_class"))
        ).alias("is_application_call"),
        "start_line", "start_column", "end_line", "end_column",
    )
    listed = F.array_join(F.transform("arguments", lambda a: a["name"]), ", ")
    return named.withColumn("is_library_call", ~F.col("is_application_call")).withColumn(
        "method_signature", F.concat("method_name", F.lit("("), listed, F.lit(")"))
    )


def with_inferred_receivers(call_sites: DataFrame, inferred: DataFrame) -> DataFrame:
    """Receiver types filled from an optional inference table ``(project, module, function_name, variable, line, types)``.

    The nearest record at or before the call's line counts; of its types the first in order, if it looks like
    a class. An inferred type goes before the import map.
    """
    keys = ["project", "module", "function_name", "variable"]
    asked = call_sites.withColumn("variable", F.col("receiver_expr")).withColumn(
        "call_id", F.to_json(F.struct("project", "module", "ordinal"))
    )
    facts = inferred.withColumn("line_id", F.to_json(F.struct("types"))).withColumn("_t", F.array_sort("types")[0])
    near = asof_backward(
        asked.withColumn("line", F.col("start_line")), facts, keys, "line", "call_id", "line_id", "_t"
    ).where(_upper_initial(F.col("_t"))).select("call_id", F.substring_index("_t", ".", -1).alias("_inferred"))
    static = _upper_initial(F.col("receiver_expr"))
    return asked.join(near, "call_id", "left").withColumn(
        "receiver_type", F.when(static, F.col("receiver_type")).otherwise(F.coalesce("_inferred", "receiver_type"))
    ).select(*call_sites.columns)


def _position(line: Column, column: Column) -> Column:
    return line.cast("long") * 2**32 + column.cast("long")


def local_types(parsed: DataFrame) -> DataFrame:
    """``project, module, function_ordinal, variable, at, type_id, type`` of the names bound inside functions of parsed sources.

    From ``at`` (line and column as one number) on, ``variable`` is an instance of ``type``, or of nothing known
    (null). Known are what a call of a capitalised name makes, an annotation, an annotated parameter, and a name that
    was one of these when it was bound to another. Statements count in the order of the text, whatever the branches.
    Names bound to names form chains; each points at the binding its source had, and pointers are doubled to the end.
    """
    keys = ["project", "module", "function_ordinal", "variable"]
    known = lambda c: F.when(c.rlike(r"^(\w+\.)*\p{Lu}\w*$"), F.substring_index(c, ".", -1))
    bound = parsed.select("project", F.col("qualified_name").alias("module"), F.explode("assignments").alias("a")).select(
        "project", "module", "a.*")
    given = F.explode(F.transform("functions", lambda f: F.struct(
        f["ordinal"].alias("function_ordinal"), f["start_line"].alias("line"), F.filter(f["parameters"], lambda p: p["annotation"].isNotNull()).alias("p"))))
    parameters = parsed.select("project", F.col("qualified_name").alias("module"), given.alias("f")).select(
        "project", "module", "f.function_ordinal", "f.line", F.posexplode("f.p").alias("pos", "p"))
    facts = materialize(bound.select(
        *keys, _position(F.col("end_line"), F.col("end_column")).alias("at"), _position(F.col("start_line"), F.col("start_column")).alias("_from"),
        F.to_json(F.struct("project", "module", "ordinal")).alias("type_id"),
        F.when(F.col("form") == "name", F.col("value")).alias("_source"), F.when(F.col("form").isin("call", "annotation"), known(F.col("value"))).alias("type"),
    ).unionByName(parameters.select(
        "project", "module", "function_ordinal", F.col("p.name").alias("variable"), _position(F.col("line"), F.lit(0)).alias("at"),
        F.lit(None).cast("long").alias("_from"), F.to_json(F.struct("project", "module", "function_ordinal", "pos")).alias("type_id"),
        F.lit(None).cast("string").alias("_source"), known(F.col("p.annotation")).alias("type"),
    )))
    asked = facts.where("_source IS NOT NULL").select(
        *keys[:3], F.col("_source").alias("variable"), F.col("_from").alias("at"), F.col("type_id").alias("_asking"))
    named = facts.withColumn("_id", F.col("type_id"))
    chain = materialize(asof_backward(asked, named, keys, "at", "_asking", "type_id", "_id").select(
        F.col("_asking").alias("node"), F.col("_id").alias("next")).where("next IS NOT NULL"))
    while True:
        ahead = chain.select(F.col("node").alias("next"), F.col("next").alias("_then"))
        longer = materialize(chain.join(ahead, "next", "left").select("node", F.coalesce("_then", "next").alias("next"), F.col("_then").isNotNull().alias("_moved")))
        if longer.where("_moved").isEmpty():
            break
        chain = longer.select("node", "next")
    ends = chain.join(facts.select(F.col("type_id").alias("next"), F.col("type").alias("_end")), "next").select(F.col("node").alias("type_id"), "_end")
    return facts.join(ends, "type_id", "left").select(*keys, "at", "type_id", F.coalesce("type", "_end").alias("type"))


def with_local_receivers(call_sites: DataFrame, types: DataFrame) -> DataFrame:
    """Call sites whose receiver is a name with a known type (``local_types``) get that type; any other row stays.

    A capitalised receiver is a class of its own name, as in the call sites.
    """
    keys = ["project", "module", "function_ordinal", "variable"]
    call_id = F.to_json(F.struct("project", "module", "ordinal"))
    asked = call_sites.where(F.col("receiver_expr").rlike(r"^\w+$") & ~_upper_initial(F.col("receiver_expr"))).select(
        *keys[:3], F.col("receiver_expr").alias("variable"), _position(F.col("start_line"), F.col("start_column")).alias("at"), call_id.alias("_call"))
    near = asof_backward(asked, types, keys, "at", "_call", "type_id", "type").where("type IS NOT NULL").select("_call", F.col("type").alias("_type"))
    return call_sites.withColumn("_call", call_id).join(near, "_call", "left").withColumn(
        "receiver_type", F.coalesce("_type", "receiver_type")).select(*call_sites.columns)


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, span: str,
                       width: int = 64) -> DataFrame:
    """For each point the smallest span of its key holding it, ties to the lower span id.

    A range join made an equi join on line buckets; spans nest, so a point meets few of them. ``points`` has
    ``line``, ``spans`` has ``start_line`` and ``end_line``.
    """
    cut = spans.select(*keys, span, "start_line", "end_line", F.explode(
        F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))
    ).alias("_b"))
    at = points.withColumn("_b", F.floor(F.col("line") / width))
    inside = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    rest = [c for c in points.columns if c not in keys]
    return (
        at.join(cut, [*keys, "_b"]).where(inside)
        .groupBy(*keys, *rest)
        .agg(F.min_by(span, F.struct(F.col("end_line") - F.col("start_line"), F.col(span))).alias(span))
    )
