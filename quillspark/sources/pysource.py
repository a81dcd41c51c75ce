"""The only place that reads Python syntax: one file's text to one row of plain syntax facts.

No rule of the analysis lives here. Names, positions and counts come out as arrays of structs, and every
test, classification, lookup and count over them is a Spark expression in ``operators``.
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.sources import schemas

#: Source text whose facts are held at a time; a file above it is a batch of its own.
FACTS_BATCH_CHARACTERS = 1 << 17

_BRANCHES = frozenset((ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With))
_BINDING = frozenset((ast.Assign, ast.AnnAssign, ast.NamedExpr, ast.withitem, ast.For, ast.AsyncFor, ast.AugAssign))
_COUNTED = _BRANCHES | {ast.Assert, ast.BoolOp}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_FIELDS = ("valid", "imports", "classes", "functions", "calls", "lambdas", "asserts", "assignments")
_NOTHING = {name: False if name == "valid" else [] for name in _FIELDS}

# Fields of each kind of node that may hold nodes to look at. Kinds without any, such as names and constants, are
# not looked at themselves: their parents say all about them.
_PLAIN = frozenset(("arg", "attr", "conversion", "ctx", "id", "is_async", "kind", "kwd_attrs", "level", "module", "name", "names", "op",
                    "ops", "rest", "simple", "tag", "type_comment", "type_ignores"))
_INNER = {
    kind: inner for kind in vars(ast).values()
    if isinstance(kind, type) and issubclass(kind, ast.AST) and kind is not ast.Constant
    and (inner := tuple(f for f in kind._fields if f not in _PLAIN))
}
_ARGUMENT_KINDS = {ast.Name: "name", ast.Constant: "constant"}
_PRINTED = frozenset((str, int, bool, type(None)))


def _short_text(node: ast.AST) -> str | None:
    """The text ``ast.unparse`` gives for the common small kinds of nodes, at a part of its cost; None for any other."""
    kind = type(node)
    if kind is ast.Name:
        return node.id
    if kind is ast.Constant:
        return repr(node.value) if type(node.value) in _PRINTED and not node.kind else None
    if kind is ast.Attribute:
        inner = _short_text(node.value) if type(node.value) is not ast.Constant else None  # 1 .real takes a blank
        return None if inner is None else f"{inner}.{node.attr}"
    if kind is ast.List or kind is ast.Call and not node.keywords:
        texts = [_short_text(e) for e in (node.elts if kind is ast.List else node.args)]
        if None in texts:
            return None
        if kind is ast.List:
            return f"[{', '.join(texts)}]"
        inner = _short_text(node.func) if type(node.func) is not ast.Constant else None
        return None if inner is None else f"{inner}({', '.join(texts)})"
    return None


def _text(node: ast.AST | None) -> str | None:
    if node is None:
        return None
    short = _short_text(node)
    return ast.unparse(node) if short is None else short


def _docstring(node) -> str | None:
    first = node.body[0]
    return ast.get_docstring(node) if type(first) is ast.Expr and type(first.value) is ast.Constant else None


def _function(node, ordinal: int, owner: int | None) -> dict:
    """A function, its statements still to be counted."""
    return {
        "ordinal": ordinal, "class_ordinal": owner, "name": node.name,
        "parameters": [{"name": a.arg, "annotation": _text(a.annotation)} for a in node.args.args],
        "return_type": _text(node.returns), "decorators": [_text(d) for d in node.decorator_list],
        "docstring": _docstring(node), "is_async": type(node) is ast.AsyncFunctionDef,
        "start_line": node.lineno, "end_line": node.end_lineno,
        "branches": 0, "asserts": 0, "bool_ops": 0, "bool_operators": 0,
    }


def _arguments(call: ast.Call) -> list[dict]:
    out = []
    for arg in call.args:
        shown = repr(arg.value) if type(arg) is ast.Constant else _text(arg)
        out.append({"kind": _ARGUMENT_KINDS.get(type(arg), "expression"), "text": shown, "keyword": None})
    for kw in call.keywords:
        kind = "keyword" if kw.arg else "unpacked"
        out.append({"kind": kind, "text": _text(kw.value), "keyword": kw.arg})
    return out


def _callee_name(node: ast.AST) -> str | None:
    if type(node) is not ast.Call:
        return None
    return getattr(node.func, "id", None) or getattr(node.func, "attr", None)


def _call(node: ast.Call, ordinal: int, owner: int, functions: set[str], classes: set[str]) -> dict:
    func, receiver, receiver_form, receiver_callee = node.func, "", "none", None
    if isinstance(func, ast.Attribute):
        form, callee, receiver = "attribute", func.attr, _text(func.value)
        receiver_form = "name" if isinstance(func.value, ast.Name) else "expression"
        if isinstance(func.value, ast.Call) and isinstance(func.value.func, ast.Name):
            receiver_callee = func.value.func.id
    elif isinstance(func, ast.Name):
        form, callee = "name", func.id
    else:
        form, callee = "expression", ast.unparse(func)
    return {
        "ordinal": ordinal, "function_ordinal": owner, "form": form, "callee": callee, "receiver": receiver,
        "receiver_form": receiver_form, "receiver_callee": receiver_callee, "args": _arguments(node),
        "start_line": node.lineno, "start_column": node.col_offset, "end_line": node.end_lineno,
        "end_column": node.end_col_offset, "callee_is_function": callee in functions,
        "callee_is_class": callee in classes, "receiver_is_class": receiver in classes,
    }


def _assigned(node: ast.AST) -> list[tuple[ast.AST, ast.AST | None]]:
    """Targets that a node binds, with the value each gets as a whole (None where it is only a part of one)."""
    if type(node) is ast.Assign:
        return [(t, node.value) for t in node.targets]
    if isinstance(node, (ast.AnnAssign, ast.NamedExpr)):
        return [(node.target, node.value)] if node.value or isinstance(node.annotation, ast.Name) else []  # a walrus has a value
    if isinstance(node, ast.withitem):
        return [(node.optional_vars, node.context_expr)] if node.optional_vars else []
    if isinstance(node, (ast.For, ast.AsyncFor, ast.AugAssign)):
        return [(node.target, None)]
    return []


def _assignments(node: ast.AST, owner_of: dict[int, int], count: int) -> list[dict]:
    """Names bound by a node inside a function: to what a call makes, to another name, or to anything else."""
    out = []
    kind = type(node)
    for target, value in _assigned(node):
        if target.lineno not in owner_of:
            continue
        inside = (target,) if type(target) is ast.Name else ast.walk(target)
        for name in inside:
            if type(name) is not ast.Name or type(name.ctx) is not ast.Store:
                continue
            given, form, text = value if name is target else None, "other", None
            if type(given) is ast.Name:
                form, text = "name", given.id
            elif callee := _callee_name(given):
                form, text = "call", callee
            if kind is ast.AnnAssign and type(node.annotation) is ast.Name:
                form, text = "annotation", node.annotation.id
            # a value is there before its name is: the end counts, of the header where a body follows
            whole = target if kind in (ast.withitem, ast.For, ast.AsyncFor) else node
            out.append({
                "ordinal": count + len(out), "function_ordinal": owner_of[target.lineno], "variable": name.id, "form": form, "value": text,
                "start_line": whole.lineno, "start_column": whole.col_offset, "end_line": whole.end_lineno, "end_column": whole.end_col_offset,
            })
    return out


def _slice(lines: list[bytes], node: ast.AST) -> str:
    part = lines[node.lineno - 1 : node.end_lineno]
    part[-1] = part[-1][: node.end_col_offset]
    part[0] = part[0][node.col_offset :]
    return b"".join(part).decode("utf-8", "replace")


def _definitions(tree: ast.Module) -> tuple[list[dict], list[dict], list[dict], list[ast.AST]]:
    """Imports, classes and functions of a module, their statements still to be counted, and the nodes of the functions."""
    imports, classes, functions = [], [], []
    methods: list[tuple[ast.AST, int]] = []
    roots: list[ast.AST] = []
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            origin = (node.module or "") if isinstance(node, ast.ImportFrom) else ""
            imports.append({"ordinal": len(imports), "from_statement": origin, "imports": [a.name for a in node.names]})
        elif isinstance(node, _DEFS):
            functions.append(_function(node, len(functions), None))
            roots.append(node)
        elif isinstance(node, ast.ClassDef):
            methods += [(m, len(classes)) for m in node.body if isinstance(m, _DEFS)]
            classes.append({
                "ordinal": len(classes), "class_name": node.name, "bases": [_text(b) for b in node.bases],
                "decorators": [_text(d) for d in node.decorator_list], "docstring": _docstring(node),
                "start_line": node.lineno, "end_line": node.end_lineno,
            })
    functions += [_function(m, len(functions) + i, owner) for i, (m, owner) in enumerate(methods)]
    roots += [m for m, _ in methods]
    return imports, classes, functions, roots


def header_facts(text: str) -> dict:
    """Names and decorators of classes and functions alone: nothing inside a function is looked at."""
    _, classes, functions, _ = _definitions(ast.parse(text))
    return {"valid": True, "classes": classes, "functions": functions}


def syntax_facts(text: str) -> dict:
    """Facts of one source text; raises on text that is not Python."""
    tree = ast.parse(text)
    imports, classes, functions, roots = _definitions(tree)
    function_of = dict(zip(roots, functions, strict=True))

    # Line to the smallest function holding it: paint the widest first.
    owner_of: dict[int, int] = {}
    for f in sorted(functions, key=lambda f: (f["start_line"] - f["end_line"], -f["ordinal"])):
        owner_of.update(dict.fromkeys(range(f["start_line"], f["end_line"] + 1), f["ordinal"]))
    names, class_names = {f["name"] for f in functions}, {c["class_name"] for c in classes}

    lines: list[bytes] = []
    calls, lambdas, asserts, assignments = [], [], [], []
    queue: list[ast.AST] = [tree]
    around: list[dict | None] = [None]  # the function that each node of the queue is part of; functions are apart
    for parent, function in zip(queue, around):  # breadth first, as ast.walk, with each node's children at hand
        kind = type(parent)
        if kind is ast.Call:
            if parent.lineno in owner_of:
                calls.append(_call(parent, len(calls), owner_of[parent.lineno], names, class_names))
        elif kind in _DEFS:
            function = function_of.get(parent, function)
        elif kind in _COUNTED:
            if function is not None:
                if kind in _BRANCHES:
                    function["branches"] += 1
                elif kind is ast.Assert:
                    function["asserts"] += 1
                else:
                    function["bool_ops"] += 1
                    function["bool_operators"] += len(parent.values) - 1
            if kind is ast.Assert:
                lines = lines or text.encode("utf-8").splitlines(keepends=True)
                asserts.append({"line": parent.lineno, "column": parent.col_offset, "code": _slice(lines, parent),
                                "test": _slice(lines, parent.test)})
        if kind in _BINDING:
            assignments += _assignments(parent, owner_of, len(assignments))
        for field in _INNER[kind]:
            value = getattr(parent, field, None)
            for child in value if type(value) is list else (value,):
                inner = type(child)
                if inner in _INNER and not (inner is ast.arg and child.annotation is None or inner is ast.Attribute and type(child.value) is ast.Name):
                    queue.append(child)
                    around.append(function)
                    if inner is ast.Lambda:
                        lambdas.append({"ordinal": len(lambdas), "line": child.lineno, "parent": kind.__name__,
                                        "parent_callee": _callee_name(parent)})
    asserts.sort(key=lambda a: (a["line"], a.pop("column")))
    for i, a in enumerate(asserts):
        a["ordinal"] = i
    return {"valid": True, "imports": imports, "classes": classes, "functions": functions, "calls": calls, "lambdas": lambdas,
            "asserts": asserts, "assignments": assignments}


def _facts_or_empty(text: str | None, read: Callable[[str], dict] = syntax_facts) -> dict | None:
    """Empty facts for unreadable, invalid or too deeply nested source, None for text that is no source at all (null characters)."""
    try:
        return read(text) if text is not None else _NOTHING
    except (SyntaxError, RecursionError, MemoryError):
        return _NOTHING
    except ValueError:
        return None


def parse_sources(sources: DataFrame, headers: bool = False) -> DataFrame:
    """``sources`` with the syntax facts added, one row per file; ``headers`` asks for ``header_facts`` alone."""
    ddl = f"{schemas.SOURCES}, {schemas.HEADERS if headers else schemas.PARSED}"
    read_facts = header_facts if headers else syntax_facts
    layout = to_arrow_schema(sources.sparkSession.createDataFrame([], ddl).schema)

    added = [field for field in layout if field.name in _FIELDS]

    def with_facts(batch: pa.RecordBatch, at: list[int], facts: list[dict]) -> pa.RecordBatch:
        taken = batch.take(pa.array(at, pa.int64()))
        own = [taken.column(field.name).cast(field.type) for field in layout if field.name not in _FIELDS]
        return pa.RecordBatch.from_arrays([*own, *(pa.array([f[field.name] for f in facts], field.type) for field in added)], schema=layout)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Syntax trees hold no cycles, and looking for some takes a large part of the time: once a batch is enough,
        # and not among what was there before.
        gc.disable()
        gc.freeze()
        try:
            for batch in batches:
                at, read, held = [], [], 0
                for i, text in enumerate(batch.column("text")):
                    text = text.as_py()
                    facts = _facts_or_empty(text, read_facts)
                    if facts is not None:
                        at.append(i)
                        read.append(facts)
                        held += len(text or "")
                    if held >= FACTS_BATCH_CHARACTERS:
                        yield with_facts(batch, at, read)
                        at, read, held = [], [], 0
                        gc.collect()
                if read:
                    yield with_facts(batch, at, read)
                    read = []
                    gc.collect()
        finally:
            gc.unfreeze()
            gc.enable()

    return sources.mapInArrow(rows, ddl)
