"""Python files by their syntax tree, on Arrow batches; files that do not parse are left to patterns."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import columns

#: Fixed value: decorator attributes that declare a route.
ROUTE_VERBS = frozenset(("get", "post", "put", "delete", "patch"))

LISTS = ("imports", "classes", "functions", "interfaces", "decorators", "annotations", "docstrings", "routes")
FIELDS = "parsed boolean, " + ", ".join(f"{n} array<string>" for n in LISTS) + ", sections array<struct<title:string,kind:string,line_start:int,line_end:int>>"
_DEFINED = (ast.FunctionDef, ast.AsyncFunctionDef)


def _routes(node) -> list[str]:
    out = []
    for d in node.decorator_list:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_VERBS and d.args and isinstance(d.args[0], ast.Constant):
            out.append(f"{d.func.attr.upper()} {d.args[0].value}")
    return out


def _annotations(node) -> list[str]:
    given = [a.annotation for a in node.args.args if a.annotation is not None]
    return [ast.unparse(x) for x in [*given, *([node.returns] if node.returns is not None else [])]]


def outline(text: str | None) -> dict:
    """Symbols of a module: its classes with their methods, and its functions; nothing deeper."""
    out: dict = {n: [] for n in LISTS} | {"sections": [], "parsed": True}
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return out | {"parsed": False}

    def document(node):
        if doc := ast.get_docstring(node):
            out["docstrings"].append(doc)

    def section(node, title, kind):
        out["sections"].append((title, kind, node.lineno, node.end_lineno))

    def function(node, title, kind):
        out["functions"].append(title)
        out["decorators"] += [ast.unparse(d) for d in node.decorator_list]
        out["annotations"] += _annotations(node)
        out["routes"] += _routes(node)
        document(node)
        section(node, title, kind)

    document(tree)
    for node in tree.body:
        if isinstance(node, ast.Import):
            out["imports"] += [f"import {a.name}" for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"] += [f"from {node.module or ''} import {a.name}" for a in node.names]
        elif isinstance(node, ast.ClassDef):
            out["classes"].append(node.name)
            out["decorators"] += [ast.unparse(d) for d in node.decorator_list]
            document(node)
            section(node, node.name, "class")
            for method in node.body:
                if isinstance(method, _DEFINED):
                    function(method, f"{node.name}.{method.name}", "method")
        elif isinstance(node, _DEFINED):
            function(node, node.name, "function")
    out["interfaces"] = [c for c in out["classes"] if c.endswith("Protocol")]
    return out


def parsed_python(files: DataFrame) -> DataFrame:
    """``files`` (path, text) with a struct ``py`` of what their syntax trees hold."""

    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outline(t) for t in text])

    return files.withColumn("py", F.pandas_udf(run, FIELDS)("text"))


def python_sections(parsed: DataFrame, key: str | Sequence[str] = "path") -> DataFrame:
    """One row for each class, method and function, with its lines; methods also lie in their class."""
    rows = parsed.filter("py.parsed").select(*columns(key), "text", F.posexplode("py.sections").alias("section_idx", "s"))
    lines = F.slice(F.split("text", "\n"), F.col("s.line_start"), F.col("s.line_end") - F.col("s.line_start") + 1)
    return rows.select(
        *columns(key), F.lit("python").alias("language"), "section_idx", F.col("s.title").alias("title"), F.lit(2).alias("level"), F.col("s.kind").alias("kind"),
        F.array_join(lines, "\n").alias("content"), F.array("s.title").alias("hierarchy"), F.col("s.line_start").alias("line_start"), F.col("s.line_end").alias("line_end"),
    )
