"""Facts from Python source text, many rows for each file, by Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.tables import deal


def facts_of(source: str) -> list[tuple[str, str, int]]:
    """``kind, name, line`` of what a source defines, calls, imports, inherits, raises and decorates; none if it can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    dotted = lambda n: n.id if isinstance(n, ast.Name) else (f"{dotted(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) else "")
    out: list[tuple[str, str, int]] = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno))
            out += [("decorator", dotted(x.func if isinstance(x, ast.Call) else x), node.lineno) for x in node.decorator_list]
            if isinstance(node, ast.ClassDef):
                out += [("inherits", dotted(b), node.lineno) for b in node.bases]
        elif isinstance(node, ast.Call):
            out.append(("call", dotted(node.func), node.lineno))
        elif isinstance(node, ast.Import):
            out += [("import", a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("import", f"{node.module or ''}.{a.name}", node.lineno) for a in node.names]
        elif isinstance(node, ast.Raise) and node.exc is not None:
            out.append(("raise", dotted(node.exc.func if isinstance(node.exc, ast.Call) else node.exc), node.lineno))
    return sorted({(k, n, line) for k, n, line in out if n})


def python_facts(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, name, line`` for each row of ``files``; null and unparsable texts give none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *f) for k, t in zip(pdf[key], pdf[text], strict=True) if isinstance(t, str) for f in facts_of(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "line"])

    return deal(files.select(key, text)).mapInPandas(parse, f"{key} {dict(files.dtypes)[key]}, kind string, name string, line int")
