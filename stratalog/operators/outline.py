"""Outlines of source code."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, functions as F

COLUMNS = ["kind", "name", "depth", "line", "signature", "doc"]


class Outline(ast.NodeVisitor):
    """Collects the imports, classes and functions that a module or a class holds directly.

    ``inside`` is the number of classes around a node.  Bodies of functions, and statements that
    are neither of the three, are not entered.
    """

    def __init__(self) -> None:
        self.entries: list[tuple] = []
        self.inside = 0

    def add(self, kind: str, name: str, node: ast.stmt, signature: str, doc: str = "") -> None:
        self.entries.append((kind, name, self.inside, node.lineno, signature, doc))

    def generic_visit(self, node: ast.AST) -> None:
        if isinstance(node, ast.Module):
            super().generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.add("import", node.names[0].name, node, ast.unparse(node))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.add("import", node.module or ".", node, ast.unparse(node))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        # the statement as it is, without decorators, type parameters and body
        bare = ast.ClassDef(node.name, node.bases, [k for k in node.keywords if k.arg], [ast.Pass()], [], [])
        self.add("class", node.name, node, _head(bare), _summary(node))
        self.inside += 1
        for child in node.body:
            self.visit(child)
        self.inside -= 1

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        bare = type(node)(node.name, node.args, [ast.Pass()], [], node.returns, None, [])
        self.add("method" if self.inside else "function", node.name, node, _head(bare), _summary(node))

    visit_AsyncFunctionDef = visit_FunctionDef


def _head(node: ast.stmt) -> str:
    """The first line of a statement with an empty body, without its colon."""
    return ast.unparse(ast.fix_missing_locations(node)).rpartition(":\n")[0]


def _summary(node) -> str:
    return next(iter((ast.get_docstring(node) or "").strip().splitlines()), "")


def outline_of(source: str) -> tuple[bool, str, list[tuple]]:
    """(parsed, error, entries in order); an entry is kind, name, depth, line, signature, first line of the docstring."""
    walk = Outline()
    try:
        walk.visit(ast.parse(source))
    except SyntaxError as error:
        return False, f"SyntaxError: {error.msg} (line {error.lineno})", []
    except (ValueError, RecursionError, MemoryError) as error:
        return False, type(error).__name__, []
    return True, "", walk.entries


def code_outline(files: DataFrame) -> DataFrame:
    """repo, path, parsed, error, kind, name, depth, line, signature, doc; a file without entries has one row.

    Only Python has a parser here; other source files get the receipt "no parser".
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["content"]):
                parsed, error, found = outline_of(text or "") if path.endswith((".py", ".pyi")) else (False, "no parser", [])
                rows += [(repo, path, parsed, error, *x) for x in found or [(None,) * len(COLUMNS)]]
            yield pd.DataFrame(rows, columns=["repo", "path", "parsed", "error", *COLUMNS]).astype({"depth": "Int64", "line": "Int64"})

    code = files.filter(F.col("path").rlike(r"\.(pyi?|js|jsx|ts|tsx|go|rs|java|c|h|cpp|rb|php|cs|kt)$")).select("repo", "path", "content")
    return code.mapInPandas(run, "repo string, path string, parsed boolean, error string, kind string, name string, depth long, line long, signature string, doc string")
