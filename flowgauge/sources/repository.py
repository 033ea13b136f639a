"""Evidence from source files: symbols and imports of Python files, and the import graph between files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _facts(text: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, int]]]:
    tree = ast.parse(text)
    symbols, imports = [], []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            symbols.append((node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno))
        elif isinstance(node, ast.Import):
            imports += [(a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [("." * node.level + (node.module or ""), node.lineno)] + [("." * node.level + (f"{node.module}." if node.module else "") + a.name, node.lineno) for a in node.names]
    return symbols, imports


def facts(files: DataFrame) -> DataFrame:
    """path, fact (symbol, import or unparsed), name, kind, line of each Python file in files (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                try:
                    symbols, imports = _facts(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    out.append((path, "unparsed", None, None, None))
                    continue
                out += [(path, "symbol", n, k, line) for n, k, line in symbols] + [(path, "import", n, None, line) for n, line in imports]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()])], ["path", "fact", "name", "kind", "line"])

    return files.where(F.col("path").endswith(".py")).select("path", "text").mapInArrow(run, "path string, fact string, name string, kind string, line int")


def module(path: F.Column) -> F.Column:
    """The dotted module of a path, without a leading src."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"(?:/__init__)?\.py$", ""), "/", ".")


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: files of the repository that import each other; relative imports count from the importing package."""
    own = files.select(F.col("path").alias("dst"), module(F.col("path")).alias("target"))
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    package = F.split(module(F.col("path")), r"\.")
    base = F.array_join(F.slice(package, F.lit(1), F.greatest(F.lit(0), F.size(package) - dots)), ".")
    tail = F.regexp_replace("name", r"^\.+", "")
    full = F.when(dots > 0, F.when(tail == "", base).when(base == "", tail).otherwise(F.concat(base, F.lit("."), tail))).otherwise(F.col("name"))
    asked = found.where("fact = 'import'").select(F.col("path").alias("src"), full.alias("target"))
    return asked.join(own, "target").where("src <> dst").select("src", "dst").distinct()
