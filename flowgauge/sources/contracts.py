"""Architecture contracts and manifests of a repository as small tables, read from the text of their files."""

from __future__ import annotations

import configparser
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

CONTRACT = "name string, kind string, source string, target string, place int"


def _lines(value: object) -> list[str]:
    return [x.strip() for x in (value if isinstance(value, list) else str(value or "").splitlines()) if x.strip()]


def _linter(text: str, toml: bool) -> list[tuple]:
    """Rows of an import-linter configuration; places number layers from the highest."""
    if toml:
        found = [(c.get("name", ""), c) for c in tomllib.loads(text).get("tool", {}).get("importlinter", {}).get("contracts", [])]
    else:
        parser = configparser.ConfigParser()
        parser.read_string(text)
        found = [(parser[s].get("name", s), dict(parser[s])) for s in parser.sections() if s.startswith("importlinter:contract")]
    out: list[tuple] = []
    for name, c in found:
        kind = c.get("type", "")
        if kind == "forbidden":
            out += [(name, kind, a, b, None) for a in _lines(c.get("source_modules")) for b in _lines(c.get("forbidden_modules"))]
        elif kind == "layers":
            layers = [[x.strip(" ()") for x in re.split(r"[|:]", layer)] for layer in _lines(c.get("layers"))]
            inside = [f"{box}." for box in _lines(c.get("containers"))] or [""]
            out += [(name, kind, box + low, box + high, k) for box in inside for k, highs in enumerate(layers) for high in highs for lows in layers[k + 1 :] for low in lows]
        elif kind == "independence":
            out += [(name, kind, a, b, None) for a in _lines(c.get("modules")) for b in _lines(c.get("modules")) if a != b]
        elif kind == "protected":
            out += [(name, kind, a, b, None) for b in _lines(c.get("protected_modules")) for a in _lines(c.get("allowed_importers")) or [None]]
        elif kind == "acyclic_siblings":
            out += [(name, kind, a, None, None) for a in _lines(c.get("ancestors"))]
    return out


def _cruiser(text: str) -> list[tuple]:
    """Rows of a dependency-cruiser configuration (JSON): forbidden pairs of path patterns."""
    return [(r.get("name", ""), "path_forbidden", r.get("from", {}).get("path"), r.get("to", {}).get("path"), None) for r in json.loads(text).get("forbidden", [])]


def contracts(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """name, kind, source, target, place of all contracts in configuration files (path: text): a source must not import a
    target; of protected contracts the sources alone may. A file that can't be read raises an error that names it."""
    out: list[tuple] = []
    for path, text in files.items():
        try:
            out += _cruiser(text) if path.endswith(".json") else _linter(text, path.endswith(".toml"))
        except (ValueError, configparser.Error) as error:
            raise ValueError(f"{path}: {error}") from error
    return spark.createDataFrame(out, CONTRACT)


def _manifest(path: str, text: str) -> list[tuple[str, str]]:
    name = path.rsplit("/", 1)[-1]
    try:
        if name == "package.json":
            data = json.loads(text)
            return [("language", "JavaScript")] + [("dependency", d) for part in ("dependencies", "devDependencies") for d in sorted(data.get(part, {}))]
        if name == "pyproject.toml":
            project = tomllib.loads(text).get("project", {})
            return [("language", "Python")] + [("dependency", re.split(r"[\s\[<>=!~;]", d, maxsplit=1)[0]) for d in project.get("dependencies", [])]
        if name == "Cargo.toml":
            return [("language", "Rust")] + [("dependency", d) for d in sorted(tomllib.loads(text).get("dependencies", {}))]
        if name.startswith("requirements") and name.endswith(".txt"):
            return [("language", "Python")] + [("dependency", re.split(r"[\s\[<>=!~;#]", x.strip(), maxsplit=1)[0]) for x in text.splitlines() if re.match(r"\s*[A-Za-z0-9]", x)]
        if name == "go.mod":
            return [("language", "Go")] + [("dependency", m[1]) for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v\d", text, re.MULTILINE)]
        if name == "pom.xml":
            return [("language", "Java")] + [("dependency", m[1]) for m in re.finditer(r"<dependency>.*?<artifactId>\s*([^<\s]+)", text, re.DOTALL)]
        if name.startswith("build.gradle"):
            return [("language", "Java")] + [("dependency", m[1].split(":")[-2 if m[1].count(":") > 1 else -1]) for m in re.finditer(r"(?:implementation|api|testImplementation)[\s(]+['\"]([^'\"]+)['\"]", text)]
    except (ValueError, AttributeError):
        return [("unreadable", name)]
    return []


@pandas_udf(T.ArrayType(T.StructType([T.StructField("fact", T.StringType()), T.StructField("value", T.StringType())])))
def _facts(path: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[{"fact": a, "value": b} for a, b in _manifest(p or "", t or "")] for p, t in zip(path, text)])


def manifest_facts(files: DataFrame) -> DataFrame:
    """path, fact (language, dependency or unreadable), value of the manifests among files (path, text)."""
    return files.select("path", F.explode(_facts("path", "text")).alias("x")).select("path", "x.fact", "x.value")
