"""Declared versions of a project's packages, read on the driver: a handful of small files."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def declared(folder: str) -> list[tuple[str, str, str]]:
    """(package, version, path) of pyproject.toml (project, poetry), Cargo.toml and package.json below a folder."""
    found = []
    for path in sorted(Path(folder).rglob("*")):
        if path.name in ("pyproject.toml", "Cargo.toml"):
            data = tomllib.loads(path.read_text())
            tables = [data.get("project"), data.get("tool", {}).get("poetry"), data.get("package")]
        elif path.name == "package.json":
            tables = [json.loads(path.read_text())]
        else:
            continue
        for t in tables:
            version = (t.get("version") or ("version" in t.get("dynamic", ()) and _computed(path.parent, t["name"], data))) if t and t.get("name") else None
            if version:
                found.append((t["name"], str(version), str(path)))
    return found


def _computed(folder: Path, package: str, data: dict) -> str | None:
    """The __version__ of the file that a manifest computes its version from: the one it names, or the package's own."""
    tool, module = data.get("tool", {}), package.replace("-", "_")
    named = tool.get("hatch", {}).get("version", {}).get("path")
    attribute = tool.get("setuptools", {}).get("dynamic", {}).get("version", {}).get("attr", "").rpartition(".")[0].replace(".", "/")
    files = [named] if named else [f"{a}{b}" for m in (attribute, module) if m for a in (f"src/{m}", m) for b in ("/__init__.py", ".py")]
    for file in files:
        at = folder / file
        if at.is_file() and (found := re.search(r"""^__version__\s*(?::[^=]+)?=\s*["']([^"']+)""", at.read_text(), re.M)):
            return found[1]
    return None


def declared_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(declared(folder), "package string, version string, path string")
