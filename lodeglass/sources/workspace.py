"""Packages of a workspace, from its manifests: Cargo, Go, Python, Deno, JavaScript, in this order; the first of equal names wins."""

from __future__ import annotations

import fnmatch
import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodeglass.schema import PACKAGES

Package = tuple[str, str, str]


def _toml(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return {}


def strip_jsonc(text: str) -> str:
    """JSON without comments and commas before a closing bracket."""
    keep = lambda m: m[0] if m[0].startswith('"') else ""
    bare = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', keep, text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def _json(path: Path) -> dict:
    try:
        out = json.loads(strip_jsonc(path.read_text(encoding="utf-8")))
        return out if isinstance(out, dict) else {}
    except (OSError, ValueError):
        return {}


def _members(root: Path, patterns: list[str], marker: str | None) -> list[Path]:
    """Directories that the patterns name, `!` ones excluded, with the marker file if one is asked for."""
    found: dict[Path, None] = {}
    for p in patterns:
        p = p.strip().removeprefix("./").rstrip("/")
        if p.startswith("!"):
            found = {d: None for d in found if not fnmatch.fnmatchcase(d.relative_to(root).as_posix(), p[1:].removeprefix("./"))}
            continue
        try:
            hits = sorted(root.glob(p)) if p else []
        except (ValueError, NotImplementedError):
            hits = []
        found.update({d: None for d in hits if d.is_dir() and "node_modules" not in d.parts and (marker is None or (d / marker).is_file())})
    return list(found)


def _rel(root: Path, path: Path) -> str:
    rel = path.relative_to(root).as_posix()
    return "" if rel == "." else rel


def cargo(root: Path) -> list[Package]:
    raw = _toml(root / "Cargo.toml")
    space = raw.get("workspace", {})
    skip = set(space.get("exclude", []))
    dirs = [root] * ("package" in raw) + [d for d in _members(root, space.get("members", []), "Cargo.toml") if _rel(root, d) not in skip]
    out = []
    for d in dirs:
        own = _toml(d / "Cargo.toml")
        name = own.get("lib", {}).get("name") or own.get("package", {}).get("name")
        if name:
            out.append(("rust", name.replace("-", "_"), _rel(root, d)))
    return out


def _go_module(folder: Path) -> str | None:
    try:
        m = re.search(r"^\s*module\s+(\S+)", (folder / "go.mod").read_text(encoding="utf-8"), re.M)
    except (OSError, UnicodeDecodeError):
        return None
    return m[1] if m else None


def go(root: Path) -> list[Package]:
    dirs = [root]
    if (root / "go.work").is_file():
        text = re.sub(r"//[^\n]*", "", (root / "go.work").read_text(encoding="utf-8", errors="replace"))
        uses = re.findall(r"^\s*use\s+([^\s(]+)", text, re.M) + [x for block in re.findall(r"\buse\s*\(([^)]*)\)", text) for x in block.split()]
        dirs = [(root / u).resolve() for u in uses]
    return [("go", name, _rel(root.resolve(), d.resolve())) for d in dirs if d.resolve().is_relative_to(root.resolve()) and (name := _go_module(d))]


def python(root: Path) -> list[Package]:
    raw = _toml(root / "pyproject.toml")
    space = raw.get("tool", {}).get("uv", {}).get("workspace", {})
    skip = space.get("exclude", [])
    dirs = [root] * bool(raw.get("project", {}).get("name")) + [d for d in _members(root, space.get("members", []), "pyproject.toml") if not any(fnmatch.fnmatchcase(_rel(root, d), s) for s in skip)]
    return [("python", name.replace("-", "_"), _rel(root, d)) for d in dirs if (name := _toml(d / "pyproject.toml").get("project", {}).get("name"))]


def deno(root: Path) -> list[Package]:
    file = next((f for f in ("deno.json", "deno.jsonc") if (root / f).is_file()), None)
    if not file:
        return []
    raw = _json(root / file)
    space = raw.get("workspace", [])
    dirs = [root, *_members(root, space.get("members", []) if isinstance(space, dict) else space, None)]
    names = [(d, next((n for f in ("deno.json", "deno.jsonc") if (n := _json(d / f).get("name"))), None)) for d in dirs]
    return [("deno", n, _rel(root, d)) for d, n in names if n]


def javascript(root: Path) -> list[Package]:
    """A pnpm workspace goes before the manifest's own list. Directories without a package name count by their own."""
    yaml = root / "pnpm-workspace.yaml"
    raw = _json(root / "package.json")
    if yaml.is_file():
        text = yaml.read_text(encoding="utf-8", errors="replace")
        block = re.search(r"^packages:\s*\n((?:\s*(?:-.*|#.*)?\n?)+)", text + "\n", re.M)
        patterns = [x.strip().strip("'\"") for x in re.findall(r"^\s*-\s*(.+?)\s*(?:#.*)?$", block[1] if block else "", re.M)]
    else:
        space = raw.get("workspaces", [])
        patterns = space.get("packages", []) if isinstance(space, dict) else space
    dirs = _members(root, [p for p in patterns if isinstance(p, str)], None)
    return [("js", _json(d / "package.json").get("name") or d.name, _rel(root, d)) for d in dirs]


def discover(root: str | Path) -> list[Package]:
    found: dict[str, Package] = {}
    for find in (cargo, go, python, deno, javascript):
        for package in find(Path(root)):
            found.setdefault(package[1], package)
    return sorted(found.values())


def packages(spark: SparkSession, root: str | Path) -> DataFrame:
    """The table of a workspace's packages; as small as its manifests."""
    return spark.createDataFrame(discover(root), PACKAGES)
