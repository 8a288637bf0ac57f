"""Source trees as tables."""

from __future__ import annotations

import fnmatch
import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions.paths import glob_regex
from lodeglass.sources.config import CONFIG_NAME, IGNORE_NAME, Config

_SKIP = {".git", ".hg", ".svn", "node_modules", "target", "__pycache__", ".venv"}


def find_root(path: str | Path) -> Path:
    """A directory is its own root; a file's is the nearest directory above it with version control or settings."""
    path = Path(path).resolve()
    if path.is_dir():
        return path
    for folder in path.parents:
        if any((folder / mark).exists() for mark in (".git", ".hg", CONFIG_NAME)):
            return folder
    return path.parent


def common_root(paths: list[str | Path]) -> Path:
    return Path(os.path.commonpath([find_root(p) for p in paths]))


def _rules(folder: Path) -> list[tuple[str, bool]]:
    out = []
    for name in (".gitignore", IGNORE_NAME):
        if (folder / name).is_file():
            for line in (folder / name).read_text(errors="replace").splitlines():
                line = line.strip()
                if line and not line.startswith("#"):
                    out.append((line.removeprefix("!"), line.startswith("!")))
    return out


def _ignored(rel: str, is_dir: bool, rules: list[tuple[str, str, bool]]) -> bool:
    """The last rule that matches decides. Rules: (folder, pattern, negated)."""
    hit = False
    for base, pattern, negated in rules:
        if base and not rel.startswith(base + "/"):
            continue
        own = rel[len(base) + 1 :] if base else rel
        only_dir, pattern = pattern.endswith("/"), pattern.rstrip("/")
        if only_dir and not is_dir:
            continue
        anchored = "/" in pattern
        pattern = pattern.lstrip("/").replace("**/", "*")
        if fnmatch.fnmatchcase(own, pattern) if anchored else fnmatch.fnmatchcase(own.rsplit("/", 1)[-1], pattern):
            hit = not negated
    return hit


def list_local(root: str | Path, config: Config = Config()) -> list[str]:
    """Relative paths of the files to index, ordered: configured extensions, not ignored, not excluded. For trees on the driver's disk."""
    root, out, rules = Path(root), [], []
    for folder, dirs, names in os.walk(root):
        base = Path(folder).relative_to(root).as_posix()
        base = "" if base == "." else base
        rules += [(base, p, n) for p, n in _rules(Path(folder))]
        join = lambda name: f"{base}/{name}" if base else name
        dirs[:] = sorted(d for d in dirs if d not in _SKIP and not d.startswith(".") and not _ignored(join(d), True, rules))
        for name in names:
            rel = join(name)
            if rel.rsplit(".", 1)[-1] in config.languages and "." in name and not _ignored(rel, False, rules) and not any(fnmatch.fnmatchcase(rel, g) for g in config.exclude):
                out.append(rel)
    return sorted(out)


def scan(spark: SparkSession, root: str, config: Config = Config(), paths: list[str] | None = None) -> DataFrame:
    """path, text, source_mtime, source_size of a source tree on any file system. `paths` (as `list_local` gives) restricts it; single files named there
    bypass the extension rule, but not the limit of lines."""
    root = root.rstrip("/")
    reader = spark.read.format("binaryFile")
    if paths is None:
        raw = reader.option("recursiveFileLookup", True).load(root)
    else:
        raw = reader.load([f"{root}/{p}" for p in paths]) if paths else reader.option("recursiveFileLookup", True).load(root).limit(0)
    prefix = root.split("://", 1)[-1].lstrip("/")
    inner = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", ""), F.lit(f"^{_quote(prefix)}/"), F.lit(""))
    out = raw.select(inner.alias("path"), F.col("content").cast("string").alias("text"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("source_mtime"), F.col("length").alias("source_size"))
    if paths is None:
        out = out.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*config.languages))
        for g in config.exclude:
            out = out.where(~F.col("path").rlike(glob_regex(g)))
    if config.max_lines:
        out = out.where((F.col("source_size") <= config.max_lines) | (F.length("text") - F.length(F.replace("text", F.lit("\n"))) <= config.max_lines))
    return out


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)


def union_scans(scans: list[DataFrame]) -> DataFrame:
    """Several trees as one, each path once."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["path"])


def git_meta(root: str | Path, sha: str | None = None) -> dict[str, str | None]:
    """git_sha, git_branch (none if detached) and git_dirty; empty outside a repository."""
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], capture_output=True, text=True)
    head = run("rev-parse", "HEAD")
    if head.returncode and not sha:
        return {}
    branch = run("rev-parse", "--abbrev-ref", "HEAD").stdout.strip()
    return {"git_sha": sha or head.stdout.strip(), "git_branch": None if branch in ("", "HEAD") else branch, "git_dirty": str(bool(run("status", "--porcelain").stdout.strip())).lower()}
