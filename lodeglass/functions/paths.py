"""Path algebra as column expressions. Paths are relative with `/` between parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.sources.config import DEFAULT_LANGUAGES

_EXTENSION = r"\.(?:" + "|".join(sorted(DEFAULT_LANGUAGES, key=len, reverse=True)) + r")$"
HUB_NAMES = ("index.ts", "index.js", "index.tsx", "index.jsx", "__init__.py", "mod.rs", "lib.rs", "main.rs")


def strip_source_ext(path: Column) -> Column:
    """Without the suffix if it is a registered extension: `a/b.ts` gives `a/b`, `runtime.exception` stays."""
    return F.regexp_replace(path, _EXTENSION, "")


def strip_any_ext(path: Column) -> Column:
    """Without the last extension of the basename."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def dirname(path: Column) -> Column:
    """The part before the last `/`, empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def normalize(path: Column) -> Column:
    """`.` and empty parts dropped, `..` applied; null where it climbs above the root."""
    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("ok"))

    def step(acc, part):
        up = part == ".."
        parts = F.when(part.isin("", "."), acc["parts"]).when(up & (F.size(acc["parts"]) > 0), F.slice(acc["parts"], F.lit(1), F.size(acc["parts"]) - 1)).when(up, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(part)))
        return F.struct(parts.alias("parts"), (acc["ok"] & ~(up & (F.size(acc["parts"]) == 0))).alias("ok"))

    return F.aggregate(F.split(path, "/"), begin, step, lambda acc: F.when(acc["ok"], F.array_join(acc["parts"], "/")))


def join_path(directory: Column, spec: Column) -> Column:
    """`spec`, seen from `directory`, normalised."""
    return normalize(F.when(directory == "", spec).otherwise(F.concat_ws("/", directory, spec)))


def boundary_suffixes(path: Column) -> Column:
    """All suffixes that begin at a part: `a/b/c` gives `a/b/c`, `b/c`, `c`."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def is_hub(path: Column) -> Column:
    """Whether the file re-exports by convention."""
    return basename(path).isin(*HUB_NAMES)


def is_hierarchy(source: Column, target: Column) -> Column:
    """Whether one end is the direct module parent of the other: the hub of the directory that holds it (or that holds its hub's
    directory), or the file that is named like that directory."""

    def module(path):  # the module that a file defines
        return F.when(is_hub(path), dirname(path)).otherwise(strip_source_ext(path))

    def parent(a, b):
        return (module(a) == dirname(module(b))) & (is_hub(a) | (strip_source_ext(a) == dirname(module(b))))

    return parent(source, target) | parent(target, source)


def glob_regex(pattern: str) -> str:
    """A shell glob over a whole name as a regular expression: `*`, `?`, `[...]`, `[!...]`; a bracket that never closes is a letter."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]" else c)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether the basename matches."""
    return basename(path).rlike(glob_regex(pattern))
