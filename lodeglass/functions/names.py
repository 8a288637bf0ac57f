"""Symbol names: tokens, match scores, tests by convention."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions.paths import basename
from lodeglass.sources.config import Config

_BORDERS = r"(?<=[\p{Ll}\p{Lo}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|[_\-.:/ ]+"
REGEX_MARKS = "^$[(\\.*+?{"
BOUNDARY = "_.-:"

# Conventions of test files and test symbols, by language.
TEST_FILE = r"(?:_test\.go|_test\.py|_tests?\.rs|\.(?:spec|test)\.(?:ts|tsx|js|jsx))$"
TEST_PYTHON = r"^test_.*\.py$"
TEST_DIRS = r"(?:^|/)(?:tests/|test/|__tests__/|tests\.rs|test\.rs)"
TEST_PREFIXES = ("Test", "test_")


def tokens(name: Column) -> Column:
    """The distinct lower-case tokens of a name, ordered: cut at `_-.:/ `, between cases and between letters and digits."""
    parts = F.transform(F.split(name, _BORDERS), lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def match_score(name: Column, term: str) -> Column:
    """100 equal, 80 prefix, 60 suffix, 40 contained next to a boundary, 20 contained, else 0; without regard to case."""
    low, t = F.lower(name), term.lower()
    at = F.locate(t, low)
    before, after = F.substring(low, at - 1, F.lit(1)), F.substring(low, at + len(t), F.lit(1))
    edge = ((at > 1) & before.isin(*BOUNDARY)) | after.isin(*BOUNDARY)
    return F.when(low == t, 100).when(low.startswith(t), 80).when(low.endswith(t), 60).when((at > 0) & edge, 40).when(at > 0, 20).otherwise(0)


def name_matches(name: Column, pattern: str) -> Column:
    """As a regular expression (unanchored, with case) if it holds any of its marks, else as a part without regard to case."""
    if any(c in pattern for c in REGEX_MARKS):
        return name.rlike(pattern)
    return F.lower(name).contains(pattern.lower())


def is_test_path(path: Column, config: Config = Config()) -> Column:
    """By the configured parts and suffixes, and, unless the user set these, by the languages' conventions."""
    rooted, found = F.concat(F.lit("/"), path), F.lit(False)
    for part in config.test_paths:
        found = found | rooted.contains(part)
    for suffix in config.test_suffixes:
        found = found | path.endswith(suffix)
    if config.own_test_patterns:
        return found
    return found | path.rlike(TEST_FILE) | basename(path).rlike(TEST_PYTHON) | path.rlike(TEST_DIRS)


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def is_test_symbol(name: Column, kind: Column) -> Column:
    """Of kind test, or its last part is `tests` or begins as any language's tests do."""
    last = last_segment(name)
    named = last == "tests"
    for prefix in TEST_PREFIXES:
        named = named | last.startswith(prefix)
    return F.coalesce(kind == "test", F.lit(False)) | named


def path_filter(path: Column, which: str, config: Config = Config()) -> Column:
    """`all`, `source` or `tests`."""
    if which not in ("all", "source", "tests"):
        raise ValueError(f"filter must be all, source or tests, not {which!r}")
    return F.lit(True) if which == "all" else is_test_path(path, config) if which == "tests" else ~is_test_path(path, config)


def loc_bounds(expression: str) -> tuple[int | None, int | None]:
    """(least, most) lines of `>N`, `>=N`, `<N`, `<=N`, `=N` or `N`."""
    m = re.fullmatch(r"\s*(>=|<=|>|<|=)?\s*([0-9]+)\s*", expression)
    if not m:
        raise ValueError(f"not a line count expression: {expression!r}")
    n = int(m[2])
    return {">": (n + 1, None), ">=": (n, None), "<": (None, max(0, n - 1)), "<=": (None, n)}.get(m[1], (n, n))


def in_loc_range(loc: Column, least: int | None = None, most: int | None = None) -> Column:
    ok = F.lit(True)
    if least is not None:
        ok = ok & (loc >= least)
    return ok & (loc <= most) if most is not None else ok
