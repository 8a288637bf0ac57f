"""Impact analysis: who uses a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.names import is_test_path
from lodeglass.sources.config import Config

LIMIT, LIMIT_CAP = 10, 50
MODES = ("source", "tests", "all")


def matching_symbols(pattern: str, exports: DataFrame, members: DataFrame, exact: bool = False) -> DataFrame:
    """Definitions (name, file_path, start_line, end_line, kind), members as entries of their own."""
    pattern = pattern.strip()
    if not pattern:
        raise ValueError("a pattern is needed")
    named = members.where("relationship_kind is null").select(F.col("dotted_name").alias("name"), "file_path", "start_line", "end_line", "kind")
    every = exports.select("name", "file_path", "start_line", "end_line", "kind").unionByName(named)
    return every.where(F.col("name") == pattern if exact else F.lower("name").contains(pattern.lower()))


def build_glossary(pattern: str, exports: DataFrame, members: DataFrame, edges: DataFrame, mode: str = "source", exact: bool = False, config: Config = Config()) -> DataFrame:
    """One row per definition: name, file_path, lines, kind, n_used_by and used_by (paths, ordered, joined by commas), by lower-cased name.

    source: definitions outside tests with users outside tests; tests: the same definitions with users in tests; all: everything.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    defs = matching_symbols(pattern, exports, members, exact)
    if mode != "all":
        defs = defs.where(~is_test_path(F.col("file_path"), config))
    users = edges.select(F.col("target").alias("file_path"), F.col("source").alias("user")).distinct()
    if mode != "all":
        test = is_test_path(F.col("user"), config)
        users = users.where(test if mode == "tests" else ~test)
    # only the files that define a match count, so that the lists are those of a few targets
    wanted = users.join(defs.select("file_path").distinct(), "file_path", "left_semi")
    lists = wanted.groupBy("file_path").agg(F.count("*").alias("n_used_by"), F.array_join(F.array_sort(F.collect_list("user")), ",").alias("used_by"))
    out = defs.join(lists, "file_path", "left")
    return out.select("name", "file_path", "start_line", "end_line", "kind", F.coalesce("n_used_by", F.lit(0)).alias("n_used_by"), F.coalesce("used_by", F.lit("")).alias("used_by")).orderBy(F.lower("name"), "name", "file_path")


def glossary_page(glossary: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(the first names, at most 50; the total of names)."""
    names = glossary.select("name").distinct()
    first = names.orderBy(F.lower("name"), "name").limit(min(max(limit, 1), LIMIT_CAP))
    return glossary.join(first, "name", "left_semi"), names.agg(F.count("*").alias("total"))


def classify_users(pattern: str, users: DataFrame, files: DataFrame, specifiers: DataFrame) -> DataFrame:
    """(target, user, class) of pairs (target, user): by what the user imports from the target.

    named: imports exactly `pattern`; namespace: imports the whole module; unknown: no import metadata; other: imports something else.
    `specifiers` (source, target, specifier): the texts by which a user may name the target.
    """
    named = files.select(F.col("path").alias("source"), F.explode("named_imports").alias("specifier", "names"))
    spaces = files.select(F.col("path").alias("source"), F.explode("namespace_imports").alias("specifier"))
    hit_named = named.join(specifiers, ["source", "specifier"]).groupBy("source", "target").agg(F.bool_or(F.array_contains("names", pattern)).alias("has"))
    hit_space = spaces.join(specifiers, ["source", "specifier"]).select("source", "target").distinct().withColumn("space", F.lit(True))
    meta = files.select(F.col("path").alias("source"), ((F.size("named_imports") > 0) | (F.size("namespace_imports") > 0)).alias("meta"))
    rows = users.select("target", F.col("user").alias("source")).distinct().join(meta, "source", "left").join(hit_named, ["source", "target"], "left").join(hit_space, ["source", "target"], "left")
    kind = F.when(~F.coalesce("meta", F.lit(False)), "unknown").when(F.coalesce("has", F.lit(False)), "named").when(F.coalesce("space", F.lit(False)), "namespace").otherwise("other")
    return rows.select("target", F.col("source").alias("user"), kind.alias("class"))


def count_test_dependents(edges: DataFrame, path: str, config: Config = Config()) -> DataFrame:
    """n: dependents of the file that are tests."""
    return edges.where((F.col("target") == path) & is_test_path(F.col("source"), config)).agg(F.countDistinct("source").alias("n"))
