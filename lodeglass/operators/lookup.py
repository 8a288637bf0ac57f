"""Looking symbols up: which file owns a name, and what matches one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_JS, _TS = r"\.jsx?$", r"\.tsx?$"


def own_named_imports(files: DataFrame) -> DataFrame:
    """(file_path, name) of every name that a file imports or re-exports by name."""
    pairs = files.select(F.col("path").alias("file_path"), F.explode("named_imports").alias("source", "names"))
    return pairs.select("file_path", F.explode("names").alias("name")).distinct()


def winners(exports: DataFrame, reexported: DataFrame | None = None) -> DataFrame:
    """One file per export name: name, file_path, start_line, end_line.

    In path order the last definition wins, but a JavaScript file never displaces a TypeScript one; names that the file only re-exports
    don't count. Closed form: with L the last definition outside JavaScript, L wins if it is TypeScript, else the last one does.
    One aggregation, combined before it moves.
    """
    rows = exports.join(reexported, ["file_path", "name"], "left_anti") if reexported is not None else exports
    place = F.struct("file_path", "start_line", "end_line")
    # equal paths cannot tie: exports are unique by name and file
    best = rows.groupBy("name").agg(F.max_by(place, "file_path").alias("last"), F.max_by(F.when(~F.col("file_path").rlike(_JS), place), F.when(~F.col("file_path").rlike(_JS), F.col("file_path"))).alias("other"))
    chosen = F.when(F.coalesce(F.col("other.file_path").rlike(_TS), F.lit(False)), F.col("other")).otherwise(F.col("last"))
    return best.select("name", chosen.alias("w")).select("name", "w.file_path", "w.start_line", "w.end_line")


def member_index(members: DataFrame) -> DataFrame:
    """One place per dotted name: the last by path."""
    place = F.struct("file_path", "start_line", "end_line")
    return members.groupBy("dotted_name").agg(F.max_by(place, "file_path").alias("w")).select(F.col("dotted_name").alias("name"), "w.file_path", "w.start_line", "w.end_line")


def function_index(exports: DataFrame, files: DataFrame) -> DataFrame:
    """Module-level functions: the first place by path."""
    functions = files.select(F.col("path").alias("file_path"), F.explode("function_names").alias("name")).distinct()
    return exports.join(functions, ["file_path", "name"]).groupBy("name").agg(F.min_by(F.struct("file_path", "start_line", "end_line"), "file_path").alias("w")).select("name", "w.file_path", "w.start_line", "w.end_line")


def lookup_export(name: str, exports: DataFrame, members: DataFrame, files: DataFrame, reexported: DataFrame | None = None) -> DataFrame:
    """The place of `name` (an export's winner, else a member) with its file's profile and the number of further definitions. At most one row."""
    own = winners(exports.where(F.col("name") == name), reexported).withColumn("_rank", F.lit(0))
    dotted = member_index(members.where(F.col("dotted_name") == name)).withColumn("_rank", F.lit(1))
    more = exports.where(F.col("name") == name).groupBy("name").agg((F.count("*") - 1).alias("additional"))
    found = own.unionByName(dotted).orderBy("_rank").limit(1).join(more, "name", "left")
    return found.join(files, F.col("file_path") == F.col("path"), "left").select("name", "file_path", "start_line", "end_line", "loc", "imports", "dependencies", F.coalesce("additional", F.lit(0)).alias("additional"))


def find_export_matches(term: str, places: DataFrame) -> DataFrame:
    """The exact name first, then names that contain the term without regard to case, by lower-cased name. `places`: winners."""
    exact = F.col("name") == term
    return places.where(exact | F.lower("name").contains(term.lower())).withColumn("exact", exact).orderBy(F.desc("exact"), F.lower("name"), "name", "file_path")


def declaration_kind(symbols: DataFrame, exports: DataFrame, members: DataFrame) -> DataFrame:
    """`symbols` (symbol) with kind: of `file:name`, `name` or `Type.member`."""
    parts = symbols.select("symbol", F.regexp_replace("symbol", r"^.*:", "").alias("n"), F.when(F.col("symbol").contains(":"), F.regexp_extract("symbol", r"^(.*):[^:]*$", 1)).alias("p"))
    top = exports.select(F.col("name").alias("n"), F.col("file_path").alias("fp"), "kind")
    dotted = members.select(F.col("dotted_name").alias("n"), F.col("file_path").alias("fp"), "kind")
    every = top.unionByName(dotted)
    hits = parts.join(every, "n", "left").where(F.col("p").isNull() | F.col("fp").isNull() | (F.col("p") == F.col("fp")))
    best = hits.groupBy("symbol").agg(F.max_by("kind", "fp").alias("kind"))
    return symbols.select("symbol").distinct().join(best, "symbol", "left")
