"""Search: sections of scored hits for a term, and conjunctions of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.functions.names import in_loc_range, last_segment, match_score
from lodeglass.functions.paths import strip_source_ext
from lodeglass.graph.closure import reachable_from, reached_by_others
from lodeglass.operators.lookup import find_export_matches, member_index, winners

FUZZY_CAP = 50
SECTIONS = ("exact_export", "exact_member", "fuzzy_member", "fuzzy_export", "file", "import", "named_import")


def package_files(files: DataFrame, column: str = "imports") -> DataFrame:
    """(name, file_path) of every external import."""
    return files.select(F.explode(column).alias("name"), F.col("path").alias("file_path"))


def bare_search(term: str, exports: DataFrame, members: DataFrame, files: DataFrame, reexported: DataFrame | None = None, cap: int = FUZZY_CAP) -> DataFrame:
    """section, name, file_path, start_line, score, of exact and fuzzy hits in symbols, paths and imports.

    The fuzzy sections hold the `cap` best by score and name (a top-k, kept per task before it moves); a row of an import
    section is an importing file. `section_total` of fuzzy exports tells how many there are in all.
    """
    t = term.lower()
    line = F.col("start_line")
    none = F.lit(None).cast("long")
    own = winners(exports.where((F.col("name") == term) | F.lower("name").contains(t)), reexported)
    dotted = member_index(members.where((F.col("dotted_name") == term) | F.lower(last_segment(F.col("dotted_name"))).contains(t)))
    hit = lambda df, section, score: df.select(F.lit(section).alias("section"), "name", "file_path", line.alias("start_line"), score.cast("int").alias("score"))
    fuzzy = hit(own.where(F.col("name") != term), "fuzzy_export", match_score(F.col("name"), term)).unionByName(hit(dotted.where(F.col("name") != term), "fuzzy_member", match_score(last_segment(F.col("name")), term)))
    order = Window.partitionBy("section").orderBy(F.desc("score"), "name", "file_path")
    best = fuzzy.where("score > 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
    paths = files.where(F.lower("path").contains(t)).select(F.lit("file").alias("section"), F.col("path").alias("name"), F.col("path").alias("file_path"), none.alias("start_line"), F.lit(20).alias("score"))
    packages = hit(package_files(files).where(F.lower("name").contains(t)).withColumn("start_line", none), "import", F.lit(20))
    named = files.select(F.col("path").alias("file_path"), F.explode("named_imports").alias("source", "names")).select("file_path", F.explode("names").alias("name")).where(F.lower("name").contains(t)).distinct()
    sections = [hit(own.where(F.col("name") == term), "exact_export", F.lit(100)), hit(dotted.where(F.col("name") == term), "exact_member", F.lit(100)), best, paths, packages, hit(named.withColumn("start_line", none), "named_import", F.lit(20))]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def fuzzy_total(term: str, exports: DataFrame, reexported: DataFrame | None = None, cap: int = FUZZY_CAP) -> DataFrame:
    """total_exports: how many fuzzy exports there are, null unless they exceed the cap."""
    n = F.count("*")
    return winners(exports.where(F.lower("name").contains(term.lower()) & (F.col("name") != term)), reexported).agg(F.when(n > cap, n).alias("total_exports"))


def imports_grouped(files: DataFrame, term: str = "") -> DataFrame:
    """Packages that contain the term, with the number and list of their importing files."""
    rows = package_files(files).where(F.lower("name").contains(term.lower())).distinct()
    return rows.groupBy(F.col("name").alias("package")).agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))


def depends_on(target: str, files: DataFrame, edges: DataFrame, exact: bool = False) -> DataFrame:
    """path of every transitive dependent of the files that `target` names (path, stem or ending stem); if there is none, of
    the files one of whose dependencies ends with the target's stem. `exact`: of the file with this path alone, which is no dependent of itself."""
    if exact:
        one = files.where(F.col("path") == target).select(F.col("path").alias("node"))
        return reachable_from(one, edges, "target", "source").where("depth > 0").select(F.col("node").alias("path"))
    stem = strip_source_ext(F.lit(target))
    own = strip_source_ext(F.col("path"))
    targets = files.where((F.col("path") == target) | (own == stem) | own.endswith(F.concat(F.lit("/"), stem))).select(F.col("path").alias("node"))
    # a target is a result itself if it depends on another one
    found = reached_by_others(targets, edges, "target", "source").select(F.col("node").alias("path"))
    if not found.isEmpty():
        return found
    specs = files.select("path", F.explode("dependencies").alias("d"))
    return specs.where(strip_source_ext(F.col("d")).endswith(stem)).select("path").distinct()


def filter_search(files: DataFrame, exports: DataFrame, edges: DataFrame, export: str | None = None, imports: str | None = None, depends: str | None = None, min_loc: int | None = None, max_loc: int | None = None, reexported: DataFrame | None = None, depends_exact: bool = False) -> DataFrame:
    """path and loc of the files that pass every filter given, by path. An exact export name wins over parts of names; `depends_exact`: `depends` is the path of one file."""
    out = files.where(in_loc_range(F.col("loc"), min_loc, max_loc))
    if export is not None:
        own = winners(exports.where((F.col("name") == export) | F.lower("name").contains(export.lower())), reexported)
        exact = F.max((F.col("name") == export).cast("int"))
        is_exact = own.agg(F.coalesce(exact, F.lit(0))).first()[0] == 1
        hits = own.where(F.col("name") == export) if is_exact else own
        out = out.join(hits.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")
    if imports is not None:
        found = F.exists("imports", lambda x: x.contains(imports))
        if imports.startswith((".", "/")) or "/" in imports:
            found = found | F.exists("dependencies", lambda x: strip_source_ext(x).endswith(strip_source_ext(F.lit(imports.lstrip("./")))))
        out = out.where(found)
    if depends is not None:
        out = out.join(depends_on(depends, files, edges, depends_exact), "path", "left_semi")
    return out.select("path", "loc").orderBy("path")


def combined_search(hits: DataFrame, passed: DataFrame) -> DataFrame:
    """Hits of a term in files that also pass the filters."""
    return hits.join(passed.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def export_search(term: str, exports: DataFrame, reexported: DataFrame | None = None, limit: int = FUZZY_CAP) -> DataFrame:
    """The shortcut for an export filter alone."""
    return find_export_matches(term, winners(exports, reexported)).limit(limit)
