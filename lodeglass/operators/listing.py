"""Listing files and exports: filters, sort orders, pages, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.names import is_test_symbol, name_matches, path_filter
from lodeglass.functions.paths import matches_glob
from lodeglass.operators.lookup import member_index, winners
from lodeglass.sources.config import Config

LIMIT = 200
SORTS = {"name": "path", "path": "path", "loc": "loc", "exports": "n_exports", "downstream": "n_downstream", "modified": "modified"}


def in_directory(path: Column, directory: str | None) -> Column:
    """By prefix of the path; none, `.` and `./` are everything."""
    return F.lit(True) if directory in (None, "", ".", "./") else path.startswith(directory)


def page(df: DataFrame, limit: int | None = LIMIT, offset: int = 0) -> DataFrame:
    """Rows `offset` to `offset + limit` of an ordered table."""
    out = df.offset(offset) if offset else df
    return out if limit is None else out.limit(limit)


def select_files(files: DataFrame, directory: str | None = None, pattern: str | None = None, which: str = "all", config: Config = Config()) -> DataFrame:
    """Files of a directory (pushed down to the scan), whose basename matches a glob, that are tests or not."""
    out = files.where(in_directory(F.col("path"), directory) & path_filter(F.col("path"), which, config))
    return out.where(matches_glob(F.col("path"), pattern)) if pattern else out


def with_counts(files: DataFrame, exports: DataFrame, edges: DataFrame) -> DataFrame:
    """path, loc, modified, n_exports, n_downstream (distinct direct dependents). Two aggregations by path, combined before they move."""
    n_exports = exports.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_exports"))
    n_down = edges.groupBy(F.col("target").alias("path")).agg(F.countDistinct("source").alias("n_downstream"))
    zero = F.lit(0).cast("long")
    return files.select("path", "loc", "modified").join(n_exports, "path", "left").join(n_down, "path", "left").select("path", "loc", "modified", F.coalesce("n_exports", zero).alias("n_exports"), F.coalesce("n_downstream", zero).alias("n_downstream"))


def list_files(files: DataFrame, exports: DataFrame, edges: DataFrame, sort_by: str = "loc", order: str | None = None, limit: int | None = LIMIT, offset: int = 0, **filters) -> DataFrame:
    """A page of files, by default from large to small (names ascending); ties by path."""
    if sort_by not in SORTS or order not in (None, "asc", "desc"):
        raise ValueError(f"unknown order: {sort_by} {order}")
    counted = with_counts(select_files(files, **filters), exports, edges)
    key, down = F.col(SORTS[sort_by]), (order or ("asc" if SORTS[sort_by] == "path" else "desc")) == "desc"
    return page(counted.orderBy(key.desc_nulls_last() if down else key.asc_nulls_last(), "path"), limit, offset)


def summary(files: DataFrame) -> DataFrame:
    """total, total_loc and the largest file; of equally long ones the last by path."""
    top = F.max(F.struct("loc", "path"))
    return files.agg(F.count("*").alias("total"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"), top["path"].alias("largest"), top["loc"].alias("largest_loc"))


def rollup_subdir(files: DataFrame, prefix: str = "", sort_by: str = "loc") -> DataFrame:
    """bucket, n_files, loc: by the next part of the path below `prefix`. Files directly below it fall to the prefix itself, or `(root)`."""
    base = "" if prefix in ("", ".", "./") else prefix.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(base) + 1, 1_000_000)
    bucket = F.when(rest.contains("/"), F.concat(F.lit(base), F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(F.lit(base or "(root)"))
    out = files.where(F.col("path").startswith(base)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_files"), F.sum("loc").alias("loc"))
    return out.orderBy("bucket") if sort_by in ("name", "path") else out.orderBy(F.desc("loc"), "bucket")


def exports_of_file(exports: DataFrame, path: str, which: str = "all") -> DataFrame:
    """Exports of one file, in line order; without test symbols for `source`, those alone for `tests`."""
    test = is_test_symbol(F.col("name"), F.col("kind"))
    keep = F.lit(True) if which == "all" else test if which == "tests" else ~test
    return exports.where((F.col("file_path") == path) & keep).orderBy("start_line", "name")


def exports_by_pattern(exports: DataFrame, members: DataFrame, pattern: str, reexported: DataFrame | None = None, directory: str | None = None, which: str = "all", limit: int | None = LIMIT, offset: int = 0, config: Config = Config()) -> DataFrame:
    """Winners and members whose name matches, by lower-cased name. The match is tested before the winners are sought."""
    own = winners(exports.where(name_matches(F.col("name"), pattern)), reexported)
    dotted = member_index(members.where(name_matches(F.col("dotted_name"), pattern)))
    rows = own.unionByName(dotted).where(in_directory(F.col("file_path"), directory) & path_filter(F.col("file_path"), which, config))
    return page(rows.orderBy(F.lower("name"), "name", "file_path"), limit, offset)


def exports_by_file(exports: DataFrame, directory: str | None = None, which: str = "all", limit: int | None = LIMIT, offset: int = 0, config: Config = Config()) -> DataFrame:
    """Files with exports, and their names in line order, by lower-cased path; pages count files."""
    rows = exports.where(in_directory(F.col("file_path"), directory) & path_filter(F.col("file_path"), which, config))
    lists = rows.groupBy("file_path").agg(F.count("*").alias("n_exports"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]), ",").alias("names"))
    return page(lists.orderBy(F.lower("file_path"), "file_path"), limit, offset)
