"""Neighbours and transitive closures over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.storage import discard, materialize


def dependencies_of(edges: DataFrame, path: str) -> DataFrame:
    """What the file imports, by path."""
    return edges.where(F.col("source") == path).select(F.col("target").alias("path")).distinct().orderBy("path")


def dependents_of(edges: DataFrame, path: str) -> DataFrame:
    """What imports the file, by path."""
    return edges.where(F.col("target") == path).select(F.col("source").alias("path")).distinct().orderBy("path")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct().groupBy(F.col("target").alias("path")).agg(F.count("*").alias("n"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct().groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n"))


def dependents_lists(edges: DataFrame) -> DataFrame:
    """target and its sources, ordered and joined by commas."""
    return edges.select("source", "target").distinct().groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


COMPACT = 8  # levels after which what is known becomes one table


def reachable_from(start: DataFrame, edges: DataFrame, from_col: str = "source", to_col: str = "target", depth: int = -1) -> DataFrame:
    """(node, depth): every node that a path from `start` (node) reaches, with the length of a shortest one; the start at 0.

    Breadth first: each round joins the frontier with the edges and drops what is known; rounds are written to the shared folder, so that lost executors lose nothing, and
    joined into one table every few rounds, so that plans stay short. Depth -1: no limit.
    """
    if depth != -1 and depth < 1:
        raise ValueError("depth must be -1 or at least 1")
    steps = edges.select(F.col(from_col).alias("_from"), F.col(to_col).alias("_to")).distinct()
    seen = materialize(start.select("node").distinct().select("node", F.lit(0).alias("depth")), "reach")
    front, level, parts = seen, 0, [seen]
    while depth == -1 or level < depth:
        level += 1
        nexts = front.join(steps, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        front = materialize(nexts.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "reach")
        if front.isEmpty():
            break
        parts.append(front)
        seen = seen.union(front)
        if len(parts) > COMPACT:
            seen = materialize(seen, "reach")
            discard(*parts[:-1])  # the last is the frontier
            parts = [seen]
    return seen


def reached_by_others(start: DataFrame, edges: DataFrame, from_col: str = "source", to_col: str = "target") -> DataFrame:
    """(node): every node that a path from another node of `start` (node) reaches; start nodes too, if another one reaches them.

    Each node keeps two of the start nodes that reach it, since one of two is another one than the node itself. So a node enters the frontier at most twice, however many start nodes there are.
    """
    steps = edges.select(F.col(from_col).alias("_from"), F.col(to_col).alias("_to")).distinct()
    seen = front = materialize(start.select("node").distinct().select("node", F.col("node").alias("origin")), "origins")
    while True:
        nexts = front.join(steps, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), "origin").distinct().join(seen, ["node", "origin"], "left_anti")
        pair = nexts.groupBy("node").agg(F.min("origin").alias("a"), F.max("origin").alias("b"))
        held = seen.groupBy("node").agg(F.count("*").alias("n"))
        kept = pair.join(held, "node", "left").where(F.coalesce("n", F.lit(0)) < 2).select("node", F.explode(F.when(F.col("n") == 1, F.array("a")).otherwise(F.array_distinct(F.array("a", "b")))).alias("origin"))
        last, front = front, materialize(kept, "origins")
        if front.isEmpty():
            return seen.where("node != origin").select("node").distinct()
        old, seen = seen, materialize(seen.union(front), "origins")
        discard(old, last)


def transitive(edges: DataFrame, path: str, direction: str = "upstream", depth: int = -1) -> DataFrame:
    """(path, depth) by path: what a file needs (`upstream`) or what needs it (`downstream`), itself excluded."""
    spark = edges.sparkSession
    ends = ("source", "target") if direction == "upstream" else ("target", "source")
    found = reachable_from(spark.createDataFrame([(path,)], "node string"), edges, *ends, depth=depth)
    return found.where("depth > 0").select(F.col("node").alias("path"), "depth").orderBy("path")


def circular(upstream: DataFrame, downstream: DataFrame, edges: DataFrame) -> DataFrame:
    """Files in both closures of a file: path and whether all edges among them are of the module hierarchy."""
    both = upstream.select("path").join(downstream.select("path"), "path")
    inner = edges.join(both.select(F.col("path").alias("source")), "source", "left_semi")
    flags = inner.groupBy(F.col("source").alias("path")).agg(F.bool_and("is_hier").alias("is_hier"))
    return both.join(flags, "path", "left").select("path", F.coalesce("is_hier", F.lit(False)).alias("is_hier"))


def external_specifiers(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, specifier) of imports and dependencies that resolve to no file. `resolved`: (source, specifier)."""
    specs = files.select(F.col("path").alias("source"), F.explode(F.array_union(F.coalesce("imports", F.array().cast("array<string>")), F.coalesce("dependencies", F.array().cast("array<string>")))).alias("specifier")).distinct()
    return specs.join(resolved.select("source", "specifier").distinct(), ["source", "specifier"], "left_anti").select(F.col("source").alias("path"), "specifier")
