"""Canonical tables from the tables of the benchmark data, so that every operator runs on data of any size.

files      documents: path `source/lang/doc_N.txt`, every tenth below `tests/`, loc the lines of the text
exports    part: the name with underscores, in a file by brand, type, key and size; a signature by key
members    supplier: `NationN.supplyK` in a file per nation
part_files the files that hold exports
edges      lineitem: within an order, the file of each line's part imports that of the next line's part
supplier_edges  the same between suppliers
imports    pages: the link targets of each page
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.operators.resolve import merge_edges

_LINES = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, "tests/").otherwise(""), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    loc = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    return d.select("doc_id", path.alias("path"), loc.cast("long").alias("loc"), F.concat(F.lit("2024-"), F.lpad((1 + F.col("doc_id") % 12).cast("string"), 2, "0")).alias("modified"))


def _part_path() -> Column:
    ext = F.element_at(F.array(F.lit(".ts"), F.lit(".js"), F.lit(".py"), F.lit(".rs")), (F.col("p_size") % 4 + 1).cast("int"))
    return F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.lower("p_type"), F.lit("/m"), (F.col("p_partkey") % 7).cast("string"), ext)


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique by name and file: the part with the largest key."""
    k = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    params = F.when(k % 3 == 0, "").when(k % 3 == 1, "a: i32").otherwise("a: i32, b: Vec<(u8, u8)>")
    signature = F.concat(F.lit("fn "), name, F.lit("("), params, F.lit(")"), F.when(k % 2 == 0, " -> String").otherwise(""))
    kind = F.element_at(F.array(F.lit("fn"), F.lit("struct"), F.lit("const"), F.lit("trait")), (k % 4 + 1).cast("int"))
    row = F.struct(F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + 1 + k % 20).cast("long").alias("end_line"), signature.alias("signature"), F.lit("public").alias("visibility"), kind.alias("kind"))
    return table(spark, sf_dir, "part").groupBy(name.alias("name"), _part_path().alias("file_path")).agg(F.max_by(row, "p_partkey").alias("r")).select("name", "file_path", "r.*")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Nation"), n, F.lit(".supply"), k.cast("string")).alias("dotted_name"), F.concat(F.lit("src/nation_"), n, F.lit(".ts")).alias("file_path"),
        (k % 50 + 1).cast("long").alias("start_line"), (k % 50 + 4).cast("long").alias("end_line"), F.when(k % 5 == 0, "nested-fn").alias("relationship_kind"),
        F.lit("supply(): void").alias("signature"), F.when(k % 3 == 0, "private").otherwise("public").alias("visibility"), F.lit("method").alias("kind"),
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(_part_path().alias("path")).agg(F.sum("p_size").cast("long").alias("loc"), F.max("p_brand").alias("modified"))


def _line_pairs(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*_LINES)
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col(column).alias("a"), F.lead(column).over(order).alias("b"), (F.col("l_linestatus") == "F").alias("is_runtime"), (F.col("l_returnflag") == "N").alias("is_hier")).where("b is not null")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged per pair of parts first, so that the joins with paths see each pair once."""
    pairs = _line_pairs(spark, sf_dir, "l_partkey").groupBy("a", "b").agg(F.bool_or("is_runtime").alias("is_runtime"), F.bool_and("is_hier").alias("is_hier"))
    paths = table(spark, sf_dir, "part").select("p_partkey", _part_path().alias("path"))
    a, b = paths.select(F.col("p_partkey").alias("a"), F.col("path").alias("source")), paths.select(F.col("p_partkey").alias("b"), F.col("path").alias("target"))
    return merge_edges(pairs.join(a, "a").join(b, "b").select("source", "target", "is_runtime", "is_hier"))


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return merge_edges(_line_pairs(spark, sf_dir, "l_suppkey").select(node("a").alias("source"), node("b").alias("target"), "is_runtime", "is_hier"))


_NONE = "CAST(array() AS array<string>)"


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per supplier, `src/nation_N/supply_K` with an extension by K, and its dependencies and imports: by relative paths, dots, ends of paths, crate paths and dotted names."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_nationkey % 4 AS n", "element_at(array('.ts', '.py', '.rs'), CAST(s_suppkey % 3 + 1 AS int)) AS ext")
    path = "concat('src/nation_', n, '/supply_', k, ext)"
    other = "concat('nation_', (n + 1) % 4, '/supply_', 3 * k % 100 + 1)"
    return rows.selectExpr(
        f"{path} AS path",
        f"CASE ext WHEN '.ts' THEN array(concat('./supply_', k + 25), concat('../', {other}), {other}) WHEN '.py' THEN array(concat('.supply_', k + 25), concat('..', replace({other}, '/', '.'))) ELSE array(concat('crate::', replace({other}, '/', '::')), concat('crate::supply_', 7 * k % 50)) END AS dependencies",
        f"CASE WHEN ext = '.py' THEN array(replace({other}, '/', '.'), concat('supply_', 5 * k % 90, '.x'), concat('src.nation_', n, '.supply_', k + 50)) ELSE {_NONE} END AS imports",
        f"CASE WHEN k % 4 = 0 THEN map(concat('./supply_', k + 25), 'type-only') ELSE CAST(map() AS map<string,string>) END AS dependency_kinds",
    )


def workspace_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, packages): a package per nation with a source file per supplier, which imports that of the supplier whose key is seven times its own."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n", "CASE WHEN s_suppkey % 2 = 0 THEN '.ts' ELSE '.rs' END AS ext")
    other = s.selectExpr("k AS j", "n AS m")
    spec = "CASE WHEN ext = '.ts' THEN concat('@n/nation_', m, '/supply_', j) ELSE concat('nation_', m, '::supply_', j, '::Thing') END"
    rows = s.join(other, F.expr("j = 7 * k"), "left").selectExpr(
        "concat('packages/nation_', n, '/src/supply_', k, ext) AS path", f"CASE WHEN j IS NULL THEN {_NONE} ELSE array({spec}) END AS dependencies", f"{_NONE} AS imports", "CAST(map() AS map<string,string>) AS dependency_kinds"
    )
    names = s.select("n").distinct().selectExpr("concat('packages/nation_', n) AS directory", "explode(array(struct('js' AS ecosystem, concat('@n/nation_', n) AS name), struct('rust' AS ecosystem, concat('nation_', n) AS name))) AS p")
    return rows, names.select("p.ecosystem", "p.name", "directory")


def module_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): each supplier's file with hubs and files of its nation, of the next one and of the folder above, both ways."""
    k, n, ext = "s_suppkey", "s_nationkey", "element_at(array('ts', 'py', 'rs'), CAST(s_suppkey % 3 + 1 AS int))"
    hub = "element_at(array('index.ts', '__init__.py', 'mod.rs'), CAST(s_suppkey % 3 + 1 AS int))"
    own = f"concat('src/nation_', {n}, '/supply_', {k}, '.', {ext})"
    others = [f"concat('src/nation_', {n}, '/', {hub})", f"concat('src/nation_', ({n} + 1) % 25, '/', {hub})", f"concat('src/nation_', {n}, '.', {ext})", f"concat('src/', {hub})", f"concat('src/nation_', {n}, '/supply_', {k}, '/deep.', {ext})"]
    rows = table(spark, sf_dir, "supplier").selectExpr(f"{own} AS a", f"explode(array({', '.join(others)})) AS b")
    return rows.selectExpr("a AS source", "b AS target").union(rows.selectExpr("b", "a"))


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and imports of every page."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce(hrefs, F.array().cast("array<string>")).alias("imports"))


def stored_fingerprints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, stored): the documents, and an older state of them that lacks some, holds others changed, and some that are gone."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("source_size"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))
    current = d.select("path", F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("source_mtime"), "source_size", "content_hash")
    stored = d.where("doc_id % 7 != 0").select(
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("old_"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("doc_id") % 13 == 0, None).otherwise(F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string"))).alias("source_mtime"), "source_size",
        F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 17 == 0, 1).otherwise(2).alias("parser_cache_version"),
    )
    return current, stored
