"""One file's outline, re-exports, source slices, and what a wrong name may have meant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.functions.paths import dirname, is_hub
from lodeglass.operators.lookup import own_named_imports, winners

MAX_SYMBOL_BYTES, BLOCK = 10_240, 1_000


def line_size(start: Column, end: Column) -> Column:
    """Lines from `start` to `end`, both counted; null where the place is unknown (start 0)."""
    return F.when(start > 0, end - start + 1)


def file_outline(path: str, exports: DataFrame, members: DataFrame, include_private: bool = False) -> DataFrame:
    """parent, name, start_line, end_line, size, signature, visibility, kind: each export, and below it its members by start; closure state only
    with private members."""
    top = exports.where(F.col("file_path") == path).select(F.lit(None).cast("string").alias("parent"), "name", "start_line", "end_line", "signature", "visibility", "kind", F.col("start_line").alias("_at"), F.lit(0).alias("_l"))
    own = members.where(F.col("file_path") == path)
    if not include_private:
        own = own.where("relationship_kind is null or relationship_kind = 'nested-fn'")
    parent = F.regexp_extract("dotted_name", r"^(.*)\.[^.]*$", 1)
    inner = own.select(parent.alias("parent"), F.regexp_extract("dotted_name", r"([^.]*)$", 1).alias("name"), "start_line", "end_line", "signature", "visibility", "kind", F.lit(1).alias("_l"))
    inner = inner.join(top.select(F.col("name").alias("parent"), "_at"), "parent", "left").select(*top.columns)
    return top.unionByName(inner).withColumn("size", line_size(F.col("start_line"), F.col("end_line"))).orderBy("_at", "_l", "start_line", "name").select("parent", "name", "start_line", "end_line", "size", "signature", "visibility", "kind")


def reexports(files: DataFrame, exports: DataFrame) -> DataFrame:
    """(file_path, name, origin, origin_line): exports that a file also imports by name; the origin is the winner in another file, else its own line."""
    own = own_named_imports(files)
    rows = exports.join(own, ["file_path", "name"], "left_semi").select("file_path", "name", "start_line")
    first = winners(exports, own).select("name", F.col("file_path").alias("w"), F.col("start_line").alias("l"))
    other = (F.col("w") != F.col("file_path")) & F.col("l").isNotNull()
    return rows.join(first, "name", "left").select("file_path", "name", F.when(other, F.col("w")).otherwise(F.col("file_path")).alias("origin"), F.when(other, F.col("l")).otherwise(F.col("start_line")).alias("origin_line"))


def concrete_definition(name: str, near: str, exports: DataFrame) -> DataFrame:
    """The definition outside re-export hubs whose directory shares the longest prefix of characters with that of `near`; ties by path."""
    target = dirname(F.lit(near))
    d = dirname(F.col("file_path"))
    longest = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda a, i: F.when((a == i - 1) & (F.substring(d, 1, i) == F.substring(target, 1, i)) & (F.length(d) >= i) & (F.length(target) >= i), i).otherwise(a))
    rows = exports.where((F.col("name") == name) & F.col("start_line").isNotNull() & ~is_hub(F.col("file_path")))
    return rows.withColumn("shared", longest).orderBy(F.desc("shared"), "file_path").limit(1)


def resolve_symbol(symbol: str, exports: DataFrame, members: DataFrame, reexported: DataFrame | None = None) -> DataFrame:
    """Places of `name`, `Type.member`, `file:name` or `file:Type.member`: one row, several if a bare name has several concrete definitions
    (ambiguous), none if it is unknown. Columns name, file_path, start_line, end_line."""
    if "::" in symbol:
        raise ValueError("write Type.member, not Type::member")
    path, _, name = symbol.rpartition(":")
    cols = ("name", "file_path", "start_line", "end_line")
    every = exports.select(*cols).unionByName(members.select(F.col("dotted_name").alias("name"), *cols[1:]))
    rows = every.where(F.col("name") == name)
    if path:
        return rows.where(F.col("file_path") == path).orderBy("start_line").limit(1)
    if "." in name:
        return rows.orderBy(F.desc("file_path")).limit(1)
    own = rows.where(~is_hub(F.col("file_path")))
    own = own.join(reexported, ["file_path", "name"], "left_anti").select(*cols) if reexported is not None else own
    return winners(exports.where(F.col("name") == name), reexported) if own.isEmpty() else own.orderBy("file_path")


def source_slice(places: DataFrame, content: DataFrame) -> DataFrame:
    """`places` (file_path, start_line, end_line) with the text of their lines, clipped to the file. `content`: path, text."""
    lines = F.split("text", "\n")
    cut = F.slice(lines, F.greatest(F.col("start_line"), F.lit(1)).cast("int"), F.greatest(F.col("end_line") - F.greatest(F.col("start_line"), F.lit(1)) + 1, F.lit(0)).cast("int"))
    return places.join(content, F.col("file_path") == F.col("path")).withColumn("body", F.array_join(cut, "\n")).drop("path", "text")


def member_suggestions(wanted: DataFrame, members: DataFrame, limit: int = 5) -> DataFrame:
    """(wanted, suggestion, distance) for names that no type has: members whose last part contains it or is contained in it, else those within two edits
    (names up to eight characters) or three. Wanted names go to every task in blocks of about `BLOCK`, by hash."""
    last = F.regexp_extract("dotted_name", r"([^.]*)$", 1)
    pool = members.select("dotted_name", last.alias("last")).distinct()
    a, b = F.lower("wanted"), F.lower("last")
    within = F.when(F.length("wanted") <= 8, 2).otherwise(3)
    names = wanted.select("wanted").distinct()
    n_blocks = max(1, -(-names.count() // BLOCK))
    near = b.contains(a) | a.contains(b) | (F.levenshtein(a, b) <= within)
    rows = reduce(DataFrame.union, [pool.join(F.broadcast(names.where(F.pmod(F.xxhash64("wanted"), F.lit(n_blocks)) == i)), near) for i in range(n_blocks)])
    part = b.contains(a) | a.contains(b)
    scored = rows.select("wanted", F.col("dotted_name").alias("suggestion"), F.when(part, 0).otherwise(F.levenshtein(a, b)).alias("distance"))
    order = Window.partitionBy("wanted").orderBy("distance", "suggestion")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def unexported(functions: DataFrame, exports: DataFrame) -> DataFrame:
    """Top-level definitions (name, file_path, ...) that their file does not export."""
    return functions.join(exports.select("name", "file_path"), ["name", "file_path"], "left_anti")
