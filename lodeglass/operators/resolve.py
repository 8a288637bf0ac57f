"""Dependency edges: which files the specifiers of a file mean.

Every rule becomes an equality on keys that are computed once per file (its stem, the suffixes of its stem), so the joins are linear in files and
specifiers; nothing compares all files with all specifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.names import is_test_path
from lodeglass.functions.paths import basename, boundary_suffixes, dirname, is_hierarchy, join_path, normalize, strip_any_ext, strip_source_ext

INDEX_NAMES = ("index.ts", "index.tsx", "index.js", "index.jsx")
JS = r"\.[jt]sx?$"


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per pair: runtime if any is, of the hierarchy if all are."""
    return edges.groupBy("source", "target").agg(F.bool_or("is_runtime").alias("is_runtime"), F.bool_and("is_hier").alias("is_hier"))


def specifiers(files: DataFrame) -> DataFrame:
    """(source, specifier, is_runtime) of dependencies; a kind that is not stored is runtime."""
    rows = files.select(F.col("path").alias("source"), F.explode("dependencies").alias("specifier"), "dependency_kinds")
    return rows.select("source", "specifier", (F.coalesce(F.try_element_at("dependency_kinds", "specifier"), F.lit("runtime")) != "type-only").alias("is_runtime")).distinct()


def python_relative(source: Column, specifier: Column) -> Column:
    """The stem that `.b` or `..a.b` means: n dots are n - 1 directories up; bare dots mean nothing."""
    dots, rest = F.length(F.regexp_extract(specifier, r"^(\.+)", 1)), F.regexp_extract(specifier, r"^\.+(.+)$", 1)
    up = F.repeat(F.lit("../"), dots - 1)
    return F.when(rest != "", join_path(dirname(source), F.concat(up, F.translate(rest, ".", "/"))))


def _stems(files: DataFrame) -> DataFrame:
    """(target, stem, package stem): without extension, and without a closing `/__init__`."""
    stem = strip_any_ext(F.col("path"))
    return files.select(F.col("path").alias("target"), stem.alias("stem"), F.regexp_replace(stem, r"/__init__$", "").alias("module"))


def resolve_relative(specs: DataFrame, files: DataFrame) -> DataFrame:
    """One target for each relative specifier: the file of that stem, else a package's `__init__`, else an index file; ties by path."""
    js = F.col("specifier").rlike(r"^\.\.?(?:/|$)")
    key = F.when(js, join_path(dirname(F.col("source")), strip_source_ext(F.col("specifier")))).otherwise(python_relative(F.col("source"), F.col("specifier")))
    wanted = specs.where(F.col("specifier").startswith(".")).withColumn("key", key).where("key is not null")
    targets = _stems(files)
    index = F.array(*[F.lit(x) for x in INDEX_NAMES])
    place = F.array_position(index, basename(F.col("target")))
    keys = targets.select("target", F.col("stem").alias("key"), F.lit(0).cast("long").alias("rank")).union(targets.where("module != stem").select("target", "module", F.lit(1).cast("long"))).union(targets.where(place > 0).select("target", dirname(F.col("target")), place + 1))
    hits = wanted.join(keys, "key")
    best = hits.groupBy("source", "specifier", "is_runtime").agg(F.min(F.struct("rank", "target")).alias("best"))
    return best.select("source", "specifier", "is_runtime", F.col("best.target").alias("target"))


def resolve_suffix(specs: DataFrame, files: DataFrame) -> DataFrame:
    """Every file that a specifier with `/` or `crate::` means by its end.

    A path means every file whose stem ends with its last part, without regard to borders (a longer match implies this one); a path that ends with
    `/` names nothing. `crate::a::b` means the stems that end with `a/b`. Both meet on the last part: all character suffixes of a stem's basename.
    """
    crate = F.col("specifier").startswith("crate::")
    path = F.when(crate, F.regexp_replace(F.expr("substring(specifier, 8)"), "::", "/")).otherwise(F.col("specifier"))
    wanted = specs.where(~F.col("specifier").startswith(".") & (crate | F.col("specifier").contains("/"))).withColumn("path", path).withColumn("key", basename(F.col("path"))).where("key != ''")
    base = basename(F.col("stem"))
    keys = _stems(files).select("target", "stem", F.explode(F.transform(F.sequence(F.lit(1), F.length(base)), lambda i: F.substring(base, i, F.length(base)))).alias("key"))
    return wanted.join(keys, "key").where("source != target").where(~crate | F.col("stem").endswith(F.col("path"))).select("source", "specifier", "is_runtime", "target").distinct()


def resolve_dotted(files: DataFrame) -> DataFrame:
    """Every file that a dotted import means: `a.b` the modules `a/b` and those that end with `/a/b`. Runtime."""
    x = F.col("specifier")
    wanted = files.select(F.col("path").alias("source"), F.explode("imports").alias("specifier")).where(x.contains(".") & ~x.startswith(".") & ~x.contains("/") & ~x.contains("::")).withColumn("key", F.translate(x, ".", "/")).distinct()
    keys = _stems(files).select("target", F.explode(boundary_suffixes(F.col("module"))).alias("key"))
    return wanted.join(keys, "key").where("source != target").select("source", "specifier", F.lit(True).alias("is_runtime"), "target").distinct()


def resolve_workspace(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Targets in other packages of the workspace. A specifier belongs to the longest package name that begins it at a border.

    js: the package's file of that path, with the usual extensions or an index file, also below `src`; a bare name is the index.
    rust: `name::a::B` the deepest module file below the crate's `src`, else its lib.rs. go: all files of the package's directory but tests.
    python, deno: the module file or its `__init__`.
    """
    own = files.select(F.col("path").alias("source"), F.explode(F.array_union(F.coalesce("imports", F.array().cast("array<string>")), F.coalesce("dependencies", F.array().cast("array<string>")))).alias("specifier"))
    parts = F.filter(F.split(F.regexp_replace("specifier", "::", "/"), "/"), lambda p: p != "")
    heads = own.where(~F.col("specifier").startswith(".")).select("source", "specifier", parts.alias("parts")).where("size(parts) > 0").select("source", "specifier", "parts", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))).alias("n", "name"))
    ext = F.regexp_extract("source", r"\.([^.]*)$", 1)
    eco = F.when(ext.rlike("^[jt]sx?$"), F.array(F.lit("js"), F.lit("deno"))).when(ext == "rs", F.array(F.lit("rust"))).when(ext == "go", F.array(F.lit("go"))).when(ext == "py", F.array(F.lit("python"))).otherwise(F.array().cast("array<string>"))
    named = heads.join(packages.select("ecosystem", "name", "directory"), "name").where(F.array_contains(eco, F.col("ecosystem")))
    best = named.groupBy("source", "specifier", "ecosystem").agg(F.max_by(F.struct("directory", "parts", "n"), "n").alias("b")).select("source", "specifier", "ecosystem", F.col("b.directory").alias("directory"), F.expr("slice(b.parts, b.n + 2, size(b.parts))").alias("rest"))
    rest = F.array_join("rest", "/")
    base = normalize(F.concat_ws("/", "directory", F.when(rest != "", rest)))
    shorter = F.filter(F.transform(F.sequence(F.lit(0), F.size("rest")), lambda i: F.concat_ws("/", F.array(F.col("directory"), F.lit("src")), F.when(F.size("rest") > i, F.array_join(F.slice("rest", F.lit(1), F.size("rest") - i), "/")))), lambda x: x.isNotNull())
    js = F.concat(*[F.array(*[F.concat(b, F.lit(e)) for e in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")]) for b in (base, normalize(F.concat_ws("/", "directory", F.lit("src"), F.when(rest != "", rest))))])
    rust = F.flatten(F.transform(shorter, lambda x: F.array(F.concat(x, F.lit(".rs")), F.concat(x, F.lit("/mod.rs")), F.concat(x, F.lit("/lib.rs")))))
    python = F.flatten(F.transform(F.array(base, normalize(F.concat_ws("/", "directory", F.lit("src"), F.when(rest != "", rest)))), lambda x: F.array(F.concat(x, F.lit(".py")), F.concat(x, F.lit("/__init__.py")))))
    asked = best.withColumn("c", F.when(F.col("ecosystem").isin("js", "deno"), js).when(F.col("ecosystem") == "rust", rust).when(F.col("ecosystem") == "python", python)).select("source", "specifier", "ecosystem", base.alias("base"), F.posexplode_outer("c").alias("rank", "target"))
    exact = asked.where("ecosystem != 'go'").join(files.select(F.col("path").alias("target")), "target")
    one = exact.groupBy("source", "specifier").agg(F.min(F.struct("rank", "target")).alias("b")).select("source", "specifier", F.col("b.target").alias("target"))
    go_files = files.where(F.col("path").endswith(".go") & ~is_test_path(F.col("path"))).select(dirname(F.col("path")).alias("base"), F.col("path").alias("target"))
    go = asked.where("ecosystem = 'go'").select("source", "specifier", "base").distinct().join(go_files, "base").select("source", "specifier", "target")
    return one.union(go).where("source != target").select("source", "specifier", F.lit(True).alias("is_runtime"), "target")


def resolve_all(files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(source, specifier, is_runtime, target) by every rule. Rust files of a Cargo workspace leave their crate's own paths to the workspace rule."""
    specs = specifiers(files)
    out = resolve_relative(specs, files).select("source", "specifier", "is_runtime", "target").union(resolve_suffix(specs, files)).union(resolve_dotted(files))
    return out if packages is None else out.union(resolve_workspace(files, packages))


def build_edges(files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """The edge table of an index."""
    found = resolve_all(files, packages)
    return merge_edges(found.select("source", "target", "is_runtime", is_hierarchy(F.col("source"), F.col("target")).alias("is_hier")))


def import_specifiers(pairs: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(source, target, specifier): the texts by which `source` may import `target`: relative, with and without extension, and, with
    packages, below the name of the directory that holds it."""
    a, b = F.split(dirname(F.col("source")), "/"), F.split(F.col("target"), "/")
    a = F.when(dirname(F.col("source")) == "", F.array().cast("array<string>")).otherwise(a)
    common = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(a), F.lit(1)) - 1), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, i: F.struct((acc["n"] + (acc["go"] & (F.get(a, i) == F.get(b, i)) & (i < F.size(b) - 1)).cast("int")).alias("n"), (acc["go"] & F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))).alias("go")), lambda acc: F.coalesce(acc["n"], F.lit(0)))
    ups = F.size(a) - common
    rel = F.concat(F.when(ups == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), ups)), F.array_join(F.slice(b, common + 1, F.size(b)), "/"))
    out = pairs.select("source", "target", F.explode(F.array_distinct(F.array(rel, strip_source_ext(rel)))).alias("specifier"))
    if packages is None:
        return out
    named = pairs.join(packages, F.col("target").startswith(F.concat(F.col("directory"), F.lit("/"))))
    below = F.concat(basename(F.col("directory")), F.expr("substring(target, length(directory) + 1)"))
    return out.union(named.select("source", "target", F.explode(F.array_distinct(F.array(below, strip_source_ext(below))))))
