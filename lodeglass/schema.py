"""Canonical fact tables.

files    one row per source file; fingerprint columns are null where never taken
exports  top-level symbols, unique by (name, file_path)
members  dotted symbols of a class or function; relationship_kind null, nested-fn or closure-state
edges    source imports target; is_runtime false for type-only edges, is_hier true between a module and its parent
packages workspace packages
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "path string, loc long, modified string, imports array<string>, dependencies array<string>, dependency_kinds map<string,string>, named_imports map<string,array<string>>, namespace_imports array<string>, function_names array<string>, source_mtime string, source_size long, content_hash string, parser_cache_version int"
EXPORTS = "name string, file_path string, start_line long, end_line long, signature string, visibility string, kind string"
MEMBERS = "dotted_name string, file_path string, start_line long, end_line long, relationship_kind string, signature string, visibility string, kind string"
EDGES = "source string, target string, is_runtime boolean, is_hier boolean"
PACKAGES = "ecosystem string, name string, directory string"
FINGERPRINTS = "path string, source_mtime string, source_size long, content_hash string, parser_cache_version int"
CONTENT = "path string, text string"
META = "key string, value string"

VISIBILITIES = ("public", "crate", "protected", "private", "non_exported")
KINDS = ("fn", "method", "field", "const", "test", "struct", "trait", "impl", "enum", "variant", "module", "macro", "type")
RELATIONSHIPS = ("nested-fn", "closure-state")
SCHEMA_VERSION, PARSER_CACHE_VERSION = 6, 2


def edge_label(runtime: Column | str = "is_runtime", hier: Column | str = "is_hier") -> Column:
    """runtime, mod-hierarchy, type-only or type-only mod-hierarchy."""
    runtime, hier = (F.col(c) if isinstance(c, str) else c for c in (runtime, hier))
    return F.when(runtime & hier, "mod-hierarchy").when(runtime, "runtime").when(hier, "type-only mod-hierarchy").otherwise("type-only")


def valid_path(path: Column) -> Column:
    """Relative, non-empty, with `/` between parts, none of them empty, `.` or `..`."""
    parts = F.split(path, "/")
    return (path != "") & ~path.contains("\\") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def valid_symbol(kind: Column, visibility: Column) -> Column:
    """The enumerations hold; nulls are allowed."""
    return (kind.isNull() | kind.isin(*KINDS)) & (visibility.isNull() | visibility.isin(*VISIBILITIES))
