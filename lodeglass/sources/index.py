"""From source texts to fact tables, and verification on texts: parsing, call sites, private members."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass import schema
from lodeglass.plans.incremental import content_hash
from lodeglass.sources.parsers import call_site, parse_file
from lodeglass.sources.parsers.model import Symbol

_SYMBOL = "struct<name:string,start_line:bigint,end_line:bigint,signature:string,visibility:string,kind:string,relationship_kind:string>"
_PARSED = f"path string, loc long, imports array<string>, dependencies array<string>, dependency_kinds map<string,string>, named_imports map<string,array<string>>, namespace_imports array<string>, function_names array<string>, custom map<string,string>, exports array<{_SYMBOL}>, members array<{_SYMBOL}>, hidden array<{_SYMBOL}>"


def _row(s: Symbol) -> dict:
    return {"name": s.name, "start_line": s.start or None, "end_line": s.end or None, "signature": s.signature, "visibility": s.visibility, "kind": s.kind, "relationship_kind": s.relationship}


def parse(content: DataFrame) -> DataFrame:
    """One row per file with a parser, with all that its parser finds. `content`: path, text. Texts stay where they are."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                found = parse_file(path, text or "")
                if found is not None:
                    rows.append((path, found.loc, found.imports, found.dependencies, found.dependency_kinds, found.named_imports, found.namespace_imports, found.function_names, found.custom_json(), [_row(s) for s in found.exports], [_row(s) for s in found.members], [_row(s) for s in found.hidden]))
            yield pd.DataFrame(rows, columns=["path", "loc", "imports", "dependencies", "dependency_kinds", "named_imports", "namespace_imports", "function_names", "custom", "exports", "members", "hidden"])

    return content.select("path", "text").mapInPandas(task, _PARSED)


def facts(content: DataFrame) -> dict[str, DataFrame]:
    """files, exports, members and hidden (top-level or member symbols that are not exported) of `content` (path, text, source_mtime, source_size). Parsed once."""
    from lodeglass.storage import materialize

    parsed = materialize(parse(content), "parsed")
    prints = content.select("path", "source_mtime").join(content_hash(content), "path")
    files = parsed.join(prints, "path").select("path", "loc", F.col("source_mtime").alias("modified"), "imports", "dependencies", "dependency_kinds", "named_imports", "namespace_imports", "function_names", "source_mtime", "source_size", "content_hash", F.lit(schema.PARSER_CACHE_VERSION).alias("parser_cache_version"))
    flat = lambda c: parsed.select(F.col("path").alias("file_path"), F.explode(c).alias("s")).select("file_path", "s.*")
    exports = flat("exports").select("name", "file_path", "start_line", "end_line", "signature", "visibility", "kind")
    dotted = lambda df: df.select(F.col("name").alias("dotted_name"), "file_path", "start_line", "end_line", "relationship_kind", "signature", "visibility", "kind")
    return {"files": files, "exports": exports, "members": dotted(flat("members")), "hidden": dotted(flat("hidden"))}


def find_hidden(content: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """(file_path, name, start_line, end_line, signature, visibility, kind) of symbols that no file exports: private members and further top-level definitions.
    Only files whose text holds the name are parsed."""
    last = name.rsplit(".", 1)[-1]
    rows = content.where(F.col("text").contains(last))
    if path is not None:
        rows = rows.where(F.col("path") == path)
    found = parse(rows).select(F.col("path").alias("file_path"), F.explode("hidden").alias("s")).select("file_path", "s.*").drop("relationship_kind")
    return found.where(F.col("name") == name)


def call_sites(content: DataFrame, symbol: str) -> DataFrame:
    """(path, call) of each candidate file: direct, namespace, or null where the file does not call the symbol."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "call": [call_site(p, t, symbol) for p, t in zip(pdf["path"], pdf["text"])]})

    return content.select("path", "text").mapInPandas(task, "path string, call string")


def verified_users(users: DataFrame, content: DataFrame, symbol: str, exports: DataFrame) -> DataFrame:
    """(user, class) of the candidates `users` (user): caller, namespace, or re-export for files that don't call the symbol but export its name; the
    rest is dropped. Files whose text is missing are kept as callers."""
    own = users.select(F.col("user").alias("path")).distinct()
    found = call_sites(content.join(own, "path", "left_semi"), symbol)
    again = exports.where(F.col("name") == symbol).select(F.col("file_path").alias("path"), F.lit(True).alias("again")).distinct()
    known = content.select("path", F.lit(True).alias("known"))
    rows = own.join(known, "path", "left").join(found, "path", "left").join(again, "path", "left")
    kind = F.when(F.col("known").isNull() | (F.col("call") == "direct"), "caller").when(F.col("call") == "namespace", "namespace").when(F.col("again"), "re-export")
    return rows.select(F.col("path").alias("user"), kind.alias("class")).where("class is not null")


def incremental_generate(store, content: DataFrame, force: bool = False, packages: DataFrame | None = None) -> dict[str, int]:
    """Brings a store up to date with a scan: parses what changed, refreshes fingerprints of what only looks changed, deletes what is gone, and rebuilds ids and
    edges from everything if anything did. Returns the numbers of files by decision."""
    from lodeglass.plans import incremental
    from lodeglass.storage import materialize

    content = materialize(content, "content")
    current = content.select("path", "source_mtime").join(content_hash(content), "path")
    stored = store.fingerprints()
    decisions = materialize(incremental.decide(current, stored, force), "decisions")
    gone = materialize(incremental.removed(current, store.load("files").select("path")), "removed")
    counts = {r["decision"]: r["n"] for r in decisions.groupBy("decision").agg(F.count("*").alias("n")).collect()} | {"removed": gone.count()}
    dirty = content.join(decisions.where(F.col("decision") == incremental.REPARSE).select("path"), "path", "left_semi")
    if packages is not None:
        store._write("packages", packages)
    if force or not store.exists():
        found = facts(content)
        store.write_full(found["files"], found["exports"], found["members"])
    else:
        if counts.get(incremental.REFRESH):
            fresh = current.join(decisions.where(F.col("decision") == incremental.REFRESH).select("path"), "path", "left_semi")
            store.refresh_fingerprints(fresh.withColumn("parser_cache_version", F.lit(schema.PARSER_CACHE_VERSION)))
        if counts["removed"]:
            store.delete(gone)
        if counts.get(incremental.REPARSE):
            found = facts(dirty)
            store.upsert(found["files"], found["exports"], found["members"])
            store.rebuild_ids()
        if counts.get(incremental.REPARSE) or counts["removed"]:
            store.rebuild_edges()
    return counts
