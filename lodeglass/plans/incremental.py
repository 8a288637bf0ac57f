"""What an incremental run has to do, from fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.schema import PARSER_CACHE_VERSION

REPARSE, UP_TO_DATE, REFRESH = "reparse", "up_to_date", "refresh_fingerprint"


def fnv1a64(values: list[bytes]) -> list[str]:
    """FNV-1a of each value, as `fnv1a64:` and 16 hexadecimal digits; all values of a batch at once, byte by byte."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    state = np.full(len(values), 0xCBF29CE484222325, np.uint64)  # fixed by the hash
    prime, width = np.uint64(0x100000001B3), 4096
    longest = len(values[order[0]]) if values else 0
    for start in range(0, longest, width):
        live = [values[i][start : start + width] for i in order if len(values[i]) > start]
        block = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in live), np.uint8).reshape(len(live), width)
        sizes = np.array([len(v) for v in live])
        block = np.ascontiguousarray(block.T)
        for j in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -j, "left"))
            state[:n] = (state[:n] ^ block[j, :n]) * prime
    out = [""] * len(values)
    for place, i in enumerate(order):
        out[i] = f"fnv1a64:{int(state[place]):016x}"
    return out


def content_hash(content: DataFrame) -> DataFrame:
    """(path, source_size, content_hash) of (path, text); null texts count as empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, 512):
                piece = part.slice(at, 512)
                raw = [x.as_py() or b"" for x in piece.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(map(len, raw), pa.int64()), pa.array(fnv1a64(raw), pa.string())], names=["path", "source_size", "content_hash"])

    return content.select("path", "text").mapInArrow(task, "path string, source_size long, content_hash string")


def decide(current: DataFrame, stored: DataFrame, force: bool = False, parser_version: int = PARSER_CACHE_VERSION) -> DataFrame:
    """(path, decision) for current files (path, source_mtime, source_size, content_hash). Stored fingerprints with a null field don't count.

    Equal time, size and parser version: up to date, whatever the hash. Equal hash and version: refresh the fingerprint. Else: parse again.
    """
    known = stored.select(F.col("path").alias("_p"), F.col("source_mtime").alias("_m"), F.col("source_size").alias("_s"), F.col("content_hash").alias("_h"), F.col("parser_cache_version").alias("_v")).na.drop()
    joined = current.join(known, F.col("path") == F.col("_p"), "left")
    same_version = F.col("_v") == parser_version
    decision = (
        F.when(F.lit(force) | F.col("_p").isNull(), REPARSE)
        .when(same_version & (F.col("_m") == F.col("source_mtime")) & (F.col("_s") == F.col("source_size")), UP_TO_DATE)
        .when(same_version & (F.col("_h") == F.col("content_hash")), REFRESH)
        .otherwise(REPARSE)
    )
    return joined.select("path", decision.alias("decision"))


def removed(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Stored paths that are gone; none when everything is rebuilt."""
    gone = stored.select("path").join(current.select("path"), "path", "left_anti")
    return gone.limit(0) if force else gone


def validate(decisions: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, reason) of files that the index does not show as they are: `stale` if it has them, else `not indexed`."""
    known = stored.select(F.col("path").alias("_p")).distinct()
    return decisions.where(F.col("decision") == REPARSE).join(known, F.col("path") == F.col("_p"), "left").select("path", F.when(F.col("_p").isNotNull(), "stale").otherwise("not indexed").alias("reason"))
