r"""Benchmark decontamination by Wu-Manber search over words.

A window is 13 consecutive words of an item (all words of a shorter one). Blocks of two words index a shift table: where the block under
the scan occurs nowhere in any window, the scan jumps by nearly a whole window; a block that ends some window selects a
bucket of windows by length and words, and comparison of the words confirms. Windows are dealt into classes by length, so that short items don't shorten
the jumps for long ones.

Documents are scanned where they lie; nothing of them moves. The benchmark is cut into blocks of about `BLOCK_BYTES`. One block at a time is gathered and goes to every task, which
adds the runs of hit words and the items beside the text. After each block but the last the documents are written with what was found so far, so that neither the driver nor
a task holds two blocks.

Very long texts are scanned whole. Empty tables give empty results. Extra columns are ignored, whatever their names. Null texts and texts without words have no hits; items without words have no windows. Items with a null id are ignored, rows with the same item id
are one item. Repeated documents are judged each. `clean_filter` keeps all columns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.arrow import frugal
from lodeglass.storage import materialize

WINDOW, BLOCK_BYTES = 13, 16_000_000
CLASSES = (13, 6, 3, 2, 1)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z only (as `bytes.lower` does); words of digits, letters and all beyond ASCII."""
    return _WORD.findall(text.lower())


class WindowTable:
    """Wu-Manber tables of windows of at least `least` words each."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], least: int):
        self.m, self.b = least, min(2, least)
        self.far = self.m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)  # of the windows by length
        for window, items in windows.items():
            for j in range(self.far):
                block = window[j : j + self.b] if self.b > 1 else window[j]
                self.shift[block] = min(self.shift.get(block, self.far), self.m - self.b - j)
            bucket = self.buckets[window[self.m - self.b : self.m] if self.b > 1 else window[self.m - 1]]
            bucket.setdefault(len(window), {})[window] = sorted(items)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, word after the last, items) of every occurrence."""
        shift, far, n, back, i = self.shift.get, self.far, len(words), self.m - 1, self.m - 1
        while i < n:
            block = (words[i - 1], words[i]) if self.b > 1 else words[i]
            jump = shift(block, far)
            if jump:
                i += jump
                continue
            start = i - back
            for size, windows in self.buckets[block].items():
                if items := windows.get(tuple(words[start : start + size])):
                    yield start, start + size, items
            i += 1


def tables(items: list[tuple[str, bytes]], size: int = WINDOW) -> list[WindowTable]:
    windows: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = tuple(words_of(text))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            window = words[i : i + size]
            windows[next(c for c in CLASSES if c <= len(window))][window].add(item)
    return [WindowTable(w, min(map(len, w))) for _, w in sorted(windows.items())]


def search(words: list[bytes], found_in: list[WindowTable]) -> tuple[list[tuple[int, int]], list[str]]:
    """(runs of hit words, ascending and apart; items with a window that occurs)."""
    spans, items = [], set()
    for table in found_in:
        for a, b, owners in table.find(words):
            spans.append((a, b))
            items.update(owners)
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs, sorted(items)


_FOUND = "n_words long, hits array<struct<first:long,after:long>>, items array<string>"
_NOTHING = ("CAST(NULL AS long) AS n_words", "CAST(array() AS array<struct<first:long,after:long>>) AS hits", "CAST(array() AS array<string>) AS items")


def _scan(rows: DataFrame, block: list[tuple[str, bytes]], last: bool) -> tuple[DataFrame, Broadcast]:
    """`rows` (row, body, and the columns of `_FOUND`) with what the block's windows add, the texts for a further block only; and what the tasks share."""
    names = ["row", *(() if last else ("body",)), "n_words", "hits", "items"]
    shared = rows.sparkSession.sparkContext.broadcast(tables(block))
    kinds = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in frugal(batches):
            counts, hits, items = [], [], []
            for cell, before, known in zip(part.column(1).cast(pa.binary()), part.column(3), part.column(4)):
                words = words_of(cell.as_py() or b"")
                runs, who = search(words, own)
                counts.append(len(words))
                hits.append(before.as_py() + [{"first": a, "after": b} for a, b in runs])
                items.append(known.as_py() + who)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names) - 3], pa.array(counts, pa.int64()), pa.array(hits, kinds), pa.array(items, pa.list_(pa.string()))], names=names)

    texts = "" if last else "body string, "
    return rows.mapInArrow(task, f"row {rows.schema['row'].dataType.simpleString()}, {texts}{_FOUND}"), shared


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The items, in lists of about `limit` bytes, gathered one after another, and whether it is the last."""
    own = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        yield [(r["i"], r["t"].encode()) for r in own.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()], k == n - 1


def _found(rows: DataFrame, benchmark: DataFrame, item: str, text: str, limit: int) -> DataFrame:
    """`rows` (row, body) with n_words, the runs of hit words (of each block; they may overlap) and the items."""
    now = rows.selectExpr("row", "body", *_NOTHING)
    for block, last in _blocks(benchmark, item, text, limit):
        now, shared = _scan(now, block, last)
        if not last:
            now = materialize(now, "scanned")
            shared.destroy()
    return now


def n_hit() -> Column:
    """Words in the union of the runs in `hits`."""
    begin = F.struct(F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["after"], x["after"]).alias("after"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["after"] - F.greatest(x["first"], acc["after"]))).alias("n"))
    return F.aggregate(F.array_sort("hits"), begin, step, lambda acc: acc["n"])


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def judge(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, and the runs of hit words (`hits`)."""
    rows = documents.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("row"), F.col(text).alias("body"))
    found = _found(rows, benchmark, item, item_text, limit).select("row.doc_id", "n_words", n_hit().alias("n_hit"), F.array_sort("items").alias("items"), "hits")
    out = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "hits")
    return out.withColumn("contaminated", _contaminated()).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")


def clean_filter(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """`documents` with all their columns, without contaminated ones."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(text).alias("body"))
    judged = _found(rows, benchmark, item, item_text, limit).select("row", "n_words", n_hit().alias("n_hit"))
    return judged.where(~_contaminated()).select(*[F.col("row")[c].alias(c) for c in documents.columns])
