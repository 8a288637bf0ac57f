"""WARC archives: writing pages as records with revisits for equal payloads, and reading archives by their boundary chain.

Reading does not trust the magic string, which payloads may hold too. Every place that looks like a record head is a candidate, with
the offset of the successor that its length field claims. Pointer jumping from the start of the file marks what the chain
reaches, in a number of rounds that is the logarithm of the candidates; the rest lies inside payloads and is dropped.

Writing finds the first page of equal payloads from digests only (combined per task before they move); the html moves once, by
page id, which no common payload can skew. Archives rotate at `ROTATE` bytes, so that one is a row of bounded size in the
shared folder. `read` also takes `spark.read.format("binaryFile")` rows.

Null html is an empty payload. Rows with equal page id and payload are both responses if that id is the smallest. A null page id never
serves as the target of a revisit. Truncated last records, files that do not start with a record, and records of other kinds, without a page's id, a length or
a digest, give no rows. Very long pages are records of archives of their own size; the length of a head is not limited. Empty tables give no archives, and no archives no
records. Extra columns are ignored, whatever their names. The archives' rows are read by many tasks, but one archive by one: its whole chain lies in a row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.arrow import frugal
from lodeglass.storage import materialize

ROTATE, MIN_BYTES = 8_000_000, 0
MAGIC = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """The bytes of one record, with its two closing line ends. A revisit holds the HTTP head alone."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    uri = re.sub(rb"[\x00-\x20]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    head = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id if page_id is not None else "none").encode(), b"WARC-Target-URI: " + uri, b"WARC-Payload-Digest: sha1:" + sha.encode()]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + PROFILE]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return MAGIC + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, rotate: int = ROTATE) -> DataFrame:
    """Rows (archive string, content binary) in the shared folder; every page is one record."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frugal(batches):
            raw = [(x.as_py() or "").encode() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([digest(x) for x in raw], pa.string()), pa.array(map(len, raw), pa.int64())], names=["id", "sha", "size"])

    found = pages.select(pages[id_col].cast("long"), pages[html]).mapInArrow(sums, "id long, sha string, size long")
    first = found.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    later = found.join(first, "sha").where("id is null or id != first").groupBy("id", "sha").agg(F.min("first").alias("first"))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frugal(batches):
            raw = [(x.as_py() or "").encode() for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(raw, pa.binary()), pa.array([digest(x) for x in raw], pa.string())], names=["id", "url", "payload", "sha"])

    rows = pages.select(pages[id_col].cast("long"), pages[url], pages[html]).mapInArrow(tagged, "id long, url string, payload binary, sha string")
    full = rows.alias("a").join(later.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.sha") == F.col("b.sha")), "left").select("a.id", "a.url", "a.payload", "a.sha", "b.first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, n, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            nonlocal n, size
            name, content = f"pages-{part_no:06d}-{n:05d}.warc", b"".join(parts)
            parts.clear()
            n, size = n + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for part in frugal(batches):
            for page, at, payload, sha, target in zip(*part.columns):
                parts.append(record(page.as_py(), at.as_py(), payload.as_py(), sha.as_py(), target.as_py()))
                size += len(parts[-1])
                if size >= rotate:
                    yield out()
        if parts:
            yield out()

    return materialize(full.mapInArrow(write, "archive string, content binary"), "warc")


_BLANK = re.compile(rb"(?=\r\n\r\n)")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)[ \t]*(?=\r\n)", re.I)


def candidates(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that look like a record's head, and the offset that each claims for its successor (-1: it claims none).

    A head ends at the next blank line and claims the first length it states. Blank lines and lengths are found once for all candidates, so that
    payloads full of magic strings cost no more than others.
    """
    starts = np.array([m.start() for m in re.finditer(re.escape(MAGIC), content)], np.int64)
    if not len(starts):
        return starts, starts
    blanks = np.array([*(m.start() for m in _BLANK.finditer(content)), len(content) + 1], np.int64)
    found = list(_LENGTH.finditer(content))
    lengths = np.array([*(int(m[1]) if len(m[1]) < 16 else -1 for m in found), -1], np.int64)
    begins, ends = np.array([*(m.start() for m in found), len(content) + 1], np.int64), np.array([*(m.end() for m in found), len(content) + 1], np.int64)
    head_end = blanks[np.searchsorted(blanks, starts)]
    at = np.searchsorted(begins, starts)
    return starts, np.where((head_end < len(content)) & (ends[at] <= head_end) & (lengths[at] >= 0), head_end + 4 + lengths[at] + 4, -1)


def reachable(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Of which candidates the chain from offset 0 passes, by pointer jumping; `starts` ascending."""
    n = len(starts)
    seen = np.zeros(n + 1, bool)
    if n == 0 or starts[0] != 0:
        return seen[:n]
    to = np.searchsorted(starts, nexts)
    to = np.where((to < n) & (starts[np.minimum(to, n - 1)] == nexts), to, n)
    to = np.append(to, n)  # n: the end, or nowhere
    seen[0] = True
    for _ in range(int(n).bit_length()):
        seen[to[np.flatnonzero(seen)]] = True
        to = to[to]
    return seen[:n]


def parse(content: bytes, start: int, end: int) -> tuple | None:
    """The row of the record in content[start:end], None if it is cut off or no page's record."""
    if end > len(content) or end < 0 or content[end - 4 : end] != b"\r\n\r\n":
        return None
    cut = content.index(b"\r\n\r\n", start)
    head = dict(x.split(b": ", 1) for x in content[start + len(MAGIC) : cut].split(b"\r\n") if b": " in x)
    page = re.fullmatch(rb"<urn:page:(-?[0-9]+|none)>", head.get(b"WARC-Record-ID", b""))
    kind = head.get(b"WARC-Type", b"").decode(errors="replace")
    if not page or kind not in ("response", "revisit"):
        return None
    block = content[cut + 4 : end - 4]
    inner, _, payload = block.partition(b"\r\n\r\n")
    stated, sha = re.search(rb"Content-Length:[ \t]*([0-9]{1,15})(?![0-9])", inner, re.I), head.get(b"WARC-Payload-Digest", b"").decode(errors="replace").removeprefix("sha1:")
    if not stated or not sha:
        return None
    size = int(stated[1])
    target = re.fullmatch(rb"<urn:page:(-?[0-9]+)>", head.get(b"WARC-Refers-To", b""))
    intact = not payload if kind == "revisit" else len(payload) == size and digest(payload) == sha
    return None if page[1] == b"none" else int(page[1]), head.get(b"WARC-Target-URI", b"").decode(errors="replace"), size, sha, kind, int(target[1]) if target else None, payload if kind == "response" else None, intact


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row per record that the boundary chain of its archive reaches, as in `RECORDS`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])
        for part in frugal(batches):
            for cell in part.column(0):
                body = cell.as_py() or b""
                starts, nexts = candidates(body)
                rows = [r for i in np.flatnonzero(reachable(starts, nexts)) if (r := parse(body, int(starts[i]), int(nexts[i])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 8, schema)], schema=schema)

    return archives.select(content).mapInArrow(read, RECORDS)
