r"""Secrets in texts, and their structure: patterns find candidates, decoding and parsing confirms them.

Patterns alone report assignments, access keys and long hex runs (the base spans, always kept). The method then decodes base64
and hex candidates and reports what has the inner structure of a secret: PEM blocks whose body decodes (with or without headers and
an armor's checksum; encrypted keys are known by their headers), DER structures
whose nested lengths add up (private and public keys), OpenSSH keys whose length-prefixed fields fill the whole, and signed
tokens with a JSON head that names an algorithm. Each confirmed structure is a span of its own kind, after the base kinds.

Spans count code points, ends exclusive. A null text is empty. Repeated rows are scanned each. Texts are scanned whole and
in linear time; nothing moves between tasks. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeglass.llm.arrow import frugal

KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,60})-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
_PEM_HEADERS = re.compile(r"\s*+((?:[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n(?:[\x20\t]+[^\s][^\n]*+\n)*+)++)[\x20\t\r]*+\n")
_CHECKSUM = re.compile(r"\s=[A-Za-z0-9+/]{4}\s*\Z")
_SSH = re.compile(r"\b(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp(?:256|384|521))[\x20\t]+([A-Za-z0-9+/]{40,}={0,2})")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_ANYHEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])")


def unbase64(text: str) -> bytes | None:
    """The bytes of a base64 or base64url text, with or without padding, None if it is neither."""
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fits(raw: bytes) -> bool:
    """Whether `raw` is one ASN.1 SEQUENCE whose nested lengths add up at every level, holding a number or a named algorithm."""

    def items(at: int, end: int, depth: int, tags: list[int]) -> bool:
        while at < end:
            if end - at < 2 or depth > 16:
                return False
            tag, size, at = raw[at], raw[at + 1], at + 2
            if size & 0x80:
                n = size & 0x7F
                if not 1 <= n <= 4 or end - at < n or raw[at] == 0:
                    return False
                size, at = int.from_bytes(raw[at : at + n], "big"), at + n
            if size > end - at or tag & 0x1F == 0x1F:
                return False
            tags.append(tag)
            if tag & 0x20 and not items(at, at + size, depth + 1, tags):
                return False
            at += size
        return at == end

    tags: list[int] = []
    return len(raw) >= 16 and raw[0] == 0x30 and items(0, len(raw), 0, tags) and len(tags) >= 3 and bool({0x02, 0x06} & set(tags))


def ssh_fits(raw: bytes) -> bool:
    """Whether `raw` is a chain of length-prefixed fields, the first a key type."""
    at, fields = 0, []
    while at + 4 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if size > len(raw) - at - 4:
            return False
        fields.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(raw) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-"))


def jwt_fits(head: str, body: str) -> bool:
    """Whether the head decodes to a JSON object that names an algorithm, and the body to bytes (of a JSON object, if unencrypted)."""
    raw = unbase64(head)
    try:
        fields = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str) and unbase64(body) is not None


def pem_fits(label: str, block: str) -> bool:
    """Whether what lies between the lines of a PEM block decodes to a key, a PGP packet, or an encrypted key by its headers."""
    head = _PEM_HEADERS.match(block)
    body = block[head.end() :] if head else block
    raw = unbase64(_CHECKSUM.sub("", body) if "PGP" in label else body)
    if not raw:
        return False
    encrypted = head and "PRIVATE KEY" in label and re.search(r"^Proc-Type:[^\n]*\bENCRYPTED\b", head[1], re.M) and re.search(r"^DEK-Info:", head[1], re.M)
    return bool(encrypted) or der_fits(raw) or raw.startswith(b"openssh-key-v1\0") or "PGP" in label


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """What decodes to a secret's structure; no span inside another."""
    found: list[tuple[str, int, int]] = []
    free = lambda a, b: all(b <= x or y <= a for _, x, y in found)
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            if pem_fits(m[1], m[2]):
                found.append(("pem", *m.span()))
    found += [("ssh", *m.span()) for m in _SSH.finditer(text) if ((raw := unbase64(m[1])) and ssh_fits(raw))] if "ssh-" in text or "ecdsa-" in text else []
    found += [("jwt", *m.span()) for m in _JWT.finditer(text) if jwt_fits(m[1], m[2])] if "eyJ" in text else []
    for m in _B64.finditer(text):
        if m[0][0] == "M" and (raw := unbase64(m[0])) and der_fits(raw) and free(*m.span()):  # a SEQUENCE's first byte, 0x30, is M... in base64
            found.append(("der", *m.span()))
    for m in _ANYHEX.finditer(text):
        if m[0].startswith("30") and der_fits(bytes.fromhex(m[0])) and free(*m.span()):
            found.append(("der", *m.span()))
    return found


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, confirmed spans), each ordered by start and then by kind as listed."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base_spans(text), key=order), sorted(confirmed_spans(text), key=order)


def scan(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, as in `SCHEMA`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for part in frugal(batches):
            rows = []
            for cell in part.column(1):
                base, more = scan_text(cell.as_py() or "")
                every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS[:3]), hashlib.sha256(join(base).encode()).hexdigest(), join(every), len(more)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return documents.select(documents[id_col].cast("long"), documents[text]).mapInArrow(task, SCHEMA)
