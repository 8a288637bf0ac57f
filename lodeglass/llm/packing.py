"""Packing documents into training sequences of at most `SEQUENCE` tokens.

Best-fit decreasing: a document's full windows become sequences at once; its tail goes, longest first, into the open window
with the least room that still holds it. A segment tree over remaining capacities finds that window. What a block leaves in
windows under `WELL_FILLED` is joined and cut into full windows, and the last rest into windows whose lengths are powers of two, which
need no padding. So a block pads at most 1 - WELL_FILLED of its tokens, however few documents it has.

Every task packs its own documents, in blocks of `BLOCK` tokens of tails (16 MB of ids), so memory does not depend on the
input and no row moves. Sequence ids hold the partition's number in the upper bits: a task that is run again gives the same rows.

Null and empty texts are one piece, the end token alone. Repeated rows are packed each; a null id is kept. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodeglass.llm.arrow import frugal

SEQUENCE, END_ID, WELL_FILLED, BLOCK = 2048, 1, 0.99, 4_000_000
VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CACHE_WORDS, _MERGED_BYTES, _MERGED_WORDS, _PART_BYTES = 500_000, 64, 4096, 4_000_000
_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)
_NONE, _FREE = np.int32(2**31 - 1), np.uint32(0xFFFEFFFE)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By the two bytes of a character under U+0240 in UTF-8 (by the one of an ASCII character): its kind, and the bytes of its lower case.

    Odd are those whose lower case is not one such character of as many bytes, white space beyond ASCII, and the apostrophe, which may begin a suffix.
    """
    kinds, lower = np.full(1 << 16, _ODD, np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for c in range(0x240):
        x, raw = chr(c), chr(c).encode()
        to = x.lower().encode()
        at = int.from_bytes(raw, "big")
        if x in "\t\n\v\f\r ":
            kinds[at] = _SPACE
        elif x not in "'\x85\xa0" and len(to) == len(raw) and x.lower() < "\u0240":
            kinds[at], lower[at] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(x)[0], _OTHER), int.from_bytes(to, "big")
    return kinds, lower


class Merges:
    """Byte-pair merges of many words at once: in every round each word merges its first pair of least rank.

    `pairs`: ids (left, right, merged), in the order of their ranks; under 2^16 - 2. They lie in a hash table with linear probing.
    """

    BITS = 18

    def __init__(self, pairs: np.ndarray):
        self.merged = pairs[:, 2].astype(np.int32)
        keys = (pairs[:, 0].astype(np.uint32) << np.uint32(16)) | pairs[:, 1].astype(np.uint32)
        self.keys, self.ranks = np.full(1 << self.BITS, _FREE, np.uint32), np.zeros(1 << self.BITS, np.int32)
        rest, slots = np.arange(len(keys)), self._slots(keys)
        while len(rest):
            free = rest[self.keys[slots[rest]] == _FREE]
            self.keys[slots[free]], self.ranks[slots[free]] = keys[free], free
            rest = rest[self.keys[slots[rest]] != keys[rest]]
            slots[rest] = (slots[rest] + 1) & ((1 << self.BITS) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)).astype(np.intp)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`_NONE` where the two do not merge."""
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], _NONE)
        rest = np.flatnonzero((there != keys) & (there != _FREE))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & ((1 << self.BITS) - 1)
            there = self.keys[slots[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.ranks[slots[rest[same]]]
            rest = rest[~same & (there != _FREE)]
        return out

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and their numbers by word. `symbols`: a column for each word, from the top; any ids below its length (1 to `_MERGED_BYTES`)."""
        width, n = symbols.shape
        rows, every = np.arange(width, dtype=np.int32), np.arange(n)
        ids = np.empty((width + 1, n), np.int32)  # the last row stands for what is before and after a word
        ids[:width] = np.where(rows[:, None] < lengths, symbols, 0xFFFF)
        ids[width] = 0xFFFF
        ids = ids.ravel()
        after, before = np.repeat(np.append(rows + 1, width), n), np.repeat(np.append(rows - 1, width), n)
        before[:n] = width
        after[(lengths - 1) * n + every] = width
        ranks = self.rank(ids[: n * width], ids[n : n * (width + 1)])
        best = np.full((width + 1) * n, _NONE)  # rank and row
        some = np.flatnonzero(ranks != _NONE)
        best[some] = ranks[some] << 6 | (some // n).astype(np.int32)
        table = best.reshape(width + 1, n)
        while True:
            least = table.min(axis=0)
            word = np.flatnonzero(least != _NONE)
            if not len(word):
                break
            least = least[word]
            row = least & 63
            at = row * n + word
            second = after[at] * n + word
            third = after[second]
            new, first = self.merged[least >> 6], before[at]
            ids[at], ids[second], best[second], after[at] = new, 0xFFFF, _NONE, third
            before[third * n + word] = row
            first_at = first * n + word
            ranks = self.rank(np.concatenate([ids[first_at], new]), np.concatenate([new, ids[third * n + word]]))
            found = ranks != _NONE
            keys = np.where(found, ranks << 6 | np.concatenate([first, row]), _NONE)
            best[first_at], best[at] = keys[: len(word)], keys[len(word) :]
        out = ids.reshape(width + 1, n)[:width].T
        left = out != 0xFFFF
        return out[left].astype("<u4"), left.sum(1)


class WordEncoder:
    """Ids of whole texts, as bytes of little-endian 32-bit numbers.

    The tokenizer's pre-tokens are runs of letters, runs of other characters and single numbers, and never cross white space. Words of Latin letters, numbers and ASCII marks
    but the apostrophe are cut and lower-cased as bytes, and the distinct pre-tokens of many texts are merged together. Other words go through the tokenizer and a bounded cache, and texts that may hold the name of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), {}
        model = json.loads(self.tokenizer.to_str())["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.merges = Merges(np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {}  # by byte, the character that stands for it
        for x in map(chr, [*range(0x80), *range(0x80, 0x800, 0x40), *range(0x80, 0xC0)]):
            shown.update(zip(x.encode(), level.pre_tokenize_str(x)[0][0]))
        self.symbols, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for b, x in shown.items():
            self.symbols[b], self.last[b] = vocabulary[x], vocabulary[x + end]
        self.kinds, self.lower = _kinds()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _through_cache(self, words: list[str]) -> list[bytes]:
        if len(self.words) > _CACHE_WORDS:
            self.words.clear()
        new = list(set(words).difference(self.words))
        self.words.update(zip(new, self._encode(new)))
        return [self.words[w] for w in words]

    def _cut(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pre-tokens and odd words in order, lower-cased but in odd words; where each begins among them and in `data`. Rows begin at `begins`."""
        n = len(data)
        lead = (data >= 0xC2) & (data < 0xC9)
        pairs = data.astype(np.uint16)
        two = np.flatnonzero(lead[:-1])
        pairs[two] = pairs[two] << np.uint16(8) | data[two + 1]
        kind, low = self.kinds[pairs], self.lower[pairs]
        lower = low.astype(np.uint8)
        lower[two], lower[two + 1] = low[two] >> np.uint16(8), low[two] & np.uint16(255)
        kind[two + 1] = kind[two]
        start = np.empty(n, bool)  # of a run of one kind, and of each number
        start[:1] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        start[two + 1] = False
        start[begins[begins < n]] = True
        keep = kind != _SPACE
        if (kind == _ODD).any():
            edge = np.empty(n, bool)  # of words
            edge[:1] = True
            edge[1:] = keep[1:] != keep[:-1]
            edge[begins[begins < n]] = True
            edges = np.flatnonzero(edge)
            odd = np.repeat(np.logical_or.reduceat(kind == _ODD, edges), np.diff(np.append(edges, n)))
            start = np.where(odd, edge, start)
            lower = np.where(odd, data, lower)
        start &= keep
        at = np.flatnonzero(start)
        kept = np.cumsum(keep)
        return lower[keep], kept[at] - 1, at

    def _merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of plain pre-tokens, where each one's begin and how many they are."""
        order, ids, n_ids = np.argsort(lengths, kind="stable"), [], []
        for k in range(0, len(order), _MERGED_WORDS):
            word = order[k : k + _MERGED_WORDS]
            size, start = lengths[word], starts[word]
            there = data[np.minimum(start + np.arange(size[-1])[:, None], len(data) - 1)]
            symbols = self.symbols[there]
            every = np.arange(len(word))
            symbols[size - 1, every] = self.last[there[size - 1, every]]
            for x, to in zip(self.merges.encode(symbols, size), (ids, n_ids)):
                to.append(x)
        if not ids:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes, begin, number = np.concatenate(n_ids), np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        begin[order], number[order] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate(ids), begin, number

    def _distinct(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any distinct pre-tokens and odd words."""
        lengths = np.diff(np.append(starts, len(data)))
        strange = (data >= 0xC9) | (data == ord("'"))
        lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xC9))
        strange[lead] = self.kinds[data[lead].astype(np.uint16) << np.uint16(8) | data[lead + 1]] == _ODD
        by_tokenizer = np.logical_or.reduceat(strange, starts) | (lengths > _MERGED_BYTES)
        plain, other = np.flatnonzero(~by_tokenizer), np.flatnonzero(by_tokenizer)
        ids, begin, number = self._merge(data, starts[plain], lengths[plain])
        begins, numbers = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        begins[plain], numbers[plain] = begin, number
        raw = data.tobytes()
        more = self._through_cache([raw[a : a + b].decode() for a, b in zip(starts[other].tolist(), lengths[other].tolist())])
        numbers[other] = [len(x) // 4 for x in more]
        begins[other] = len(ids) + np.cumsum(numbers[other]) - numbers[other]
        return np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")]), begins, numbers

    def _part(self, data: np.ndarray, begins: np.ndarray) -> list[bytes]:
        """Ids of rows that begin at `begins` in `data` and hold no name of a special token."""
        if not len(data):
            return [b""] * len(begins)
        kept, starts, at = self._cut(data, begins)
        if not len(starts):
            return [b""] * len(begins)
        offsets = np.append(starts, len(kept)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        buffers = units.dictionary.buffers()
        distinct = np.frombuffer(buffers[1], np.int32, len(units.dictionary) + 1)
        ids, begin, number = self._distinct(np.frombuffer(buffers[2], np.uint8, distinct[-1]), distinct[:-1].astype(np.int64))
        which = units.indices.to_numpy()
        numbers = number[which]
        ends = np.cumsum(numbers)
        flat = ids[np.repeat(begin[which] - (ends - numbers), numbers) + np.arange(ends[-1])].tobytes()
        cuts = (4 * np.append(0, ends)[np.append(np.searchsorted(at, begins), len(at))]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each text. Texts are worked off some megabytes at a time; longer ones are cut at white space."""
        rows, part, held = [], [], 0

        def work():
            nonlocal held
            sizes = np.array([len(x) for _, x in part], np.int64)
            for (row, _), ids in zip(part, self._part(np.frombuffer(b"".join([x for _, x in part]), np.uint8), np.cumsum(sizes) - sizes)):
                row.append(ids)
            part.clear()
            held = 0

        for text in texts:
            rows.append(row := [])
            if b"<|" in text:
                row += self._encode([text.decode()])
                held += len(text)
                text = b""
            at = 0
            while at < len(text):
                to = len(text)
                if to - at > _PART_BYTES:  # the first space or line end from there
                    to = min((x for x in (text.find(b" ", at + _PART_BYTES), text.find(b"\n", at + _PART_BYTES)) if x >= 0), default=to)
                part.append((row, text[at:to]))
                held, at = held + to - at, to
                if held >= _PART_BYTES and at < len(text):
                    work()
            if held >= _PART_BYTES:
                work()
                yield from map(b"".join, rows)
                rows.clear()
        work()
        yield from map(b"".join, rows)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text.encode()]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """One for each worker and vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Capacities:
    """Open windows by remaining capacity; `tightest(need)` takes one with the least capacity of at least `need`, or None."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to where a right neighbour holds a window
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        window = self.windows[capacity].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, window


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Windows of indexes into `lengths` (each from 1 to `room`), best-fit decreasing; ties in the order given."""
    tree, windows = Capacities(room), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.tightest(lengths[i])
        if found is None:
            windows.append([i])
            left = room - lengths[i]
            at = len(windows) - 1
        else:
            windows[found[1]].append(i)
            left, at = found[0] - lengths[i], found[1]
        if left:
            tree.add(left, at)
    return windows


def pack_block(tails: list[tuple], room: int = SEQUENCE) -> Iterator[list[tuple]]:
    """Sequences of pieces (key, start, ids) from tails of the same form; each id of the input lies in one piece."""
    rest = []
    for window in best_fit([len(t[2]) // 4 for t in tails], room):
        pieces = [tails[i] for i in window]
        if sum(len(p[2]) for p in pieces) // 4 >= WELL_FILLED * room:
            yield pieces
        else:
            rest += pieces
    total = sum(len(p[2]) for p in rest) // 4
    sizes = [room] * (total // room) + [1 << b for b in range(room.bit_length(), -1, -1) if total % room >> b & 1]
    at = iter(rest)
    key, start, ids = next(at, (None, 0, b""))
    for size in sizes:
        out, need = [], size
        while need:
            if not ids:
                key, start, ids = next(at)
            take = min(need, len(ids) // 4)
            out.append((key, start, ids[: 4 * take]))
            start, ids, need = start + take, ids[4 * take :], need - take
        yield out


def pack(documents: DataFrame, id_col: str = "doc_id", text: str = "text", room: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece, as in `SCHEMA`. `vocabulary`: path of the tokenizer's file, on every executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = encoder(vocabulary), TaskContext.get().partitionId() << 33
        end, tails, held, rows = np.asarray([END_ID], "<u4").tobytes(), [], 0, []

        def put(pieces):
            nonlocal number
            offset = 0
            for (doc, total), start, ids in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, number, offset))
                offset += len(ids) // 4
            number += 1

        def flush():
            for pieces in pack_block(tails, room):
                put(pieces)
            tails.clear()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return out

        for part in frugal(batches):
            for doc, ids in zip(part.column(0).to_pylist(), coder.encode_all(x.as_py() or b"" for x in part.column(1).cast(pa.binary()))):
                ids += end
                key, full = (doc, len(ids) // 4), len(ids) // (4 * room) * room
                for start in range(0, full, room):
                    put([(key, start, ids[4 * start : 4 * (start + room)])])
                if 4 * full < len(ids):
                    tails.append((key, full, ids[4 * full :]))
                    held += len(ids) // 4 - full
                if held >= BLOCK:
                    flush()
                    held = 0
                if len(rows) >= 20_000:
                    yield batch()
        flush()
        yield batch()

    return documents.select(documents[id_col].cast("long"), documents[text]).mapInArrow(task, SCHEMA)
