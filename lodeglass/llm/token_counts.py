"""Token counts that follow edits without encoding the whole text again.

A text is cut where its tokenizer cuts in any case: before a single space between two other characters, and, in passages without such spaces, on both sides of a single line end
and where letters, digits and other characters meet. The pieces lie in the leaves of a segment
tree with the characters and tokens of every subtree. An edit touches the leaves that it overlaps, and those beside them as far as their border
is no such place any more (the boundary context); only their text is encoded again, and the sums above them are updated. Counts equal those
of encoding the whole text.

Edits are rows (id, seq, start, length, replacement): applied by seq (ties by start, length and text), with offsets in code points of the text as it then is,
cut to its length. Null starts and lengths count as 0, null replacements as empty; edits of unknown documents have no effect. Null texts are empty.
Edits meet their documents by id, so a hot document's edits go to one task, which applies them one by one in logarithmic time each; texts with no edits
do not move. Repeated rows get a row each, with the same edits. Very long texts are one tree each; a run of letters alone, however long, is one piece, since its
tokens may depend on all of it. Empty tables give empty results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.arrow import frugal

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF_CHARS, LONG_PIECE, CACHE = 512, 64, 200_000
SCHEMA = "doc_id long, n_chars long, n_tokens long, n_edits long, chars_after long, tokens_after long, chars_encoded long"


class Counter:
    """Tokens of texts, through a bounded cache of pieces."""

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def __call__(self, text: str) -> int:
        """By pieces. Safe where a space stands alone between other characters, and at a line end alone between such."""
        total, known = 0, self.known
        if len(known) > CACHE:
            known.clear()
        for piece in pieces(text):
            n = known.get(piece)
            if n is None:
                n = self.whole(piece)
                if len(piece) < 64:
                    known[piece] = n
            total += n
        return total


def pieces(text: str) -> list[str]:
    """`text`, cut before every space that stands alone between other characters, and long parts without such spaces at other borders."""
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if p and out[-1] and not p[0].isspace() and not out[-1][-1].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    if max(map(len, out)) <= LONG_PIECE:
        return out
    return [x for p in out for x in (_parts(p) if len(p) > LONG_PIECE else (p,))]


def _parts(piece: str) -> list[str]:
    cuts = [i for i in range(1, len(piece)) if _meets(piece[max(0, i - 2) : i], piece[i : i + 2])]
    return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])]


@lru_cache(100_000)
def _kind(char: str) -> str:
    """L, N or another letter for others; empty for characters that this Unicode table does not know."""
    kind = unicodedata.category(char)
    return "" if kind == "Cn" else kind[0] if kind[0] in "LN" else "o"


def _meets(left: str, right: str) -> bool:
    """Whether the tokenizer cuts at a line end or a change of kind between two texts, of which the ends are enough."""
    a, b = left[-1], right[0]
    if a.isspace():
        return a == "\n" and len(left) > 1 and not left[-2].isspace() and not b.isspace()
    if b.isspace():
        return b == "\n" and len(right) > 1 and not right[1].isspace()
    x, y = _kind(a), _kind(b)
    return x != y and x != "" and y != "" and a != "'"  # letters after an apostrophe may belong to it


def is_border(left: str, right: str) -> bool:
    """Whether the tokenizer cuts between the two whatever else they hold."""
    if not left or not right:
        return False
    return len(right) > 1 and right[0] == " " and not right[1].isspace() and not left[-1].isspace() or _meets(left[-2:], right[:2])


class TokenTree:
    """The segment tree of one text."""

    def __init__(self, text: str, count: Counter):
        self.count, self.encoded = count, 0
        self._build(text)

    def _build(self, text: str) -> None:
        self.leaves, run, size = [], [], 0
        for p in pieces(text):
            run.append(p)
            size += len(p)
            if size >= LEAF_CHARS:
                self.leaves.append("".join(run))
                run, size = [], 0
        self.leaves.append("".join(run))
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.leaves += [""] * (self.size - len(self.leaves))
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = len(leaf), self.count(leaf)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)
        self.largest = max(map(len, self.leaves))

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = self.size + leaf
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i >>= 1
            self._sum(i)

    def _find(self, offset: int) -> tuple[int, int]:
        """(leaf that holds the character at `offset`, its offset there); at the end the last place of the last leaf with text."""
        i = 1
        while i < self.size:
            i *= 2
            if offset >= self.chars[i] and self.chars[i + 1]:
                offset -= self.chars[i]
                i += 1
        return i - self.size, offset

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf with text on one side."""
        i = leaf + self.size
        while i > 1:
            right = i & 1
            if right == (step < 0) and self.chars[i ^ 1]:
                i ^= 1
                while i < self.size:
                    i = 2 * i + (step < 0) if self.chars[2 * i + (step < 0)] else 2 * i + (step > 0)
                return i - self.size
            i >>= 1
        return None

    def edit(self, start: int, length: int, text: str) -> None:
        """Puts `text` in the place of text[start:start + length]."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        length = min(max(length, 0), total - start)
        first, at = self._find(start)
        last, end = self._find(start + length)
        if first == last:
            now = self.leaves[first][:at] + text + self.leaves[first][end:]
        else:
            now = self.leaves[first][:at] + text + self.leaves[last][end:]
        span = [first] if first == last else [first, *self._between(first, last), last]
        while (left := self._beside(span[0], -1)) is not None and not is_border(self.leaves[left], now):
            span.insert(0, left)
            now = self.leaves[left] + now
        while (right := self._beside(span[-1], 1)) is not None and not is_border(now, self.leaves[right]):
            span.append(right)
            now += self.leaves[right]
        for leaf in span[1:]:
            self._put(leaf, "", 0)
        self._put(span[0], now, self.count(now))
        self.encoded += len(now)
        if len(now) > max(64 * LEAF_CHARS, 2 * self.largest):  # grown out of shape
            self._build("".join(self.leaves))

    def _between(self, first: int, last: int) -> Iterator[int]:
        at = self._beside(first, 1)
        while at is not None and at < last:
            yield at
            at = self._beside(at, 1)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)


_counters: dict[str | None, Counter] = {}


def counter(path: str | None = None) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count(documents: DataFrame, edits: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document, as in `SCHEMA`: counts before and after its edits, and how many characters the edits made it encode."""
    listed = edits.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce("replacement", F.lit("")).alias("replacement")))).alias("_edits"))
    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    rows = own.join(listed, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "_text", "_edits")
    return count_edited(rows, vocabulary)


def count_edited(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The same from rows (doc_id, text, list of edits in order) that already lie together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for part in frugal(batches):
            out = []
            for doc, body, changes in zip(part.column(0), part.column(1), part.column(2)):
                tree = TokenTree(body.as_py() or "", own)
                before = tree.chars[1], tree.n_tokens
                todo = changes.as_py() or []
                for e in todo:
                    tree.edit(e["start"], e["length"], e["replacement"])
                out.append((doc.as_py(), *before, len(todo), tree.chars[1], tree.n_tokens, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(task, SCHEMA)


def proposed_edits(text: str) -> Column:
    """Three edits of any text, as a column: the third part's word gets a suffix, a passage in the middle goes, a sentence is put before the end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    edit = lambda seq, start, length, new: F.struct(F.lit(seq).cast("long").alias("seq"), start.cast("long").alias("start"), length.cast("long").alias("length"), F.lit(new).alias("replacement"))
    return F.array(edit(1, F.floor(n / 3), F.lit(0), "ing"), edit(2, F.floor(n / 2), F.least(F.lit(40).cast("long"), F.floor(n / 10)), ""), edit(3, F.greatest(n - 20, F.lit(0).cast("long")), F.lit(5), " It was added later. "))
