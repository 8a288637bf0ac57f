"""Near-duplicates by order MinHash.

A document's five-word shingles are labelled with their occurrence number, so that repeats count. Each of many hash functions
samples the `MINIMA` smallest labelled shingles and keeps them in text order: two documents agree in a sample with a probability
that falls with edits and with changed order. `TUPLES` samples make a band key, `BANDS` keys a sketch; documents that share a key
are candidates. Banded alignment of their words verifies them: shingles that occur once in both texts are anchors, the longest chain of anchors that
ascends in both and stays within the band is kept, and the words between two anchors are aligned exactly. A pair is linked if the words aligned are
at least `SIMILARITY` of all (aligned / (both - aligned)), as with one word in nine replaced. Words compare by 32-bit hashes, which a text of 10,000 words confuses with a probability of 1 in 40.

With one word in 20 replaced, two texts share 63 % of their shingles and are candidates with a probability of 0.997; with one in 12, 0.93; with one in 9,
0.7. Further copies of the same text link them all the same.

Equal texts (after lower-casing A-Z and joining words by one space) are one node from the start, found by a hash of 128 bits and combined
per task before anything moves. Buckets are worked off in rounds. In each, one member of a bucket, the pivot, is aligned with the others that are
not in its class yet; the links found join classes, and a bucket whose members are all of one class is done. So a large group of near copies costs
a number of alignments in proportion to its texts. Buckets that are still of several classes after the rounds are finished exactly: pairs of small
ones are aligned one by one, large ones are cut into blocks by length, and pairs of blocks whose lengths permit a link are counted and aligned without
making rows of their pairs. So classes are those of all candidate pairs: no bucket is capped and no pair that could join two classes is skipped.

Null texts and texts without words are classes of their own. Texts of fewer than five words are one shingle. Very long texts are sketched whole and aligned in
strips, in memory that follows from one text. Repeated rows get a row each; class ids are the least document id of the class. Empty tables give empty results. Extra
columns are ignored, whatever their names (`keep_one` keeps them).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.graph.components import connected_components
from lodeglass.llm.arrow import frugal
from lodeglass.storage import discard, materialize

WORDS, SIMILARITY, MINIMA, TUPLES, BANDS = 5, 0.8, 2, 2, 36
SHARE = SIMILARITY / (1 + SIMILARITY)  # of both texts' words together, that must be aligned
ROUNDS, SMALL = 3, 64
BLOCK_WEIGHT, TEXT_WEIGHT = 512_000, 250  # a block's words; what a text counts besides its words
FIRST_BANDS = 4  # of the first round, in which most classes form
SALT = 16  # parts of a class that has grown
CACHE_WORDS, HELD_WORDS, STRIP = 100_000, 1_000_000, 4096
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # mixing constants of SplitMix64
_SEEDS = np.random.default_rng(20240229).integers(1, 2**32, TUPLES * BANDS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, through a bounded cache."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.words
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingled(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's shingles, in order, from those of its words."""
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = _mix(out * np.uint64(31) + h[k : k + n])
    return out


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, its occurrence number in the text)."""
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))).astype(np.uint64)
    return _mix(shingles + nth * np.uint64(0x9E3779B97F4A7C15))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The sketch: one key per band, of `TUPLES` ordered samples each."""
    base, n = labelled(shingles), len(shingles)
    short = (base >> np.uint64(32)).astype(np.uint32)
    samples = np.empty(TUPLES * BANDS, np.uint64)
    step = max(1, (1 << 18) // n)
    for f in range(0, len(samples), step):
        values = (short[None, :] ^ _SEEDS[f : f + step, None]) * np.uint32(0x85EBCA6B)
        values ^= values >> np.uint32(15)
        values *= np.uint32(0xC2B2AE35)
        rows = np.arange(len(values))
        picks = np.empty((len(values), min(MINIMA, n)), np.int64)
        for k in range(picks.shape[1]):
            picks[:, k] = values.argmin(1)
            values[rows, picks[:, k]] = np.uint32(0xFFFFFFFF)
        picks.sort(axis=1)  # text order
        tuple_hash = np.full(len(values), 7, np.uint64)
        for k in range(picks.shape[1]):
            tuple_hash = _mix(tuple_hash * np.uint64(31) + base[picks[:, k]])
        samples[f : f + step] = tuple_hash
    keys = np.arange(BANDS, dtype=np.uint64)
    for t in range(TUPLES):
        keys = _mix(keys * np.uint64(31) + samples[t * BANDS : (t + 1) * BANDS])
    return keys.view(np.int64)


class Sequence:
    """A text's words by 32-bit hashes, with the shingles that occur once: ascending, and their places."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        own = shingled(words.astype(np.uint64))
        order = np.argsort(own, kind="stable")
        s = own[order]
        new = np.append(True, s[1:] != s[:-1])
        once = new & np.append(new[1:], True)
        self.sorted, self.places = s[once], order[once]


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def longest_common(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, bit-parallel over strips of the longer list, with a carry for each element of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    carry, total = bytearray(len(b)), 0
    for start in range(0, len(a), STRIP):
        part = a[start : start + STRIP]
        full, places = (1 << len(part)) - 1, {}
        for k, w in enumerate(part):
            places[w] = places.get(w, 0) | 1 << k
        left = full
        for i, w in enumerate(b):
            hits = places.get(w, 0)
            if hits or carry[i]:
                here = left & hits
                moved = left + here + carry[i]
                left = (moved & full) | (left ^ here)
                carry[i] = moved > full
        total += len(part) - left.bit_count()
    return total


def _chain(j: np.ndarray) -> np.ndarray:
    """Indexes of a longest ascending subsequence of `j`."""
    if (np.diff(j) > 0).all():
        return np.arange(len(j))
    tops: list[int] = []  # the least last place of an ascending chain of each length
    last: list[int] = []
    before = np.full(len(j), -1)
    for at, place in enumerate(j.tolist()):
        k = bisect.bisect_left(tops, place)
        if k == len(tops):
            tops.append(place)
            last.append(at)
        else:
            tops[k], last[k] = place, at
        before[at] = last[k - 1] if k else -1
    out, at = [], last[-1]
    while at >= 0:
        out.append(at)
        at = before[at]
    return np.array(out[::-1])


def linked(x: Sequence, y: Sequence) -> bool:
    """Whether the words aligned are `SIMILARITY` of all words of the two texts.

    Texts that far alike differ by at most `most` insertions and deletions, so anchors off the diagonal by more are no part of their alignment.
    """
    need = int(np.ceil(SHARE * (x.n + y.n) - 1e-9))
    if min(x.n, y.n) < need:
        return False
    most = x.n + y.n - 2 * need
    at = np.minimum(np.searchsorted(y.sorted, x.sorted), max(len(y.sorted) - 1, 0))
    same = y.sorted[at] == x.sorted if len(y.sorted) else np.zeros(len(x.sorted), bool)
    i, j = x.places[same], y.places[at[same]]
    band = np.abs(i - j) <= most
    order = np.argsort(i[band])
    i, j = i[band][order], j[band][order]
    if len(i):
        kept = _chain(j)
        i, j = i[kept], j[kept]
    from_i, to_i = np.append(0, i + 1), np.append(i, x.n)
    from_j, to_j = np.append(0, j + 1), np.append(j, y.n)
    room = np.minimum(to_i - from_i, to_j - from_j)
    best = len(i) + int(room.sum())  # as many words as could be aligned
    for g in np.flatnonzero(room > 0).tolist():
        if best < need:
            return False
        a, b = x.words[from_i[g] : to_i[g]], y.words[from_j[g] : to_j[g]]
        if room[g] > 64 and best - room[g] + common_words(a, b) < need:
            return False
        best -= int(room[g]) - longest_common(a.tolist(), b.tolist())
    return best >= need


def sketches(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, node binary: hash of the normalised text, null without words; bands array<long>)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cache = Hasher(), {}
        for part in frugal(batches):
            nodes, bands = [], []
            for cell in part.column(1).cast(pa.binary()):
                words = (cell.as_py() or b"").lower().split()
                node = xxhash.xxh3_128_digest(b" ".join(words)) if words else None
                if node and node not in cache:
                    if len(cache) > 2000:
                        cache.clear()
                    cache[node] = band_keys(shingled(hasher(words)))
                nodes.append(node)
                bands.append(cache[node] if node else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    return documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text]).mapInArrow(task, "doc_id long, node binary, bands array<long>")


def _aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b, and any other columns) whose texts are linked."""
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("_wa")), "a").join(texts.select(F.col("node").alias("b"), F.col("words").alias("_wb")), "b").select(*pairs.columns, "_wa", "_wb")
    at = {c: i for i, c in enumerate(rows.columns)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = {}, 0

        def sequence(node, cell):
            nonlocal held
            if node not in known:
                if held > HELD_WORDS:
                    known.clear()
                    held = 0
                known[node] = Sequence(np.frombuffer(cell.as_py(), np.uint32))
                held += known[node].n
            return known[node]

        for part in frugal(batches):
            keep = [linked(sequence(x.as_py(), wx), sequence(y.as_py(), wy)) for x, y, wx, wy in zip(*(part.column(at[c]) for c in ("a", "b", "_wa", "_wb")))]
            yield pa.RecordBatch.from_arrays(part.columns[:-2], names=pairs_columns).filter(pa.array(keep, pa.bool_()))

    pairs_columns = list(pairs.columns)
    return rows.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema))


def link(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketched: one row per document with its node; reps: node, rep; links: a, b between nodes of different texts)."""
    sketched = materialize(sketches(documents, id_col, text), "sketches")
    reps = materialize(sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "reps")
    exploded = reps.select("node", F.posexplode("bands").alias("place", "band"))
    sizes = exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(exploded.join(sizes, "band").select("band", F.col("place").cast("byte").alias("place"), "node"), "members")

    wanted = members.select("node").distinct().join(reps.select("node", "rep"), "node")
    own = documents.select(documents[id_col].cast("long").alias("rep"), documents[text].alias("body"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for part in frugal(batches):
            nodes, words = [], []
            for node, cell in zip(part.column(0), part.column(1).cast(pa.binary())):
                found, node = (cell.as_py() or b"").lower().split(), node.as_py()
                if xxhash.xxh3_128_digest(b" ".join(found)) == node:
                    nodes.append(node)
                    words.append(hasher(found).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(words, pa.binary()), pa.array([len(w) // 4 for w in words], pa.int32())], names=["node", "words", "n"])

    # A document id may come twice with the same text, which then is the same row.
    texts = own.join(wanted, "rep").select("node", "body").mapInArrow(named, "node binary, words binary, n int")
    texts = materialize(texts.groupBy("node").agg(F.min("words").alias("words"), F.min("n").alias("n")), "texts")

    links = None
    now = members.withColumn("class", F.col("node"))
    for i in range(ROUNDS):
        some = F.col("place") < FIRST_BANDS if i == 0 else F.lit(True)
        mixed = now.where(some).groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(i), "node"), "class", "node")).alias("pivot"), F.min("class").alias("low"), F.max("class").alias("high")).where("low != high")
        pairs = now.join(mixed.select("band", "pivot"), "band").where(F.col("class") != F.col("pivot.class")).select(F.col("node").alias("a"), F.col("pivot.node").alias("b"), F.col("class").alias("own"), F.col("pivot.class").alias("other")).distinct()
        more = materialize(_aligned(pairs, texts), "links")
        links = more if links is None else links.union(more)
        last, now = members if i == 0 else now, materialize(_joined_classes(now, more, 1 if i == 0 else SALT), "members")
        discard(last)
    links = links.select("a", "b")
    mixed = now.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("size")).where("low != high")
    rest = materialize(now.join(mixed, "band").select("band", "node", "class", "size"), "members")
    few = rest.where(F.col("size") <= SMALL)
    pairs = few.alias("x").join(few.alias("y"), "band").where("x.node < y.node and x.class != y.class").select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    links = links.union(_aligned(pairs, texts)).union(_joined_blocks(rest.where(F.col("size") > SMALL), texts))
    return sketched, reps, materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def _joined_classes(now: DataFrame, links: DataFrame, salt: int) -> DataFrame:
    """`now` (band, place, node, class) after one step along `links` (own, other: classes that a pivot joins): each takes the least class around its pivot.

    Classes are names of nodes that links lead to, so equal ones are joined; that some joined ones are not equal yet only costs alignments. The components of all links
    are found once, at the end. A class may hold most rows, so it is dealt in `salt` parts.
    """
    around = links.groupBy("other").agg(F.min("own").alias("least")).select("other", F.least("other", "least").alias("new"))
    moves = links.select("own", "other").distinct().join(around, "other").select(F.col("own").alias("old"), "new").union(around.select("other", "new"))
    moves = moves.groupBy("old").agg(F.min("new").alias("new")).where("new < old").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    same = (F.col("class") == F.col("old")) & (F.pmod(F.xxhash64("node", "band"), F.lit(salt)) == F.col("part"))
    return now.join(moves, same, "left").select("band", "place", "node", F.coalesce("new", "class").alias("class"))


def _joined_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join classes within large buckets. `members`: band, node, class, size.

    A bucket is cut by length into blocks of at most `BLOCK_WEIGHT` words and one text. Pairs of blocks whose lengths are near enough are groups of bounded size. There the
    numbers of common words of all pairs are one product of matrices; only pairs of different classes that have enough in common are aligned, and only links that
    join two classes become rows.
    """
    order = Window.partitionBy("band").orderBy("n", "node")
    before = F.sum(F.col("n").cast("long") + TEXT_WEIGHT).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = members.join(texts.select("node", "n"), "node").withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_WEIGHT)).select("band", "node", "class", "n", "block")
    cut = materialize(cut, "blocks")
    blocks = cut.groupBy("band", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = (blocks.select("band", *[F.col(c).alias(c + k) for c in ("block", "low", "high")]) for k in "xy")
    near = x.join(y, "band").where((F.col("blockx") <= F.col("blocky")) & (F.col("lowy") * SIMILARITY <= F.col("highx") + 1e-6)).select("band", F.col("blockx").alias("i"), F.col("blocky").alias("j"))
    asked = near.select("band", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    keyed = asked.join(cut, ["band", "block"]).select("band", "i", "j", "block", "node", "class")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        words, seqs = [np.frombuffer(w, np.uint32) for w in pdf["words"]], {}
        nodes, block, classes = pdf["node"].tolist(), pdf["block"].to_numpy(), pdf["class"].tolist()
        root = {c: c for c in classes}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        low, high = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        n = np.array(list(map(len, words)))
        owner = np.repeat(np.arange(len(words)), n)
        _, column, count = np.unique(np.concatenate([labelled(w.astype(np.uint64)) for w in words]), return_inverse=True, return_counts=True)
        keep = count[column] > 1
        owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int((count > 1).sum()), 2048):
            a, b = np.searchsorted(column, (start, start + 2048))
            part = np.zeros((len(words), 2048), np.float32)
            part[owner[a:b], column[a:b] - start] = 1
            common += part[left] @ part[right].T
        enough = common >= SHARE * (n[left][:, None] + n[right][None, :]) - 1e-3
        out = []

        def sequence(k):
            if k not in seqs:
                seqs[k] = Sequence(words[k])
            return seqs[k]

        for x, y in zip(*np.nonzero(enough)):
            x, y = left[x], right[y]
            a, b = find(classes[x]), find(classes[y])
            if a != b and linked(sequence(x), sequence(y)):
                root[a] = b
                out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    return keyed.join(texts.select("node", "words"), "node").groupBy("band", "i", "j").applyInPandas(check, "a binary, b binary")


def classes(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id of the class), n_links (of its text to different texts, as far as they were needed to form classes)."""
    sketched, reps, links = link(documents, id_col, text)
    of = connected_components(links)
    least = of.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = of.join(least, "component").join(ends, "node").select("node", "class_id", "n_links")
    named = reps.select("node", "rep").join(nodes, "node", "left").select(F.col("node").alias("_node"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = sketched.select("doc_id", "node").join(named, F.col("node") == F.col("_node"), "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`documents` with all their columns, of each class the document of the least id (and all with a null id). Of rows that repeat that
    id, one with the class's least text hash stays."""
    found = classes(documents, id_col, text)
    gone = found.where("doc_id != class_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = documents.join(gone, documents[id_col] == gone["_gone"], "left_anti")
    twice = found.where("doc_id = class_id").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1")
    twice = materialize(twice, "twice")
    if twice.isEmpty():
        return left
    several = left.join(twice, left[id_col] == twice["_twice"], "left_semi")
    return left.join(twice, left[id_col] == twice["_twice"], "left_anti").unionByName(several.dropDuplicates([id_col]))
