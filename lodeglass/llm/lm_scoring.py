"""Scores of texts under an n-gram model of the whole corpus, held in Elias-Fano tries by shards.

The model is interpolated Dirichlet smoothing over add-one unigrams, orders 1 to 3: an n-gram's probability is (c + m * p) / (C + m) with its count c, its context's
count C, the probability p one order below and the order's weight m. Every word, bigram and trigram of the training texts is in it, however rare and however large
the corpus, so the model grows with the corpus.

No machine holds the model. A block of documents sends its distinct words, bigrams and trigrams with their training counts to shards, as packed paths: a shard has all that
begins with a word, so a bigram is a 32-bit name below its first word, and a trigram a 24-bit one below its bigram. A shard sums the counts and builds its part of the model as a trie: ascending
names below their contexts, Elias-Fano coded, with monotone pointers from contexts to their successors, and 16-bit codes of the smoothed parts c / (C + m).
It looks all paths up, each name by a search among its context's successors, and answers each block with the codes. A block, read a second time, adds up its answers. A block and a shard
exchange a row if they share an n-gram, so there are never more rows than n-grams in blocks. Blocks are named by their contents; documents whose rows come in another
order when they are read again would miss their answers, which raises an error: write such documents first.

What begins with a very common word could make one shard hot. Words with at least `HOT_SHARE` of all training tokens are at most 1 / HOT_SHARE; bigrams that begin with one go to
shards by their own hash, with the trigrams below them, and trigrams that begin with two of them by their own hash as well. The counts of these words are known to every task.

Null and empty texts are their end token alone. A null id counts as the empty text. Repeated rows are learned and scored each. With no training tokens
every count is 0. An empty table gives an empty result. Very long texts are one document of one block. Extra columns are ignored, whatever their names. Words are told apart by 64-bit hashes, in
a block and for their counts' totals, and by 48 bits within a shard, successors of a word by 32 bits, those of a bigram by 24: one of 10,000 successors is taken for another with a probability of 6e-4. Codes are within 0.03 % of the probabilities; base scores are exact.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodeglass.llm.arrow import frugal
from lodeglass.llm.elias_fano import EliasFano

HOT_SHARE, WEIGHTS = 2e-3, (None, 100.0, 5.0)  # the weights of the order below, by order
FOLDS, HELD_OUT, END = 7, 2, b"\n"
BLOCK_TOKENS, BLOCK_BYTES, SHARD_TOKENS, LEAST_SHARDS = 2_000_000, 32_000_000, 2_000_000, 256
_SPACE_BYTES = [b" ", b"\t", b"\n", b"\v", b"\f", b"\r"]
_SPACES = np.isin(np.arange(256), [x[0] for x in _SPACE_BYTES])
_ASKED = 12_000  # names at once
_STEP = 5e-4  # of the codes, in natural logarithms
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (not negative) in ascending order and the number of each: `np.unique` with its inverse.

    Plain numbers are sorted several times faster than places, so a key's upper bits and its place are sorted as one number; keys that differ only below are put in order after that.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    n = len(keys)
    bits = np.uint64((n - 1).bit_length())
    drop = np.uint64(max(0, int(keys.max()).bit_length() + int(bits) - 64))
    both = np.sort(((keys.astype(np.uint64) >> drop) << bits) | np.arange(n, dtype=np.uint64))
    at = (both & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    ascending = keys[at]
    new = np.append(True, ascending[1:] != ascending[:-1])
    if drop:
        upper = both >> bits
        run = np.append(True, upper[1:] != upper[:-1])
        if (new & ~run).any():  # runs with the same upper bits and several keys
            number = np.cumsum(run) - 1
            mixed = np.flatnonzero(np.bincount(number, new & ~run)[number] > 0)
            at[mixed] = at[mixed][np.argsort(ascending[mixed], kind="stable")]
            ascending = keys[at]
            new = np.append(True, ascending[1:] != ascending[:-1])
    back = np.empty(n, np.int64)
    back[at] = np.cumsum(new) - 1
    return ascending[new], back


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of `sizes` bytes that begin at `starts`: eight bytes at a time, of all words together; of words over 32 bytes by xxhash."""
    lanes = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    out = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rest = np.flatnonzero(sizes <= 32)
    for k in range(4):
        left = np.minimum(sizes[rest] - 8 * k, 8).astype(np.uint64)
        lane = lanes[starts[rest] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[rest] = _mixed((out[rest] ^ lane) * np.uint64(0x9FB21C651E98DF25))
        rest = rest[sizes[rest] > 8 * (k + 1)]
    for i in np.flatnonzero(sizes > 32).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


class Block:
    """Documents as numbers of their distinct words, given as hashes, each document closed by the end token. Words are cut, hashed and numbered all at once."""

    def __init__(self, docs: list[int | None], texts: list[bytes]):
        self.docs = docs
        data = np.frombuffer(b"".join([x for text in texts for x in (text.lower(), END)]), np.uint8)
        edges = np.flatnonzero(np.diff(_SPACES[data], prepend=True))  # the last byte is an end
        starts, sizes = edges[::2], np.diff(edges)[::2]
        words, numbers = distinct(word_hashes(data, starts, sizes))
        self.words = np.append(words, np.uint64(xxhash.xxh3_64_intdigest(END)))
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))
        self.lengths = np.diff(cuts, prepend=0) + 1
        self.ids = np.full(len(starts) + len(docs), len(words), np.int32)
        inner = np.ones(len(self.ids), bool)
        inner[np.cumsum(self.lengths) - 1] = False
        self.ids[inner] = numbers


def blocks(batches: Iterator[pa.RecordBatch], train_only: bool) -> Iterator[Block]:
    docs, texts, tokens, size = [], [], 0, 0
    for part in frugal(batches):
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
            if train_only and held_out(doc):
                continue
            docs.append(doc)
            texts.append(text.as_py() or b"")
            tokens += 2 + sum(map(texts[-1].count, _SPACE_BYTES))  # at most: white space may be in runs
            size += len(texts[-1])
            if tokens >= BLOCK_TOKENS or size >= BLOCK_BYTES:
                yield Block(docs, texts)
                docs, texts, tokens, size = [], [], 0, 0
    if docs:
        yield Block(docs, texts)


def _columns(rows: DataFrame, fn, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names=names)

    return rows.mapInArrow(task, schema)


def count_words(rows: DataFrame) -> DataFrame:
    """(h, c): hash and count of every distinct training token."""

    def fn(batches):
        for block in blocks(batches, True):
            yield block.words.view(np.int64), np.bincount(block.ids, minlength=len(block.words)).astype(np.int64)

    return _columns(rows, fn, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def gram_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams from those of their contexts and last words."""
    return _mixed(context * np.uint64(0x9E3779B97F4A7C15) + word)


def _by_shard(shards: np.ndarray, n_shards: int) -> np.ndarray:
    """The order by shard, then place; of 16-bit numbers it is several times faster."""
    return np.argsort(shards.astype(np.uint16) if n_shards <= 1 << 16 else shards, kind="stable")


def _contains(ascending: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x if len(ascending) else np.zeros(len(x), bool)


class Grams:
    """The distinct words, bigrams and trigrams of a block, numbered in the order of their contexts' numbers, and where they go.

    `at`: by order, the number of the n-gram that ends at each token (-1 where the document begins later). `first`, `pair`: the first word of each bigram, the first bigram of
    each trigram. `names`: 32 bits of the last word. Bigrams and trigrams are dealt in the order of (shard, number); `loose` are trigrams that begin with two hot words.
    """

    def __init__(self, words: np.ndarray, ids: np.ndarray, lengths: np.ndarray, hot: np.ndarray, n_shards: int):
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids, base = ids.astype(np.int64), len(words)
        self.words, self.at, self.n_shards = words, [ids], n_shards
        is_hot, shards = _contains(hot, words), np.uint64(n_shards)
        keys = []
        for n in (1, 2):
            ok = np.flatnonzero(place >= n)
            key, back = distinct(self.at[-1][ok - 1] * base + ids[ok])
            at = np.full(len(ids), -1)
            at[ok] = back
            self.at.append(at)
            keys.append(key)
        self.first, second = keys[0] // base, keys[0] % base
        self.pair, last = keys[1] // base, keys[1] % base
        pairs = gram_hash(words[self.first], words[second])
        whole = gram_hash(pairs[self.pair], words[last])
        self.heads = np.ascontiguousarray((words >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
        short = (words >> np.uint64(32)).astype(np.uint32)
        both = is_hot[self.first] & is_hot[second]
        own = (np.where(is_hot[self.first], pairs, words[self.first]) % shards).astype(np.int64)
        #: Bigrams by shard, then number, and the same of trigrams below them and of loose ones.
        self.entries = _by_shard(own, n_shards)
        self.entry_cuts = np.searchsorted(own[self.entries], np.arange(n_shards + 1))
        below, loose = np.flatnonzero(~both[self.pair]), np.flatnonzero(both[self.pair])
        order = _by_shard(own[self.pair[below]], n_shards)
        self.leaves = below[order]
        self.leaf_cuts = np.searchsorted(own[self.pair[self.leaves]], np.arange(n_shards + 1))
        there = (whole[loose] % shards).astype(np.int64)
        order = _by_shard(there, n_shards)
        self.loose, self.loose_cuts = loose[order], np.searchsorted(there[order], np.arange(n_shards + 1))
        self.loose_keys, self.entry_names = whole[self.loose], short[second[self.entries]]
        self.leaf_names = np.ascontiguousarray(short[last[self.leaves]].view(np.uint8).reshape(-1, 4)[:, 1:])
        #: Runs of bigrams with the same first word within a shard.
        word, shard = self.first[self.entries], own[self.entries]
        begin = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (shard[1:] != shard[:-1]))) if len(word) else np.zeros(0, np.int64)
        self.roots, self.root_sizes = word[begin], np.diff(np.append(begin, len(word)))
        self.root_cuts = np.searchsorted(shard[begin], np.arange(n_shards + 1))
        self.entry_sizes = np.bincount(self.pair[below], minlength=len(keys[0]))[self.entries]

    def requests(self, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """For each shard: 48 bits of first words, names of their successors and of theirs, whole hashes of loose trigrams; run sizes and training counts."""
        counts = [np.bincount(at[(at >= 0) & train], minlength=n) for at, n in zip(self.at, (len(self.words), len(self.first), len(self.pair)))]
        plain = [self.heads[self.roots], self.entry_names, self.leaf_names, self.loose_keys]
        small = [counts[0][self.roots], self.root_sizes, counts[1][self.entries], self.entry_sizes, counts[2][self.leaves], counts[2][self.loose]]
        small = [x.astype(np.uint32) for x in small]
        cuts = [self.root_cuts, self.entry_cuts, self.leaf_cuts, self.loose_cuts]
        for shard in range(self.n_shards):
            part = [slice(c[shard], c[shard + 1]) for c in cuts]
            head = np.array([p.stop - p.start for p in part], np.int64)
            if head.any():
                r, e, f, o = part
                tail = zlib.compress(b"".join(x[p].tobytes() for x, p in zip(small, (r, r, e, e, f, o))), 1)
                yield shard, b"".join([head.tobytes(), *(x[p].tobytes() for x, p in zip(plain, part)), tail])


def _arrays(payload: bytes, kinds: tuple, sizes: tuple, at: int = 0) -> tuple[list[np.ndarray], int]:
    out = []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(payload, kind, size, at))
        at += out[-1].nbytes
    return out, at


def _wide(packed: np.ndarray, size: int) -> np.ndarray:
    """Numbers of `size` little-endian bytes each."""
    out = np.zeros((len(packed) // size, 8), np.uint8)
    out[:, :size] = packed.reshape(-1, size)
    return out.view(np.uint64).ravel()


def _open(payload: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(first words, names, names below them, loose hashes), (counts and run sizes of first words, of names, counts of names below and loose ones)."""
    r, e, f, o = np.frombuffer(payload, np.int64, 4).tolist()
    (heads, names, leaves, loose), at = _arrays(payload, (np.uint8, np.uint32, np.uint8, np.uint64), (6 * r, e, 3 * f, o), 32)
    plain = [_wide(heads, 6), names, _wide(leaves, 3), loose]
    small, _ = _arrays(zlib.decompress(payload[at:]), (np.uint32,) * 6, (r, r, e, e, f, o))
    return plain, small


def to_codes(p: np.ndarray) -> np.ndarray:
    """16-bit codes of numbers from 0 to 1: 0 for 0, else one more than the steps of their logarithm."""
    out = np.zeros(len(p), np.uint16)
    some = p > 0
    out[some] = np.minimum(1 + np.rint(-np.log(p[some]) / _STEP), 65535).astype(np.uint16)
    return out


def of_codes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp(-_STEP * (codes.astype(float) - 1)), 0.0)


class Level:
    """The successors of contexts: their names in ascending order, context after context, as one Elias-Fano sequence; monotone pointers to where each context's begin; codes."""

    def __init__(self, keys: np.ndarray, n_contexts: int, codes: np.ndarray):
        """`keys`: ascending and distinct, the context's number in the upper 32 bits, the name in the lower."""
        self.names = EliasFano(*EliasFano.build(keys, max(n_contexts, 1) << 32))
        begins = np.searchsorted(keys, np.arange(n_contexts + 1, dtype=np.uint64) << np.uint64(32))
        self.pointers = EliasFano(*EliasFano.build(begins, len(keys) + 1))
        self.codes = codes

    def find(self, context: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The places of names among the successors of their contexts, -1 for those that are none."""
        out = np.empty(len(context), np.int64)
        for k in range(0, len(context), _ASKED):  # little enough to stay in a processor's cache
            some = context[k : k + _ASKED]
            key = (some.astype(np.uint64) << np.uint64(32)) | name[k : k + _ASKED]
            at = self.names.successor(key)
            last = self.pointers.access(some + 1).astype(np.int64)
            found = at < last
            found[found] = self.names.access(at[found]) == key[found]
            out[k : k + _ASKED] = np.where(found, at, -1)
        return out


def _answers(payloads: list[bytes], hot: np.ndarray, hot_counts: np.ndarray) -> list[bytes]:
    """What a shard answers to each block, in the order of its request: counts of first words, codes of bigrams and trigrams, counts of loose ones."""
    asked = [_open(p) for p in payloads]
    join = lambda k, j: np.concatenate([a[k][j] for a in asked])
    words, root = distinct(join(0, 0))
    c1 = np.bincount(root, join(1, 0), len(words))
    hot = hot >> np.uint64(16)
    is_hot = _contains(hot, words)
    c1[is_hot] = hot_counts[np.searchsorted(hot, words[is_hot])]
    above, name = np.repeat(root, join(1, 1)), join(0, 1).astype(np.uint64)
    keys2, pair = distinct((above.astype(np.uint64) << np.uint64(32)) | name)
    c2 = np.bincount(pair, join(1, 2), len(keys2))
    above3, name3 = np.repeat(pair, join(1, 3)), join(0, 2).astype(np.uint64)
    keys3, leaf = distinct((above3.astype(np.uint64) << np.uint64(32)) | name3)
    c3 = np.bincount(leaf, join(1, 4), len(keys3))
    parent2, parent3 = (keys2 >> np.uint64(32)).astype(np.int64), (keys3 >> np.uint64(32)).astype(np.int64)
    low = np.uint64(0xFFFFFFFF)
    second = Level(keys2, len(words), to_codes(c2 / (c1[parent2] + WEIGHTS[1])))
    third = Level(keys3, len(keys2), to_codes(c3 / (c2[parent3] + WEIGHTS[2])))
    at2 = second.find(parent2, keys2 & low)[pair]
    at3 = third.find(parent3, keys3 & low)[leaf]
    whole, loose = distinct(join(0, 3))
    found = [c1.astype(np.uint32)[root], second.codes[at2], third.codes[at3], np.bincount(loose, join(1, 5), len(whole)).astype(np.uint32)[loose]]
    cuts = [np.cumsum([0, *(len(a[0][k]) for a in asked)]) for k in range(4)]
    return [zlib.compress(b"".join(x[c[k] : c[k + 1]].tobytes() for x, c in zip(found, cuts)), 1) for k in range(len(asked))]


def _pack(docs: list, lengths: np.ndarray, words: np.ndarray, ids: np.ndarray) -> bytes:
    """A block. Frequent words have small numbers, so that most bytes of the numbers are 0."""
    planes = ids.view(np.uint8).reshape(-1, 4).T.copy()
    return zlib.compress(pickle.dumps((docs, lengths.tolist(), words.tobytes(), planes.tobytes()), 5), 1)


def _unpack(own: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    docs, lengths, words, planes = pickle.loads(zlib.decompress(own))
    ids = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return docs, np.array(lengths), np.frombuffer(words, np.uint64), ids


def _combine(own: bytes, answers: dict[int, bytes], hot: np.ndarray, hot_counts: np.ndarray, n_tokens: int, n_words: int, n_shards: int) -> pd.DataFrame:
    """The rows of a block's documents."""
    docs, lengths, words, ids = _unpack(own)
    grams = Grams(words, ids, lengths, hot, n_shards)
    count = np.zeros(len(words), np.int64)
    share2, share3 = np.zeros(len(grams.first)), np.zeros(len(grams.pair))
    asked = [np.diff(c) > 0 for c in (grams.root_cuts, grams.entry_cuts, grams.leaf_cuts, grams.loose_cuts)]
    if set(np.flatnonzero(asked[0] | asked[3]).tolist()) != set(answers):
        raise RuntimeError("the documents came in another order when they were read again: write them to a table first")
    for shard, answer in answers.items():
        r, e, f, o = (slice(c[shard], c[shard + 1]) for c in (grams.root_cuts, grams.entry_cuts, grams.leaf_cuts, grams.loose_cuts))
        (c1, codes2, codes3, c3), _ = _arrays(zlib.decompress(answer), (np.uint32, np.uint16, np.uint16, np.uint32), [p.stop - p.start for p in (r, e, f, o)])
        count[grams.roots[r]] = c1
        share2[grams.entries[e]], share3[grams.leaves[f]], share3[grams.loose[o]] = of_codes(codes2), of_codes(codes3), c3
    common = np.flatnonzero(_contains(hot, words))
    count[common] = hot_counts[np.searchsorted(hot, words[common])]
    back2 = WEIGHTS[1] / (count + WEIGHTS[1])
    pairs = share2 * (count[grams.first] + WEIGHTS[1])  # counts of bigrams; those under 1,000 come out whole
    pairs = np.where(pairs < 1000, np.rint(pairs), pairs)
    back3 = WEIGHTS[2] / (pairs + WEIGHTS[2])
    share3[grams.loose] /= pairs[grams.pair[grams.loose]] + WEIGHTS[2]
    p1 = ((count + 1) / (n_tokens + n_words + 1))[grams.at[0]]
    p = p1.copy()
    ok = np.flatnonzero(grams.at[1] >= 0)
    p[ok] = share2[grams.at[1][ok]] + back2[grams.at[0][ok - 1]] * p[ok]
    ok = np.flatnonzero(grams.at[2] >= 0)
    p[ok] = share3[grams.at[2][ok]] + back3[grams.at[1][ok - 1]] * p[ok]
    of, k = np.repeat(np.arange(len(docs)), lengths), len(docs)
    return pd.DataFrame({
        "doc_id": pd.array(docs, "Int64"), "held_out": [held_out(d) for d in docs], "n_tokens": lengths.astype(np.int64), "n_known": np.bincount(of, count[grams.at[0]] > 0, k).astype(np.int64),
        "train_tokens": np.full(k, n_tokens, np.int64), "base_score": np.bincount(of, np.log10(p1), k), "score": np.bincount(of, np.log10(p), k),
    })


def score(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, as in `_RESULT`; the model is learned from the documents that are not held out."""
    rows = documents.select(documents[id_col].cast("long"), documents[text])
    seen, end = Observation(), xxhash.xxh3_64_intdigest(END)
    signed = int(np.array([end], np.uint64).view(np.int64)[0])
    counted = count_words(rows).observe(seen, F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("words"), F.coalesce(F.sum(F.when(F.col("h") == signed, F.col("c"))), F.lit(0)).alias("ends"))
    most = counted.orderBy(F.desc("c"), "h").limit(int(1 / HOT_SHARE)).toArrow()
    n_tokens, n_words = seen.get["tokens"], seen.get["words"]
    known = {int(h): int(c) for h, c in zip(most.column(0).to_numpy().view(np.uint64), most.column(1).to_numpy()) if c >= HOT_SHARE * n_tokens}
    known[end] = seen.get["ends"]  # begins nothing, so that no shard is asked for it
    hot = np.array(sorted(known), np.uint64)
    n_shards = max(LEAST_SHARDS, n_tokens // SHARD_TOKENS)
    shared = rows.sparkSession.sparkContext.broadcast((hot, np.array([known[h] for h in hot.tolist()], np.int64)))

    def named(batches):
        for block in blocks(batches, False):
            ids, words, lengths = block.ids, block.words, block.lengths
            order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            ids, words = rank[ids], words[order]
            yield xxhash.xxh3_64_intdigest(ids.tobytes() + words.tobytes() + repr(block.docs).encode()) >> 1, block.docs, lengths, words, ids

    def ask(batches):
        for uid, docs, lengths, words, ids in named(batches):
            train = np.repeat([not held_out(d) for d in docs], lengths)
            parts = list(Grams(words, ids, lengths, shared.value[0], n_shards).requests(train))
            yield pa.array([uid] * len(parts), pa.int64()), pa.array([s for s, _ in parts], pa.int32()), pa.array([False] * len(parts), pa.bool_()), pa.array([p for _, p in parts], pa.binary())

    def pass_on(batches):
        for uid, *own in named(batches):
            yield pa.array([uid], pa.int64()), pa.array([None], pa.int32()), pa.array([True]), pa.array([_pack(*own)], pa.binary())

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["payload"] = pd.Series(_answers(pdf["payload"].tolist(), *shared.value), pdf.index, object)
        return pdf

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf[~pdf["own"]]
        answers = {int(s): p for s, p in zip(rest["shard"], rest["payload"])}  # blocks of equal contents, as of a table united with itself, have equal ones
        return pd.concat([_combine(own, answers, *shared.value, n_tokens, n_words, n_shards) for own in pdf["payload"][pdf["own"]]])

    schema = "block long, shard int, own boolean, payload binary"
    answers = _columns(rows, ask, schema).groupBy("shard").applyInPandas(answer, schema)
    return answers.union(_columns(rows, pass_on, schema)).groupBy("block").applyInPandas(combine, _RESULT)
