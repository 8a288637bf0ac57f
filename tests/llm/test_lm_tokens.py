import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeglass.llm import lm_scoring, token_counts
from lodeglass.llm.elias_fano import EliasFano
from tests.llm.conftest import prose


def test_elias_fano():
    r = random.Random(1)
    for top, n in ((1, 0), (5, 3), (1000, 400), (2**40, 500), (2**64 - 1, 300), (300, 299)):
        values = sorted(r.randrange(top) for _ in range(n))
        ef = EliasFano(*EliasFano.build(np.array(values, np.uint64), top))
        assert ef.access(np.arange(n)).tolist() == values
        asked = [r.randrange(top) for _ in range(200)] + values
        want = [next((i for i, v in enumerate(values) if v >= x), n) for x in asked]
        assert ef.successor(np.array(asked, np.uint64)).tolist() == want
        assert [i >= 0 for i in ef.find(np.array(asked, np.uint64))] == [x in set(values) for x in asked]


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def plain_scores(docs):
    """The model without trie, shards or codes."""
    train = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 7 != 2]
    c = {k: Counter(g for d in train for g in zip(*[tokens(d[1])[i:] for i in range(k)])) for k in (1, 2, 3)}
    n, v = sum(c[1].values()), len(c[1])

    def p(gram):
        if len(gram) == 1:
            return (c[1][gram] + 1) / (n + v + 1)
        weight = lm_scoring.WEIGHTS[len(gram) - 1]
        return (c[len(gram)][gram] + weight * p(gram[1:])) / (c[len(gram) - 1][gram[:-1]] + weight)

    score = lambda t: sum(math.log10(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t)))
    return {d: (len(t := tokens(x)), sum(c[1][w,] > 0 for w in t), n, sum(math.log10(p((w,))) for w in t), score(t)) for d, x in docs}


def test_scores_match_a_plain_model(spark):
    docs = [(i, prose(i % 90, random.Random(i).randint(1, 120)) if i % 17 else ("" if i % 2 else None)) for i in range(260)]
    want = plain_scores(docs)
    got = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert abs(r.score - score) <= 1.2e-4 * n  # half a step of the codes for each token
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_grows_with_the_corpus(spark):
    """A phrase seen once counts, however many other words the corpus has; words and pairs of words that make up most of it are dealt apart."""
    train, held = ([i for i in range(60) if lm_scoring.held_out(i) == x] for x in (False, True))
    docs = [(train[0], "zig zag zog"), (held[0], "zig zag zog"), (held[1], "zog zag zig"), *((i, "one two three four " * 2_500 + prose(i, 2_000)) for i in train[2:])]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = plain_scores(docs)
    assert got[train[0]].train_tokens > 400_000
    for i, _ in docs:
        assert abs(got[i].score - want[i][4]) <= 1.2e-4 * got[i].n_tokens  # half a step of the codes for each token
    assert got[held[0]].score > got[held[1]].score + 1


def test_distinct_keys():
    r = np.random.default_rng(1)
    for keys in ([], [7], [2**64 - 1, 0, 2**64 - 1], r.integers(0, 40, 900), r.integers(0, 2**64 - 1, 900, np.uint64), r.integers(0, 2**20, 900, np.uint64) << np.uint64(44) | r.integers(0, 3, 900, np.uint64), r.permutation(np.repeat(np.arange(2**63, 2**63 + 9, dtype=np.uint64), 50))):
        keys = np.asarray(keys, np.uint64)
        want, back = np.unique(keys, return_inverse=True)
        got = lm_scoring.distinct(keys)
        assert got[0].tolist() == want.tolist() and got[1].tolist() == back.tolist()


def test_block_cuts_and_numbers_all_words_at_once():
    r = random.Random(6)
    texts = ["".join(r.choice("abAÀé \t\n\v\x00\x1c") for _ in range(r.randint(0, 90))) for _ in range(400)] + ["", " ", *("xY" * n for n in (4, 5, 16, 17, 300))]
    block = lm_scoring.Block(list(range(len(texts))), [t.encode() for t in texts])
    words = [w for t in texts for w in tokens(t)]
    assert block.lengths.tolist() == [len(tokens(t)) for t in texts]
    assert len(set(zip(words, block.ids.tolist()))) == len(set(words)) == len(block.words) == len(set(block.words.tolist()))
    assert {lm_scoring.Block([1], [x]).words[0] for x in (b"ab", b" AB\n", b"ab ab")} == {block.words[block.ids[words.index(b"ab")]]}  # the same in every block
    assert lm_scoring.Block([None], [b""]).ids.tolist() == [0]


def test_levels():
    r = random.Random(4)
    for n_contexts in (1, 7, 300):
        keys = np.array(sorted({r.randrange(n_contexts) << 32 | r.randrange(2**32) for _ in range(500)}), np.uint64)
        level = lm_scoring.Level(keys, n_contexts, None)
        context, name = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
        assert level.find(context, name).tolist() == list(range(len(keys)))
        assert (level.find(context, (name + np.uint64(1)) & np.uint64(0xFFFFFFFF)) == -1).all()


def test_codes():
    p = np.concatenate([[0, 1], np.logspace(-13, 0, 300)])
    got = lm_scoring.of_codes(lm_scoring.to_codes(p))
    assert got[0] == 0 and got[1] == 1 and np.allclose(got, p, rtol=3e-4)


def test_scores_of_odd_rows(spark, odd):
    got, rows = lm_scoring.score(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()]
    assert len(got) == len(rows)
    texts = [("" if i is None else i, t) for i, t in rows]  # a null id counts as the empty text
    train = [tokens(t) for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = {(i, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 5)) for i, t in rows for x in [tokens(t)]}
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got} == want
    assert lm_scoring.score(odd.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(100) if lm_scoring.held_out(i)], "doc_id long, text string")
    r = lm_scoring.score(only).first()  # nothing to learn from
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_tree_counts_equal_whole_counts(monkeypatch):
    c, r = token_counts.counter(), random.Random(8)
    bits = ["word", " ", "  ", "\n", "it's", "don't ", "日本", "123", "...", " a", " ", "\x1c", "é", "x" * 40, "。", "、", "'", "'s", "9", "\n日", "a\nb", "\u0301", "²", "\u3000"]
    for i in range(120):
        monkeypatch.setattr(token_counts, "LONG_PIECE", r.choice((0, 5, 64)))
        monkeypatch.setattr(token_counts, "LEAF_CHARS", r.choice((1, 8, 512)))
        c.known.clear()
        text = "".join(r.choice(bits) for _ in range(r.choice((0, 1, 5, 400, 3000))))
        tree = token_counts.TokenTree(text, c)
        assert tree.n_tokens == c.whole(text) and tree.text() == text
        for _ in range(12):
            a, n, new = r.randint(0, len(text) + 3), r.choice((0, 0, 1, 3, 50, 900)), "".join(r.choice(bits) for _ in range(r.choice((0, 1, 4, 200))))
            tree.edit(a, n, new)
            text = text[:a] + new + text[min(a, len(text)) + n :]
            assert tree.text() == text and tree.n_tokens == c.whole(text) and tree.chars[1] == len(text)


def test_edits_encode_little():
    c = token_counts.counter()
    text = "これは長い文章です。次の文、そして数字12。\n" * 8_000  # no spaces
    tree = token_counts.TokenTree(text, c)
    assert tree.n_tokens == c.whole(text)
    tree.edit(90_000, 3, "新しい")
    assert tree.encoded < 4 * token_counts.LEAF_CHARS and tree.n_tokens == c.whole(text[:90_000] + "新しい" + text[90_003:])
    tree = token_counts.TokenTree(prose(1, 20_000), c)
    tree.edit(50_000, 3, "new")
    assert tree.encoded < 4 * token_counts.LEAF_CHARS


def test_proposed_edits_match_whole_counts(spark, odd):
    """The registered query's own edits, applied one by one to the whole text."""
    c = token_counts.counter()
    rows = odd.selectExpr("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, prose(i, 7 * i)) for i in range(40)], "doc_id long, text string"))
    want = []
    for doc, text in rows.collect():
        text = now = text or ""
        n = len(text)
        for at, size, new in ((n // 3, 0, "ing"), (n // 2, min(40, n // 10), ""), (max(n - 20, 0), 5, " It was added later. ")):
            now = now[: min(at, len(now))] + new + now[min(at, len(now)) + size :]
        want.append((doc, n, c.whole(text), 3, len(now), c.whole(now)))
    got = token_counts.count_edited(rows.select("doc_id", "text", token_counts.proposed_edits("text").alias("_edits"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)


def test_count_with_edit_tables(spark, odd):
    edits = spark.createDataFrame([(1, 1, 0, 5, "Hello"), (1, 2, 3, 0, " x "), (5, 1, None, None, None), (99, 1, 0, 0, "q"), (None, 1, 0, 0, "q")], "doc_id long, seq long, start long, length long, replacement string")
    c = token_counts.counter()
    for r in token_counts.count(odd, edits).collect():
        texts = [x.text or "" for x in odd.collect() if x.doc_id == r.doc_id]
        assert any((len(t), c.whole(t)) == (r.n_chars, r.n_tokens) for t in texts)
        if r.doc_id == 1:
            t = "Hello" + texts[0][5:]
            t = t[:3] + " x " + t[3:]
            assert (r.chars_after, r.tokens_after, r.n_edits) == (len(t), c.whole(t), 2)
    assert token_counts.count(odd, edits).count() == odd.count() and token_counts.count(odd.limit(0), edits).count() == 0
