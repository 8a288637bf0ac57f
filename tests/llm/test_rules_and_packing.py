import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodeglass.llm import packing, quality_rules
from lodeglass.storage import materialize
from tests.llm.conftest import prose, rows_of


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(cover), len(re.findall("[A-Z]", text or ""))


def test_measures_match_plain_counts(spark, odd):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b c", "a a a a a", "x\n\nx\n \nx y#*$%&|<>", "the cat the cat sat the cat sat", "\x0bq\x0cr\x1cs", "A B C"])], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), more):
        got = rows_of(quality_rules.measures(df, keep=("doc_id",)))
        assert got == sorted([(r.doc_id, *plain_measures(r.text)) for r in df.collect()], key=repr)


def labelled(spark, n=6000):
    r = random.Random(3)
    rows = []
    for i in range(n):
        bad = i % 10 == 0
        text = " ".join(("###" if bad else "") + r.choice(("stone", "river", "light")) + str(r.randint(0, 10**6)) for _ in range(60))
        rows.append((i, text, "en" if i % 3 else "fr", 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")


def plain_kept(rows, labels, alpha=quality_rules.ALPHA, delta=quality_rules.DELTA, min_good=quality_rules.MIN_GOOD):
    """rows: (id, text, stratum); labels: {id: quality}. Verdicts by exact sums over plain counts."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
    measured = {i: dict(zip(names, plain_measures(t))) for i, t, _ in rows}
    stratum = {i: s or "" for i, _, s in rows}
    failed = {i: m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] for i, m in measured.items()}
    values = {rule: {i: eval(value.replace("greatest", "max"), {"max": max}, m) for i, m in measured.items()} for rule, (value, _) in quality_rules.RULES.items()}
    good = [i for i, q in labels.items() if q == 1 and i in measured and not failed[i]]
    sizes = Counter(stratum[i] for i in good)
    key = {i: stratum[i] if sizes[stratum[i]] >= min_good else None for i in measured}
    strata, cut = {key[i] for i in good}, {}
    for s in strata:
        own = [i for i in good if key[i] == s]
        for rule, (_, grid) in quality_rules.RULES.items():
            for level in reversed(range(quality_rules.LEVELS)):
                k = sum(values[rule][i] > grid[level] for i in own)
                p = sum(math.comb(len(own), j) * alpha**j * (1 - alpha) ** (len(own) - j) for j in range(k + 1)) if k < len(own) * alpha else 1
                if p > delta / (len(strata) * len(quality_rules.RULES)):
                    break
                cut[s, rule] = grid[level]
    return {i: not failed[i] and all(values[rule][i] <= cut.get((key[i], rule), math.inf) for rule in values) for i in measured}, cut


def test_verdicts_match_plain_tests(spark):
    """Own cutoffs in two large strata, a pooled one for two small ones and one without labels; rules differ in their cutoffs."""
    r, rows, labels = random.Random(4), [], {}
    for i in range(2600):
        lang = r.choices(("en", "fr", "de", None, "it"), (10, 8, 4, 3, 1))[0]
        bad = r.random() < 0.1
        words = [r.choice(("stone", "River", "light")) + str(r.randint(0, 10**6)) for _ in range(r.choice((40, 60, 60, 60)))]
        if bad:
            words = ["#" * r.randint(1, 3) + w for w in words]
        if lang == "fr" and r.random() < 0.3:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words), lang))
        if lang != "it" and r.random() < 0.8:
            labels[i] = 0 if bad else 1
    want, cut = plain_kept(rows, labels)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    found, cuts = quality_rules.assess(df, marks)
    assert {k: c for k, c in cuts.items() if c is not None} == cut
    assert {s for s, _ in cut} == {"en", "fr", None} and ("en", "capitals") in cut and cut["en", "capitals"] != cut.get(("fr", "capitals"))
    assert {r.doc_id: r.kept for r in found.select("doc_id", "kept").collect()} == want
    assert 0 < sum(not k for i, k in want.items() if len(rows[i][1].split()) == 60) < len(rows)
    assert {r.doc_id for r in quality_rules.reject_filter(df, marks).collect()} == {i for i, k in want.items() if k}


def test_cutoffs_reject_junk_and_few_good(spark):
    df = labelled(spark)
    found, cuts = quality_rules.assess(df.drop("quality", "toxic"), df.select("doc_id", "quality", "toxic"))
    got = {r.doc_id: r.kept for r in found.select("doc_id", "kept").collect()}
    truth = {r.doc_id: r.quality for r in df.select("doc_id", "quality").collect()}
    good = [got[i] for i, q in truth.items() if q == 1]
    assert cuts["en", "symbols"] and 1 - sum(good) / len(good) <= quality_rules.ALPHA
    assert not any(got[i] for i, q in truth.items() if q == 0)
    kept = quality_rules.reject_filter(df, df.select("doc_id", "quality"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in got.items() if k}
    tests = quality_rules.certify(materialize(quality_rules.measures(df, keep=("doc_id", "lang")), "test"), df.select("doc_id", "quality"))
    row = tests.where("stratum = 'en' and rule = 'symbols' and level = 0").first()
    assert (row.n_bad, row.n_caught, row.n_rejected) == (400, 400, 0)


def test_binomial_tail(spark):
    p, n = 0.01, 2000
    rows = [(n, k) for k in (0, 1, 5, 12, 19, 20, 40)]
    df = spark.createDataFrame(rows, "n long, k long").withColumn("p", quality_rules._tail(F.col("n"), F.col("k"), p))
    for r in df.collect():
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(r.k + 1)) if r.k < n * p else 1.0
        assert r.p == pytest.approx(exact, rel=1e-9)
    few = labelled(spark, 150)
    tests = quality_rules.certify(quality_rules.measures(few, keep=("doc_id", "lang")), few.select("doc_id", "quality"))
    assert tests.count() == 30 and tests.where("certified or stratum is not null").count() == 0  # too few labels prove nothing


def test_rules_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out, _ = quality_rules.assess(odd, labels)
    assert out.count() == odd.count()
    assert {r.doc_id for r in quality_rules.reject_filter(odd, labels).collect()} == {1, None, 5, 8}
    none = odd.limit(0)
    assert quality_rules.assess(none, labels.limit(0))[0].count() == 0 and quality_rules.reject_filter(none, labels.limit(0)).columns == odd.columns


def check_packing(docs, pieces):
    e = packing.encoder()
    want = {}
    for i, t in docs:
        ids = np.asarray(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault(i, []).append(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in want[p.doc_id])
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == list(np.cumsum([0] + [p.length for p in s[:-1]])) and sum(p.length for p in s) <= 2048
    covered = Counter()
    for p in pieces:
        covered[p.doc_id] += p.length
    assert covered == {i: sum(map(len, v)) for i, v in want.items()}
    sizes = [sum(p.length for p in s) for s in sequences.values()]
    waste = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert waste <= 0.01 * sum(sizes)


def test_packing_covers_every_id(spark, odd):
    check_packing([(r.doc_id, r.text) for r in odd.collect()], packing.pack(odd).collect())
    docs = [(i, prose(i, random.Random(i).randint(1, 900))) for i in range(300)]
    check_packing(docs, packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert packing.pack(odd.limit(0)).count() == 0


def test_word_cuts_are_exact():
    e, r = packing.encoder(), random.Random(1)
    letters = list("abCé'’.,!?; \n\t ́İΣ１²½日<|>")
    texts = ["".join(r.choice(letters) for _ in range(150)) for _ in range(300)] + ["", "<|endoftext|> x", "x's y'll 12ab", "ẞ ŉ ǆ", "a" * 3000]
    for t in texts:
        assert e.encode(t) == np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_words_are_merged_together(monkeypatch):
    """Words of Latin letters, numbers and marks don't go through the tokenizer one by one, and give its ids all the same."""
    e, r = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY)), random.Random(2)
    letters = [chr(c) for c in range(0x21, 0x240) if c not in (0x27, 0x85, 0xA0, 0x130) and chr(c).lower() < "\u0240"]
    texts = [" ".join("".join(r.choices(letters, k=r.randint(1, 9))) + r.choice(("", ".", "!?")) for _ in range(60)) + r.choice("\n\t \r") for _ in range(50)]
    texts = [t.replace("<|", "< |") for t in texts] + ["", " ", "é" * 32, "x" * 64, "a1b22c"]
    want = [np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    seen = []
    monkeypatch.setattr(e, "_encode", lambda x: seen.extend(x) or [b""] * len(x))
    assert [e.encode(t) for t in texts] == want and not seen
    assert list(e.encode_all(t.encode() for t in texts)) == want and not seen


def test_texts_are_cut_at_white_space(monkeypatch):
    e, r = packing.encoder(), random.Random(3)
    texts = [" ".join(r.choice(("stone", "it's", "日本", "Ünder", "e\u0301t", "12.5\n")) + str(r.randint(0, 99)) for _ in range(r.randint(0, 80))) for _ in range(60)] + ["<|endoftext|> x", "y" * 500]
    want = [np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for size in (1, 50, 700):
        monkeypatch.setattr(packing, "_PART_BYTES", size)
        assert list(e.encode_all(t.encode() for t in texts)) == want


def test_best_fit_takes_the_tightest_window():
    r = random.Random(5)
    for _ in range(30):
        lengths = [r.randint(1, 40) for _ in range(r.randint(0, 60))]
        windows, rooms = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [(rooms[w], w) for w in range(len(windows)) if rooms[w] >= lengths[i]]
            if fits:
                least = min(fits)[0]
                w = [w for room, w in fits if room == least]
                assert w
                rooms[w[0]] -= lengths[i]
                windows[w[0]].append(i)
            else:
                windows.append([i])
                rooms.append(40 - lengths[i])
        got = packing.best_fit(lengths, 40)
        assert sorted(sum(lengths[i] for i in w) for w in got) == sorted(sum(lengths[i] for i in w) for w in windows)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
