import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from lodeglass.llm import decontaminate, omh_dedup, pii
from tests.llm.conftest import prose


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def card_number(r):
    body = "".join(r.choice("0123456789") for _ in range(15))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_match_plain_patterns(spark, odd):
    r = random.Random(9)
    bits = ["joe", "@", ".", "a.com", "1.2.3.4", "300.1.1.1", "010.0.0.255", "+1 (555) 010-9999", "+49", " ", "-", "4", "44", "%", "é", "\n", "x@y.z%w@q.r", "12345678"]
    texts = ["".join(r.choice([*bits, card_number(r)]) for _ in range(25)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    out = pii.detect(df).collect()
    assert len(out) == df.count()
    want = {d: plain_spans(t or "") for d, t in df.collect()}
    for row in out:
        if row.doc_id is None or row.doc_id < 100:
            continue
        spans = want[row.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[row.doc_id - 100]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert set(joined.split(",")) - {""} <= set(row.spans.split(","))


def test_estimation_finds_reliable_labelers(spark):
    r, counts = random.Random(2), Counter()
    truth = Counter()
    accuracy = (0.95, 0.9, 0.85, 0.5, 0.8, 0.9)
    for _ in range(6000):
        y = r.random() < 0.4
        votes = tuple((2 if (r.random() < a) == y else 0) if r.random() < 0.9 else 1 for a in accuracy)
        counts[votes] += 1
        truth[votes] += y
    df = spark.createDataFrame([("phone", list(v), n) for v, n in counts.items()], "kind string, votes array<int>, n long")
    right = sum((truth[tuple(w.votes)] if w.q > 0.5 else w.n - truth[tuple(w.votes)]) for w in pii.reliabilities(df).first().w)
    assert right / 6000 > 0.95


def test_added_spans_and_redaction(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        kind = i % 6
        body = ["call me at (%d55) 201-%04d today" % (r.randint(2, 9), r.randint(0, 9999)), "phone: %d55.301.%04d." % (r.randint(2, 9), r.randint(0, 9999)), "mail joe%d@site%d.com" % (i, i), "my ssn is 123-45-%04d" % r.randint(1, 9999), "version 1.2.3.%d" % r.randint(0, 99), "order 555-%03d" % r.randint(0, 999)][kind]
        rows.append((i, f"{prose(i, 12)} {body} {prose(i + 1, 8)}", "en", "s", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {x.doc_id: x for x in pii.detect(df).collect()}
    assert sum(out[i].n_added for i in range(0, 300, 6)) >= 45 and sum(out[i].n_added for i in range(3, 300, 6)) >= 45
    assert sum(out[i].n_added for i in range(5, 300, 6)) == 0
    clean = {x.doc_id: x for x in pii.redact(df).collect()}
    assert "[EMAIL]" in clean[2].text and "@" not in clean[2].text and clean[2].n_chars == len(clean[2].text)
    assert "[PHONE]" in clean[0].text and clean[5].text == rows[5][1]


def test_redaction_of_odd_rows(spark, odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert pii.redact(odd.limit(0)).count() == 0 and pii.detect(odd.limit(0)).count() == 0


def brute_hits(words, items):
    hit, who = set(), set()
    for item, w in items:
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                who.add(item)
    return len(hit), who


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination_matches_brute_force(spark, odd, limit):
    r = random.Random(4)
    texts = [prose(50 + i, r.choice((1, 2, 4, 9, 13, 14, 30))) for i in range(8)] + ["the", "of AND", "é日 x", "...", ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the of"), (70, None)], "item_id long, text string")
    docs = [(i, " ".join(r.choice([prose(i, 5), r.choice(texts), r.choice(texts).upper(), "é日-x"]) for _ in range(r.randint(0, 12)))) for i in range(100, 160)]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(str(i), word(t)) for i, t in enumerate(texts)]
    got = decontaminate.judge(df, bench, limit=limit).collect()
    assert len(got) == df.count()
    want = {}
    for d, t in df.collect():
        w = word(t)
        n, who = brute_hits(w, items)
        want.setdefault(d, set()).add((len(w), n, len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    for x in got:
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) in want[x.doc_id]
    kept = decontaminate.clean_filter(df, bench, limit=limit)
    assert sorted(map(repr, kept.select("doc_id").collect())) == sorted(repr(x) for x in decontaminate.judge(df, bench).where("not contaminated").select("doc_id").collect())


def test_hot_bucket():
    """Windows that differ in one word within cost a look-up, however many they are."""
    items = [(str(i), b"a b c d w%d f g h i j k l m" % i) for i in range(20_000)]
    found = decontaminate.tables(items)
    words = decontaminate.words_of(b"a b c d w7 f g h i j k l m " * 300 + b"a b c d x f g h i j k l m " * 3000)
    start = time.process_time()
    assert decontaminate.search(words, found)[1] == ["7"]
    assert time.process_time() - start < 1


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, prose(1, 120))], "item_id long, text string")
    out = decontaminate.clean_filter(odd, bench)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {2, 3, None, 4, 5, 6, 7, 9, 10}
    assert decontaminate.clean_filter(odd, bench.limit(0)).count() == odd.count() and decontaminate.judge(odd.limit(0), bench).count() == 0


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_classes(docs):
    """By the longest common subsequence of the words of all pairs."""
    words = {d: (t or "").encode().lower().split() for d, t in docs}
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(words)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = words[a], words[b]
            both = len(x) + len(y)
            if not x or not y or find(a) == find(b) or 9 * sum((Counter(x) & Counter(y)).values()) < 4 * both:
                continue
            if 9 * common_subsequence(x, y) >= 4 * both:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def family(seed, n, edits):
    r = random.Random(seed)
    base = prose(seed, n).split()
    out = []
    for _ in range(edits):
        w = list(base)
        for _ in range(r.randint(0, max(1, n // 60))):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 999)}"
        out.append(" ".join(w))
    return out


def test_classes_match_brute_force(spark):
    docs = [t for s in range(12) for t in family(s, 100 + 20 * s, 6)] + [prose(s + 500, 90) for s in range(40)]
    docs += [docs[0], docs[0].upper(), docs[0].replace(" ", "  "), "one two", "one two", "one three", " ".join(reversed(docs[5].split()))]
    rows = list(enumerate(docs, 10))
    got = {r.doc_id: r.class_id for r in omh_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_classes(rows)


def test_large_bucket_in_blocks(spark, monkeypatch):
    """Classes do not depend on how buckets are worked off."""
    docs = [t for s in (1, 2) for t in family(s, 150, 60)] + [" ".join(family(1, 150, 1)[0].split()[:75] + family(s, 150, 1)[0].split()[75:]) for s in (3, 4)]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(omh_dedup, "ROUNDS", 1)
    monkeypatch.setattr(omh_dedup, "SMALL", 2)
    monkeypatch.setattr(omh_dedup, "BLOCK_WEIGHT", 3_200)
    got = {r.doc_id: r.class_id for r in omh_dedup.classes(df).collect()}
    assert got == brute_classes(rows)


def test_dedup_of_odd_rows(spark, odd):
    out = omh_dedup.classes(odd)
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in out.collect()) == [(0, 0), (1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 1), (9, 9), (10, 10)]
    kept = omh_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(x) for x in (1, 2, 3, 4, 5, 6, 7, 9, 10, None))
    assert omh_dedup.classes(odd.limit(0)).count() == 0 and omh_dedup.keep_one(odd.limit(0)).count() == 0


def test_sketches_agree_with_probability_of_similarity():
    r, s = random.Random(1), lambda words: omh_dedup.shingled(omh_dedup.Hasher()(words))
    base = prose(7, 400).split()
    same = []
    for _ in range(30):
        w = list(base)
        w[r.randrange(400)] = "zz"
        a, b = (omh_dedup.band_keys(s([x.encode() for x in t])) for t in (base, w))
        same.append((a == b).mean())
    assert np.mean(same) > 0.8
    swapped = base[200:] + base[:200]
    a, b = (omh_dedup.band_keys(s([x.encode() for x in t])) for t in (base, swapped))
    assert (a == b).mean() < 0.5  # equal sets of shingles, another order


def test_longest_common_in_strips(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(omh_dedup, "STRIP", 7)
    for _ in range(300):
        a, b = ([r.randrange(r.choice((2, 6, 40))) for _ in range(r.randrange(40))] for _ in range(2))
        assert omh_dedup.longest_common(a, b) == common_subsequence(a, b)


def test_alignment_of_words_is_the_longest_common_subsequence():
    """The verdict on a pair is that of the exact distance, for edits of every density."""
    r, hasher, wrong, n = random.Random(11), omh_dedup.Hasher(), 0, 0
    for k in range(200):
        a = prose(k, r.choice((7, 40, 200))).encode().lower().split()
        b = list(a)
        for _ in range(r.randrange(1 + len(a) // 3)):
            at = r.randrange(len(b))
            b[at : at + r.choice((0, 1, 1))] = [r.choice(a)] if r.random() < 0.7 else []
        if not b:
            continue
        x, y = (omh_dedup.Sequence(hasher(w).astype(np.uint32)) for w in (a, b))
        want = 9 * common_subsequence(a, b) >= 4 * (len(a) + len(b))
        wrong, n = wrong + (omh_dedup.linked(x, y) != want), n + 1
    assert wrong <= 0.01 * n


def test_near_copies_are_caught(spark):
    """Recall against brute force, with one word in 10 to 40 replaced: at least 0.9 of the copies are in their original's class, and nothing else is."""
    r, docs = random.Random(6), []
    for k in range(150):
        words = prose(1000 + k, r.randint(60, 300)).split()
        edited = [w if r.random() > 1 / r.choice((12, 15, 20, 40)) else f"other{r.randrange(999)}" for w in words]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    got = {x.doc_id: x.class_id for x in omh_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(150))
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) >= 0.9 * 150
