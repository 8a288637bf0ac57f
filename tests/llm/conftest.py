import random

import pytest

WORDS = "the of and in to was is that for with as on by at from river stone house light water field north south morning paper table green window garden letter music winter summer bridge market".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) if r.random() < 0.6 else "".join(r.choice(("ka", "lo", "mi", "ter", "son", "ve", "ru")) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() if i % 11 == 0 else w)
    return " ".join(out) + "."


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and columns whose names operators use inside."""
    rows = [
        (1, prose(1, 120), "en", "a", 5, "x", 1), (1, prose(1, 120), "en", "a", 5, "x", 1), (2, None, None, None, None, None, None), (3, "", "en", "b", 0, "", 0), (None, prose(2, 80), "de", "a", 9, "y", 2),
        (4, " \n\t ", "en", "b", 4, "z", 3), (5, prose(5, 40_000), "en", "a", 1, "q", 4), (6, "x", "en", "a", 1, "q", 4), (7, "same line here now\n" * 60, "fr", "c", 3, "q", 4), (8, prose(1, 120), "en", "a", 5, "x", 1),
        (9, "a" * 30_000, "en", "a", 1, "r", 4), (10, "é 日本 ́ " * 30, "fr", "a", 1, "s", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, n_words int")


def rows_of(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)
