import corpus_pipeline
import pytest
from lodeglass.llm import decontaminate, omh_dedup, pii, quality_rules
from lodeglass.llm.queries import ORACLE_SQL, QUERIES
from lodeglass.storage import materialize
from tests.llm.conftest import prose
from tests.llm.test_pii_dedup_decontam import brute_classes, brute_hits, plain_spans
from tests.llm.test_rules_and_packing import check_packing, plain_measures


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    bench = [(i, prose(900 + i, 30)) for i in range(3)]
    docs = [(i, prose(i, 80), "en", f"s{i % 3}", 0) for i in range(60)]
    docs += [(100, docs[0][1], "en", "s", 0), (101, docs[1][1] + " more", "en", "s", 0), (102, "short", "en", "s", 0), (103, bench[0][1] + " " + prose(7, 40), "en", "s", 0), (104, prose(104, 70) + " mail joe@site.org or +1 (555) 010-9999", "en", "s", 0), (105, "same same same " * 40, "en", "s", 0), (106, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, bench


def test_stages_match_brute_force(spark, tables):
    folder, docs, bench = tables
    now, frame = docs, spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]

    def step(name):
        nonlocal frame
        out = materialize(stages[name](spark, frame, folder), "test")
        assert name == "packing" or out.columns == frame.columns
        frame = out
        return out

    keep = []
    for d in now:
        n, *_, repeats, _ = plain_measures(d[1])
        if n >= 50 and 100 * repeats <= 50 * n:
            keep.append((d[0], d[1]))
    assert rows(step("quality")) == sorted(keep)
    classes = brute_classes(keep)
    keep = [d for d in keep if classes[d[0]] == d[0]]
    assert rows(step("near_duplicates")) == sorted(keep) and not {100, 101} & {d for d, _ in keep}
    items = [(str(i), decontaminate.words_of(t.encode())) for i, t in bench]
    keep = [d for d in keep if not (n := brute_hits(w := decontaminate.words_of(d[1].encode()), items)[0]) or 20 * n < len(w)]
    assert rows(step("decontamination")) == sorted(keep) and 103 not in {d for d, _ in keep}
    clean = []
    for d, t in keep:
        for kind, a, b in sorted(plain_spans(t), key=lambda s: -s[1]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        clean.append((d, t))
    got = rows(step("personal_data"))
    assert got == sorted(clean) and "[EMAIL] or [PHONE]" in dict(got)[104]
    check_packing(got, step("packing").collect())
    whole = {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, folder).collect()}
    assert {d for d, _, _ in whole} == {d for d, _ in clean}


def test_odd_rows_from_end_to_end(spark, odd, tmp_path):
    """Nulls, repeated rows and ids, very long texts, columns whose names operators use inside; then a table without rows."""
    for name, rows in (("some", odd), ("none", odd.limit(0))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, prose(900, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in out} == ({1, 5, None} if name == "some" else set())
        for doc in {r.doc_id for r in out}:
            pieces = sorted((r.start, r.length) for r in out if r.doc_id == doc)
            assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and {r.doc_tokens for r in out if r.doc_id == doc} == {sum(n for _, n in pieces)}


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"} and set(ORACLE_SQL) <= set(QUERIES)
    assert all(m.__doc__ for m in (quality_rules, omh_dedup, decontaminate, pii))
