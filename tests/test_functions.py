import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeglass import format as fmt
from lodeglass.functions import names, paths, signatures
from lodeglass.graph.components import connected_components
from lodeglass.plans import incremental
from lodeglass.plans.store import dense_ids
from lodeglass.sources.config import Config, load_config
from lodeglass.streaming import watch


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    got = column(spark, ["load_config", "loadConfig", "ClassName.method", "HTTPServer", "parse2jsonHTTPServer_x", ""], names.tokens)
    assert [set(x) for x in got] == [{"load", "config"}, {"load", "config"}, {"class", "name", "method"}, {"http", "server"}, {"parse", "2", "json", "http", "server", "x"}, set()]


def test_match_score(spark):
    assert column(spark, ["Foo", "FooBar", "barfoo", "a_foo_b", "xfoox", "x", "a.foox"], lambda c: names.match_score(c, "foo")) == [100, 80, 60, 40, 20, 0, 40]


def test_arity_and_return(spark):
    sigs = ["fn f()", "fn f(a: A, b: Vec<(X, Y)>) -> R {", "function g(a: number): string", "f(a", "x", None, "def f( )", "f(a, g(b, c), [d, e])", "f(x: Fn() -> u8, y: u8)"]
    assert column(spark, sigs, signatures.arity) == [0, 2, 1, None, None, None, 0, 3, 1]
    assert column(spark, sigs[:4], signatures.return_type) == [None, "R", "string", None]


def test_paths(spark):
    assert column(spark, ["a/./b/../c", "../x", "a//b", ""], paths.normalize) == ["a/c", None, "a/b", ""]
    assert column(spark, ["a/b.ts", "runtime.exception", "x.test.py"], paths.strip_source_ext) == ["a/b", "runtime.exception", "x.test"]
    assert column(spark, ["a/b/c"], paths.boundary_suffixes) == [["a/b/c", "b/c", "c"]]
    pairs = spark.createDataFrame([("lib/index.ts", "lib/w.ts"), ("a/x.py", "b/y.py"), ("src/lib.rs", "src/q/mod.rs"), ("src/q.rs", "src/q/r.rs")], "a string, b string")
    assert [r.h for r in pairs.select(paths.is_hierarchy(F.col("a"), F.col("b")).alias("h")).collect()] == [True, False, True, True]


@pytest.mark.parametrize("pattern,yes,no", [("*.ts", ["a/b.ts", "x.ts"], ["a.tsx"]), ("a?c.py", ["z/abc.py"], ["ac.py"]), ("[!x]*.rs", ["a.rs"], ["x.rs"]), ("a+b.(c)", ["a+b.(c)"], ["aab.c"])])
def test_globs(spark, pattern, yes, no):
    assert column(spark, yes + no, lambda c: paths.matches_glob(c, pattern)) == [True] * len(yes) + [False] * len(no)


def test_test_conventions(spark):
    p = ["tests/a.py", "x/test_a.py", "a_test.go", "src/a.spec.ts", "src/a.ts", "contest/a.py", "src/__tests__/a.js"]
    assert column(spark, p, names.is_test_path) == [True, True, True, True, False, False, True]
    own = Config(test_paths=("/checks/",), test_suffixes=())
    assert column(spark, ["checks/a.py", "tests/a.py"], lambda c: names.is_test_path(c, own)) == [True, False]


@settings(max_examples=15, deadline=None)
@given(a=st.lists(st.sampled_from("abcdef"), unique=True), b=st.lists(st.sampled_from("abcdef"), unique=True))
def test_jaccard_is_symmetric(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    r = df.select(signatures.jaccard(F.col("a"), F.col("b")).alias("x"), signatures.jaccard(F.col("b"), F.col("a")).alias("y")).first()
    assert r.x == r.y == (len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0)


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    pairs = [(f"n{r.randint(0, 80):02}", f"n{r.randint(0, 80):02}") for _ in range(60)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("x", "x"), (None, "x")]
    root = {n: n for p in pairs for n in p if n}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a and b and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    linked = {n for a, b in pairs if a and b and a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_fnv_matches_definition():
    r = random.Random(1)
    values = [b"", b"a", bytes(range(256)) * 40] + [r.randbytes(r.randint(0, 9000)) for _ in range(20)]

    def plain(v):
        h = 0xCBF29CE484222325
        for b in v:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"fnv1a64:{h:016x}"

    assert incremental.fnv1a64(values) == [plain(v) for v in values] and incremental.fnv1a64([]) == []


def test_dense_ids(spark):
    p = spark.createDataFrame([(f"f{i:03}",) for i in range(50)], "path string")
    first = dense_ids(p)
    assert [r.file_id for r in first.orderBy("path").collect()] == list(range(50))
    more = dense_ids(p.union(spark.createDataFrame([("a",), ("z",)], "path string")), first)
    assert {r.path: r.file_id for r in more.where("path in ('a', 'z', 'f003')").collect()} == {"a": 50, "z": 51, "f003": 3}


def test_config(tmp_path):
    assert load_config(tmp_path, {}) == Config()
    (tmp_path / ".lodeglass.toml").write_text('max_lines = 5\nlanguages = ["py"]\n')
    assert load_config(tmp_path, {}).max_lines == 5 and load_config(tmp_path, {"LODEGLASS_LANGUAGES": "ts, go"}).languages == ("ts", "go")
    (tmp_path / ".lodeglass.toml").write_text("unknown = 1\n")
    assert load_config(tmp_path, {"LODEGLASS_LANGUAGES": " "}) == Config()


def test_formats():
    assert fmt.quoted("a:b") == "'a:b'" and fmt.quoted("it's") == "'it''s'" and fmt.quoted("plain") == "plain"
    long = "\n".join(f"line {i}" for i in range(3000))
    cut = fmt.capped(long)
    assert len(cut.encode()) < fmt.RESPONSE_BYTES + 200 and re.search(r"line \d+\n# cut:", cut)


def test_watch_stream(spark, tmp_path):
    events = tmp_path / "events"
    rows = [("a.py", "create", "2024-01-01 00:00:01", "x"), ("a.py", "modify", "2024-01-01 00:00:02", "y"), ("b.py", "create", "2024-01-01 00:00:01", "z"), ("b.py", "remove", "2024-01-01 00:00:03", None), ("i.db", "create", "2024-01-01 00:00:01", "q"), ("c.bin", "create", "2024-01-01 00:00:01", "q")]
    spark.createDataFrame(rows, "path string, kind string, ts string, text string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(events))
    seen = []
    stream = spark.readStream.schema(watch.EVENTS).parquet(str(events))
    watch.watch(stream, str(tmp_path / "state"), lambda new, gone: seen.append(({(r.path, r.text) for r in new.collect()}, {r.path for r in gone.collect()})), ("py",), available_now=True).awaitTermination(60)
    assert seen == [({("a.py", "y")}, {"b.py"})]
    counts = watch.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(60)
    assert spark.sql("select sum(n) s from counts").first().s == 6
