"""A small TypeScript tree from source to answers, and operators on literal tables."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeglass import adapters as A
from lodeglass import queries as catalogue
from lodeglass import schema
from lodeglass.cli import main
from lodeglass.functions.names import loc_bounds
from lodeglass.graph import closure, scc
from lodeglass.operators import glossary, listing, lookup, outline, resolve, search, similar
from lodeglass.plans.store import IndexStore
from lodeglass.sources import scan
from lodeglass.sources.index import incremental_generate
from lodeglass.tools import ToolError, Tools, handle

TREE = {
    "src/app.ts": "import React from 'react';\nimport { Config } from './config';\nimport { formatDate } from './utils';\n\nexport function createApp(config: Config): string {\n  return formatDate(config);\n}\n\nexport interface AppConfig {\n  name: string;\n}\n",
    "src/config.ts": "export class Config {\n  private secret = 1;\n  load(path: string): void {\n    return;\n  }\n}\n",
    "src/utils.ts": "import _ from 'lodash';\nexport function formatDate(d: unknown): string {\n  return String(d);\n}\nexport const parseJSON = (s: string) => JSON.parse(s);\n",
    "src/server.ts": "import express from 'express';\nimport { Config } from './config';\nimport { formatDate } from './utils';\nexport class Server {\n  start(port: number): void {\n    formatDate(port);\n  }\n  stop(): void {}\n}\n",
    "src/test/app.test.ts": "import { describe } from 'vitest';\nimport { createApp } from '../app';\ndescribe('app', () => { createApp(null); });\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    store = IndexStore(spark, f"file://{root}/.lodeglass")
    content = scan.scan(spark, f"file://{root}", paths=scan.list_local(root))
    counts = incremental_generate(store, content)
    assert counts["reparse"] == 5
    return root, store, Tools(store, content.select("path", "text"))


def test_edges_of_the_tree(tree):
    got = {(r.source, r.target) for r in tree[1].load("edges").collect()}
    assert got == {("src/app.ts", "src/config.ts"), ("src/app.ts", "src/utils.ts"), ("src/server.ts", "src/config.ts"), ("src/server.ts", "src/utils.ts"), ("src/test/app.test.ts", "src/app.ts")}


def test_tools_on_the_tree(tree):
    tools = tree[2]
    assert "lines: [5, 7]" in tools.run("lookup_export", {"name": "createApp"})
    text = tools.run("list_files", {})
    assert text.split("files:\n")[1].startswith("  - src/app.ts") and "src/utils.ts" in text and "↓ 2 downstream" in text
    assert "downstream:\n  - src/test/app.test.ts" in tools.run("dependency_graph", {"file": "src/app.ts"})
    assert "external: [react]" in tools.run("dependency_graph", {"file": "src/app.ts"})
    assert "cycles: 0" in tools.run("dependency_cycles", {})
    outlined = tools.run("file_outline", {"file": "src/server.ts"})
    assert "- name: start" in outlined and "kind: method" in outlined
    assert "private" not in tools.run("file_outline", {"file": "src/server.ts"})
    assert "used_by: [src/app.ts, src/server.ts]" in tools.run("glossary", {"pattern": "formatDate"})
    assert "return formatDate(config);" in tools.run("read_symbol", {"name": "createApp"})
    assert "src/config.ts" in tools.run("search", {"term": "config"})
    assert json.loads(tools.run("search", {"depends_on": "src/config.ts"}, as_json=True)) != []
    assert "buckets: 1" in tools.run("list_files", {"group_by": "subdir"})
    assert "AppConfig" in tools.run("list_exports", {"pattern": "^App"})
    assert "similar" in tools.run("find_similar", {"name": "formatDate"})
    assert json.loads(tools.run("dupe_clusters", {"nonsense": 1}))[0]["stats"]["clusters"] == 0
    with pytest.raises(ToolError):
        tools.run("search", {"nonsense": 1})
    with pytest.raises(ToolError, match="not found"):
        tools.run("lookup_export", {"name": "NonExistent"})


def test_requests(tree):
    ask = lambda **r: json.loads(handle(tree[2], json.dumps({"jsonrpc": "2.0", "id": 1, **r})))
    assert len(ask(method="tools/list")["result"]["tools"]) == 11
    assert ask(method="tools/call", params={"name": "lookup_export", "arguments": {"name": "x"}})["result"]["content"][0]["text"].startswith("ERROR:")
    assert ask(method="nothing")["error"]["code"] == -32601
    assert json.loads(handle(tree[2], "{"))["error"]["code"] == -32700


def test_incremental(spark, tmp_path):
    for name, text in {"a.py": "from .b import g\n\ndef f():\n    return g()\n", "b.py": "def g():\n    return 1\n"}.items():
        (tmp_path / name).write_text(text)
    store = IndexStore(spark, f"file://{tmp_path}/.lodeglass")
    read = lambda: scan.scan(spark, f"file://{tmp_path}", paths=scan.list_local(tmp_path))
    assert incremental_generate(store, read())["reparse"] == 2
    assert incremental_generate(store, read()) == {"up_to_date": 2, "removed": 0}
    assert [(r.source, r.target) for r in store.load("edges").collect()] == [("a.py", "b.py")]
    (tmp_path / "b.py").unlink()
    (tmp_path / "c.py").write_text("class C:\n    def m(self): pass\n")
    assert incremental_generate(store, read()) == {"up_to_date": 1, "reparse": 1, "removed": 1}
    assert {r.path for r in store.load("files").collect()} == {"a.py", "c.py"}
    assert {r.dotted_name for r in store.load("members").collect()} == {"C.m"}
    assert store.load("edges").count() == 0
    store.clear()
    assert store.load("files").count() == 0


def test_command_line(tree, spark, capsys):
    assert main(["--root", str(tree[0]), "validate"], spark) == 0
    assert main(["--root", str(tree[0]), "ls", "--sort-by", "downstream", "--limit", "1"], spark) == 0
    assert "src/config.ts" in capsys.readouterr().out
    assert main(["--root", str(tree[0]), "status"], spark) == 0
    assert "5 found, 5 indexed" in capsys.readouterr().out


def edges(spark, pairs, runtime=True, hier=False):
    return spark.createDataFrame([(*p, runtime, hier) if len(p) == 2 else p for p in pairs], schema.EDGES)


def test_closure_depths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")])
    depth = lambda *a: {(r.path, r.depth) for r in closure.transitive(e, *a).collect()}
    assert depth("a", "upstream", 2) == {("b", 1), ("c", 2)}
    assert depth("a", "upstream") == {("b", 1), ("c", 2), ("d", 3)}
    assert depth("b", "downstream") == {("a", 1), ("c", 2), ("d", 1)}
    with pytest.raises(ValueError):
        closure.transitive(e, "a", "upstream", 0)


def test_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("x", "x"), ("m", "n", True, True), ("n", "m", True, True), ("t", "u", False, False), ("u", "t", False, False)])
    found = lambda **k: {(r.node, r.component) for r in scc.cycles(e, **k).collect()}
    assert found() == {("a", "a"), ("b", "a"), ("x", "x")}
    assert found(include_hierarchy=True) == {("a", "a"), ("b", "a"), ("x", "x"), ("m", "m"), ("n", "m")}
    assert ("u", "t") in found(edge_mode="all")
    assert found(containing="a") == {("a", "a"), ("b", "a")}
    assert [r.kind for r in scc.explain_edges(scc.cycles(e, containing="a"), e).collect()] == ["runtime", "runtime"]


def test_winner_prefers_typescript(spark):
    rows = [("x", "a.ts", 1, 2, None, None, None), ("x", "b.js", 3, 4, None, None, None), ("y", "a.py", 1, 1, None, None, None), ("y", "z.js", 2, 2, None, None, None), ("z", "a.ts", 1, 1, None, None, None), ("z", "b.py", 1, 1, None, None, None), ("z", "c.jsx", 1, 1, None, None, None)]
    got = {r.name: r.file_path for r in lookup.winners(spark.createDataFrame(rows, schema.EXPORTS)).collect()}
    assert got == {"x": "a.ts", "y": "z.js", "z": "c.jsx"}


def files(spark, rows):
    """rows: path, dependencies, imports"""
    none = {}
    return spark.createDataFrame([(p, 1, None, i, d, none, none, [], [], None, None, None, None) for p, d, i in rows], schema.FILES)


def test_resolution(spark):
    f = files(spark, [
        ("app/a.py", [".b"], ["pkg.tool"]), ("app/b.py", [], []), ("app/pkg/tool.py", [], []), ("web/index.ts", ["./x", "../lib"], []), ("web/x.ts", ["./missing"], []), ("lib/index.js", [], []),
        ("src/q.rs", ["crate::core::run"], []), ("src/core/run.rs", [], []),
    ])
    got = {(r.source, r.target) for r in resolve.build_edges(f).collect()}
    assert got == {("app/a.py", "app/b.py"), ("app/a.py", "app/pkg/tool.py"), ("web/index.ts", "web/x.ts"), ("web/index.ts", "lib/index.js"), ("src/q.rs", "src/core/run.rs")}


def test_workspace_resolution(spark):
    f = files(spark, [("packages/a/src/m.ts", [], ["@org/b", "@org/b/util"]), ("packages/b/src/index.ts", [], []), ("packages/b/util.ts", [], []), ("cmd/main.go", [], ["example.com/m/internal/h"]), ("internal/h/h.go", [], []), ("internal/h/h_test.go", [], [])])
    p = spark.createDataFrame([("js", "@org/b", "packages/b"), ("go", "example.com/m", "")], schema.PACKAGES)
    got = {(r.source, r.target) for r in resolve.resolve_workspace(f, p).collect()}
    assert got == {("packages/a/src/m.ts", "packages/b/src/index.ts"), ("packages/a/src/m.ts", "packages/b/util.ts"), ("cmd/main.go", "internal/h/h.go")}


def test_merge_is_order_free(spark):
    rows = [("a", "b", False, True), ("a", "b", True, False)]
    for r in (rows, rows[::-1]):
        m = resolve.merge_edges(edges(spark, r)).first()
        assert (m.is_runtime, m.is_hier) == (True, False)


def test_similarity_fixtures(spark):
    sig = "fn f(node: Node) -> Vec<String>"
    rows = [("extract_imports", "a.rs", 1, 2, sig, None, "fn"), ("collect_imports", "b.rs", 1, 2, sig, None, "fn"), ("is_ready", "c.rs", 1, 2, "fn is_ready(&self) -> bool", None, "fn")]
    pool = similar.candidates(spark.createDataFrame(rows, schema.EXPORTS), spark.createDataFrame([], schema.MEMBERS))
    got = {r.name: r.score for r in similar.find_similar(pool.where("name = 'extract_imports'"), pool).collect()}
    assert set(got) == {"collect_imports"} and got["collect_imports"] >= 0.3
    near = [(f"format_symbol_signature_{x}", f"{i}.rs", 1, 2, sig, None, "fn") for i, x in enumerate(("end_byte", "end_node"))] + [(n, "z.rs", 1, 2, sig, None, "fn") for n in ("alpha_one", "beta_two")]
    pool = similar.candidates(spark.createDataFrame(near, schema.EXPORTS), spark.createDataFrame([], schema.MEMBERS))
    found = similar.dupe_clusters(pool, min_score=0.8)
    assert [(round(r.score, 5), r["size"]) for r in found["clusters"].collect()] == [(round((0.5 * 4 / 6 + 0.35) / 0.85, 5), 2)]


def test_block_overflow(spark):
    rows = [(f"load_item_{i}", f"f{i:03}.rs", 1, 2, "fn x() -> String", None, "fn") for i in range(240)]
    pool = similar.candidates(spark.createDataFrame(rows, schema.EXPORTS), spark.createDataFrame([], schema.MEMBERS))
    pairs, overflow = similar.candidate_pairs(similar.block_keys(similar.numbered(pool)))
    assert overflow.count() >= 1 and pairs.count() <= 3 * 64 * 63 // 2


def test_methods_are_candidates(spark, tmp_path):
    """The queries over exports and methods, against plain Python."""
    parts = [(i, f"red {('widget', 'gadget', 'wheel')[i % 3]}", f"Brand#{i % 4}", ("LARGE TIN", "SMALL TIN")[i % 2], 1 + i % 9) for i in range(40)]
    suppliers = [(i, i % 3) for i in range(1, 31)]
    for name, rows, ddl in (("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), ("supplier", suppliers, "s_suppkey long, s_nationkey long")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    methods = {(f"Nation{n}.supply{k}", f"src/nation_{n}.ts"): ["nation", str(n), "supply", str(k)] for k, n in suppliers if k % 5}
    pool = similar.candidates(A.exports(spark, str(tmp_path)), A.members(spark, str(tmp_path))).collect()
    assert {(r.name, r.file_path) for r in pool if r.kind == "method"} == set(methods)
    assert all(set(r.tokens) == set(methods[r.name, r.file_path]) for r in pool if r.kind == "method")

    longer = [(r, [t for t in r.tokens if len(t) > 1]) for r in pool]
    freq = Counter((r.kind, t) for r, ts in longer for t in ts)
    assert {(r.kind, r.token): r.freq for r in run("token_frequency_all")} == freq and freq["method", "supply"] == len(methods)
    shape = lambda r: f"arity={'?' if r.arity is None else r.arity};ret={r.ret or '?'}"
    key = lambda r: (r.file_path, r.name, r.start_line, r.end_line)
    blocks = {}
    for r, ts in longer:
        for t in sorted(ts, key=lambda t: (freq[r.kind, t], t))[:2]:
            blocks.setdefault(f"token|{r.kind}|{t}|{shape(r)}", []).append(key(r))
    assert max(map(len, blocks.values())) <= similar.BLOCK_CAP
    assert {r.block: r.n for r in run("dupe_blocks_all")} == {b: len(x) for b, x in blocks.items()}
    pairs = {(a, b) for x in blocks.values() for a in x for b in x if a < b}
    assert sorted(map(tuple, run("dupe_pairs_all"))) == sorted((a[0], a[1], b[0], b[1]) for a, b in pairs)
    assert any(a[1].startswith("Nation") for a, _ in pairs)

    by = {key(r): r for r in pool}
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))

    def plain_score(a, b):
        near = 1.0 if a.arity == b.arity else 0.5 if None not in (a.arity, b.arity) and abs(a.arity - b.arity) == 1 else 0.0
        return (0.5 * jac(a.tokens, b.tokens) + 0.25 * (near + (a.ret == b.ret)) / 2 + 0.1 * (a.kind == b.kind)) / 0.85

    links, root = [(a, b) for a, b in pairs if plain_score(by[a], by[b]) >= similar.MIN_DUPLICATE], {k: k for k in by}
    for _ in by:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    sizes = Counter(root.values())
    want = sorted(((round(max(plain_score(by[a], by[b]) for a, b in links if root[a] == c), 6), n) for c, n in sizes.items() if n > 1), key=lambda x: (-x[0], -x[1]))[: similar.LIMIT]
    assert [(r.score, r["size"]) for r in run("dupe_clusters_all")] == want
    probe = min(pool, key=lambda r: (r.name, r.file_path))
    found = sorted((-round(plain_score(probe, r), 6), r.name, r.file_path) for r in pool if (r.name, r.file_path) != (probe.name, probe.file_path) and plain_score(probe, r) >= similar.MIN_SIMILAR)[:10]
    assert probe.kind == "method" and [(-r.score, r.name, r.file_path) for r in run("similar_topk_all")] == found


def test_connected_query_has_all_components(spark, tmp_path):
    rows = [(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-02-02"), (4, "2024-03-03"), (4, "2024-02-02"), (5, "2024-05-05")]
    spark.createDataFrame(rows, "o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    nodes = {x for k, d in rows for x in (f"c{k}", f"d{d}")}
    root = {x: x for x in nodes}
    for _ in nodes:
        for k, d in rows:
            root[f"c{k}"] = root[f"d{d}"] = min(root[f"c{k}"], root[f"d{d}"])
    assert len(set(root.values())) == 3
    assert {(r.node, r.component) for r in catalogue.QUERIES["connected"](spark, str(tmp_path)).collect()} == set(root.items())


def test_suggestions_for_many_names(spark):
    members = spark.createDataFrame([(f"T.n{i:05}xyz", None) for i in range(1200)], "dotted_name string, file_path string")
    wanted = spark.createDataFrame([(f"n{i:05}xyz",) for i in range(1200)], "wanted string")
    got = {(r.wanted, r.suggestion) for r in outline.member_suggestions(wanted, members).where("distance = 0").collect()}
    assert got == {(f"n{i:05}xyz", f"T.n{i:05}xyz") for i in range(1200)}


def test_similar_for_every_probe(spark, tmp_path, monkeypatch):
    """Each of many probes gets what it gets alone, also when they are worked off in blocks."""
    parts = [(i, f"{('red', 'blue')[i % 2]} {('widget', 'gadget', 'wheel')[i % 3]}{i}", f"Brand#{i % 4}", "TIN", 1 + i % 9) for i in range(61)]
    for name, rows, ddl in (("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), ("supplier", [(k, 1) for k in range(1, 8)], "s_suppkey long, s_nationkey long")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(similar, "PROBES", 2)
    got = {}
    for r in catalogue.QUERIES["similar_topk_each"](spark, str(tmp_path)).collect():
        got.setdefault(r.probe_name, []).append((-r.score, r.name, r.file_path))
    pool = similar.candidates(A.exports(spark, str(tmp_path)), A.members(spark, str(tmp_path)))
    assert set(got) == {parts[i][1].replace(" ", "_") for i in (0, 20, 40, 60)}
    for name, rows in got.items():
        alone = similar.find_similar(pool.where(F.col("name") == name), pool).collect()
        assert sorted(rows) == [(-round(r.score, 6), r.name, r.file_path) for r in alone] and len(rows) == 10


def test_similar_for_every_probe_scores_no_cross_product(spark, tmp_path):
    """Probes and candidates meet by what they agree in: no join of the plan lacks keys."""
    for name, rows, ddl in (("part", [(i, f"red widget{i}", "Brand#1", "TIN", 1) for i in range(41)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), ("supplier", [(1, 1)], "s_suppkey long, s_nationkey long")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = catalogue.QUERIES["similar_topk_each"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Join" in plan and not any(x in plan for x in ("NestedLoopJoin", "CartesianProduct"))


def test_similar_for_every_probe_broadcasts_no_lists(spark, tmp_path):
    """However small the files of the probes are, what is exploded from them doesn't go through the driver."""
    for name, rows, ddl in (("part", [(i, "red widget", "Brand#1", "TIN", i) for i in range(41)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), ("supplier", [(1, 1)], "s_suppkey long, s_nationkey long")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    found = catalogue.QUERIES["similar_topk_each"](spark, str(tmp_path))
    assert found.count() > 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_similar_for_every_probe_of_one_shape(spark):
    """Probes that score alike share lists: each leaves out its own overloads, which can be all that stands first."""
    rows = [("get_user", "a.ts", i, i, "f()", "fn") for i in range(12)] + [("get_user", f"b{i:02}.ts", 1, 1, "f()", "fn") for i in range(12)]
    exports = spark.createDataFrame([(*r[:5], None, r[5]) for r in rows], schema.EXPORTS)
    pool = similar.candidates(exports, spark.createDataFrame([], schema.MEMBERS)).localCheckpoint()
    got = {}
    for r in similar.find_similar_each(pool, pool).collect():
        got.setdefault((r.probe_file, r.probe_line), []).append(r.file_path)
    assert len(got) == 24 and all(sorted(got["a.ts", i]) == [f"b{j:02}.ts" for j in range(10)] for i in range(12))
    assert all(got[f"b{i:02}.ts", 1] == ["a.ts"] * 10 for i in range(12))


@pytest.mark.parametrize("near", [False, True])
def test_similar_for_every_probe_equals_all_pairs(spark, monkeypatch, near):
    """Odd rows: overloads, long names, unknown signatures and kinds, names without tokens, neighbourhoods; many ties."""
    monkeypatch.setattr(similar, "PROBES", 7)
    rng, words = random.Random(5), "get set user id list load store red blue old".split()
    signatures = [None, "", "x", "f()", "f(a)", "f(a, b)", "f() -> A", "f(a) -> A", "f(a, b) -> B", "f(a, b, c) -> A"]
    rows = []
    for i in range(240):
        name = "_" * (i % 3) if i % 40 < 2 else "_".join(rng.sample(words, rng.choice((1, 2, 2, 3, 4, 8, 9))))
        rows.append((name, f"d{rng.randrange(5)}.ts", i, i + 1, rng.choice(signatures), rng.choice(["fn", "fn", "struct", None])))
    rows += [("get_user", "d1.ts", 300 + i, 301 + i, rng.choice(signatures[3:]), rng.choice(["fn", "struct"])) for i in range(40)]  # more overloads than places
    exports = spark.createDataFrame([(*r[:5], None, r[5]) for r in rows], schema.EXPORTS)
    own = [(f"d{i}.ts", [f"p{j}" for j in range(i, 4)], [], []) for i in range(4)] if near else []
    facts = spark.createDataFrame(own, "path string, imports array<string>, dependencies array<string>, none array<string>")
    pool = similar.candidates(exports, spark.createDataFrame([], schema.MEMBERS), facts if near else None).localCheckpoint()
    probes = pool.where("start_line % 4 = 0 or start_line >= 335")
    fields = ["name", "file_path", "start_line", "end_line", "signature", "kind", "tokens", "arity", "ret", "near"]
    pairs = probes.select(F.struct(*fields).alias("a")).crossJoin(pool.select(F.struct(*fields).alias("b"))).where("a.name != b.name or a.file_path != b.file_path")
    want = {}
    for r in similar.scored(pairs).where(F.col("score") >= similar.MIN_SIMILAR).collect():
        want.setdefault((r.a.name, r.a.file_path, r.a.start_line), []).append((-r.score, r.b.name, r.b.file_path, r.b.start_line, r.b.kind))
    got = {}
    for r in similar.find_similar_each(probes, pool).collect():
        got.setdefault((r.probe_name, r.probe_file, r.probe_line), []).append((-r.score, r.name, r.file_path, r.kind or ""))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted((*x[:3], x[4] or "") for x in sorted(v)[:10]) for k, v in want.items()}
    assert len(got) > 60


def test_glossary_modes(spark):
    ex = spark.createDataFrame([("f", "a.ts", 1, 2, None, None, "fn")], schema.EXPORTS)
    none = spark.createDataFrame([], schema.MEMBERS)
    e = edges(spark, [("b.ts", "a.ts"), ("tests/t.ts", "a.ts")])
    used = lambda m: [r.used_by for r in glossary.build_glossary("F", ex, none, e, m).collect()]
    assert (used("source"), used("tests"), used("all")) == (["b.ts"], ["tests/t.ts"], ["b.ts,tests/t.ts"])
    assert glossary.count_test_dependents(e, "a.ts").first().n == 1


def test_named_precision(spark):
    rows = [("use.ts", {"./a": ["f"]}, []), ("other.ts", {"./a": ["g"]}, []), ("ns.ts", {}, ["./a"]), ("none.ts", {}, [])]
    f = spark.createDataFrame(rows, "path string, named_imports map<string,array<string>>, namespace_imports array<string>")
    users = spark.createDataFrame([("a.ts", r[0]) for r in rows], "target string, user string")
    specs = resolve.import_specifiers(users.selectExpr("user as source", "target"))
    assert {(r.user, r["class"]) for r in glossary.classify_users("f", users, f, specs).collect()} == {("use.ts", "named"), ("other.ts", "other"), ("ns.ts", "namespace"), ("none.ts", "unknown")}


def test_reexports_and_concrete_definition(spark):
    f = spark.createDataFrame([("lib/index.ts", {"./w": ["Widget"]}), ("lib/w.ts", {})], "path string, named_imports map<string,array<string>>")
    ex = spark.createDataFrame([("Widget", "lib/index.ts", 1, 1, None, None, None), ("Widget", "lib/w.ts", 5, 9, None, None, None)], schema.EXPORTS)
    assert [(r.file_path, r.origin, r.origin_line) for r in outline.reexports(f, ex).collect()] == [("lib/index.ts", "lib/w.ts", 5)]
    assert outline.concrete_definition("Widget", "lib/x.ts", ex).first().file_path == "lib/w.ts"


def test_depends_on_target_of_a_target(spark):
    f = files(spark, [("a/x.ts", [], []), ("b/x.ts", [], []), ("c.ts", [], [])])
    e = edges(spark, [("a/x.ts", "b/x.ts"), ("c.ts", "a/x.ts"), ("b/x.ts", "c.ts")])
    assert {r.path for r in search.depends_on("x", f, edges(spark, [("a/x.ts", "b/x.ts"), ("c.ts", "a/x.ts")])).collect()} == {"a/x.ts", "c.ts"}
    assert {r.path for r in search.depends_on("a/x", f, e).collect()} == {"c.ts", "b/x.ts"}


def test_depends_on_one_file_among_equal_stems(spark, tmp_path):
    """The query asks for the dependents of one path: neither those of other extensions nor the file itself, here in a cycle and a dependent of m1.js."""
    def write(folder, sizes, orders):
        parts = [(k, f"n{k}", "Brand#1", "SMALL" if k in (1, 8) else "LARGE", size) for k, size in sizes]
        spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
        lines = [(o, k, 1, i, "F", "N", 1.0, 1.0, "1995-01-01") for o, ks in enumerate(orders) for i, k in enumerate(ks)]
        spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_linestatus string, l_returnflag string, l_extendedprice double, l_quantity double, l_shipdate string").write.parquet(f"{folder}/lineitem.parquet")
        return {r.path for r in catalogue.QUERIES["filter_search_depends"](spark, str(folder)).collect()}

    sizes = [(1, 4), (8, 1), (2, 4), (3, 4), (4, 4)]  # 1 is brand_1/small/m1.ts, 8 m1.js, others brand_1/large/mK.ts
    orders = [(2, 1), (3, 2), (1, 3), (1, 8), (4, 8)]  # 2 and 3 need 1, 1 needs 3 and m1.js, 4 needs m1.js
    assert write(tmp_path / "a", sizes, orders) == {"brand_1/large/m2.ts", "brand_1/large/m3.ts"}
    assert write(tmp_path / "b", sizes[1:], [(4, 8)]) == set()  # no such file


def test_loc_expressions():
    assert [loc_bounds(x) for x in (">5", ">=5", "<5", "<=5", "=5", "5", "<0")] == [(6, None), (5, None), (None, 4), (None, 5), (5, 5), (5, 5), (None, 0)]
    with pytest.raises(ValueError):
        loc_bounds("~5")


def test_pages(spark):
    df = spark.range(10).orderBy("id")
    assert [r.id for r in listing.page(df, 3, 4).collect()] == [4, 5, 6]


def test_store_refuses_wrong_kinds(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/i")
    bad = spark.createDataFrame([("x", "a", 1, 1, None, "everyone", "fn")], schema.EXPORTS)
    with pytest.raises(ValueError):
        store.write_full(files(spark, [("a", [], [])]), bad, spark.createDataFrame([], schema.MEMBERS))


def test_edge_labels(spark):
    e = edges(spark, [("a", "b", r, h) for r in (True, False) for h in (True, False)])
    assert {r.k for r in e.select(schema.edge_label().alias("k")).collect()} == {"runtime", "mod-hierarchy", "type-only", "type-only mod-hierarchy"}
    assert spark.range(1).select(schema.valid_path(F.lit("a/../b")).alias("x")).first().x is False


def test_writes_of_several_tables_show_as_a_whole(spark, tmp_path, monkeypatch):
    """A write that fails between two tables leaves the index as it was, and what it left behind goes with the next one."""
    from lodeglass import schema
    from lodeglass.plans.store import IndexStore

    store = IndexStore(spark, str(tmp_path / "index"))
    rows = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string").selectExpr("path", *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in spark.createDataFrame([], schema.FILES).schema if f.name != "path"])
    none, members = spark.createDataFrame([], schema.EXPORTS), spark.createDataFrame([], schema.MEMBERS)
    edges = spark.createDataFrame([], schema.EDGES)
    store.write_full(rows("a.ts", "b.ts"), none, members, edges)
    stage = store._stage

    def broken(table, df, staged):
        if table == "members":
            raise OSError("the disk is full")
        return stage(table, df, staged)

    monkeypatch.setattr(store, "_stage", broken)
    with pytest.raises(OSError):
        store.upsert(rows("c.ts"), none, members)
    monkeypatch.undo()
    assert sorted(r.path for r in store.load("files").collect()) == ["a.ts", "b.ts"] and store.load("ids").count() == 2
    store.upsert(rows("c.ts"), none, members)
    store.upsert(rows("d.ts"), none, members)
    assert sorted(r.path for r in store.load("files").collect()) == ["a.ts", "b.ts", "c.ts", "d.ts"] and store.load("ids").count() == 4
    assert len(store._names("files")) == 2 and len(store._names("manifest")) <= 4  # two versions; manifests and their checksums
    store.write_meta({f"key{i}": "x" for i in range(1500)})
    assert len(store.meta()) == 1501


def test_reached_by_others(spark):
    import random

    from lodeglass.graph import closure

    r = random.Random(3)
    for n, m in ((12, 14), (30, 40), (8, 30)):
        pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]
        start = [f"n{i}" for i in range(0, n, 3)]
        want = set()
        for s in start:
            seen, todo = {s}, [s]
            while todo:
                at = todo.pop()
                for a, b in pairs:
                    if a == at and b not in seen:
                        seen.add(b)
                        todo.append(b)
            want |= seen - {s}
        df = spark.createDataFrame(pairs, "source string, target string")
        assert {x.node for x in closure.reached_by_others(spark.createDataFrame([(s,) for s in start], "node string"), df).collect()} == want


def test_long_chains_are_compacted(spark):
    from lodeglass.graph import closure

    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)], "source string, target string")
    got = closure.reachable_from(spark.createDataFrame([("005",)], "node string"), chain)
    assert sorted((r.node, r.depth) for r in got.collect()) == [(f"{i:03}", i - 5) for i in range(5, 41)]
