"""The query surface: eleven tools over an index, each with the same arguments on the command line and in a request.

Every call reads the current snapshot. Tools return text; `run(..., as_json=True)` gives rows.
"""

from __future__ import annotations

import inspect
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass import format as fmt
from lodeglass.functions.names import path_filter
from lodeglass.graph import closure, scc
from lodeglass.operators import glossary as gl
from lodeglass.operators import listing, outline, resolve, search, similar
from lodeglass.operators import lookup as lk
from lodeglass.sources.config import Config
from lodeglass.sources.index import find_hidden, verified_users
from lodeglass.sources.parsers import parse_file

PROTOCOL = "2024-11-05"
NAMES = ("lookup_export", "list_exports", "dependency_graph", "dependency_cycles", "search", "read_symbol", "file_outline", "list_files", "glossary", "find_similar", "dupe_clusters")


class ToolError(Exception):
    """What a caller can mend; reported as text."""


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Tools:
    """Tools over a store (an object with `load(table)`); `content` (path, text) serves source texts."""

    def __init__(self, store, content: DataFrame | None = None, config: Config = Config()):
        self.store, self.content, self.config = store, content, config

    def _t(self, *names: str) -> list[DataFrame]:
        return [self.store.load(n) for n in names]

    def _known(self, path: str) -> dict:
        rows = _rows(self.store.load("files").where(F.col("path") == path))
        if not rows:
            raise ToolError(f"File '{path}' not found in the index.")
        return rows[0]

    def lookup_export(self, name: str):
        exports, members, files = self._t("exports", "members", "files")
        rows = _rows(lk.lookup_export(name, exports, members, files, lk.own_named_imports(files)))
        if not rows:
            raise ToolError(f"Export '{name}' not found. Use glossary(pattern: \"{name}\") or search(export: \"{name}\") to find close matches.")
        return rows, fmt.lookup(rows[0], _rows(listing.exports_of_file(exports, rows[0]["file_path"])))

    def list_exports(self, pattern: str | None = None, file: str | None = None, directory: str | None = None, filter: str = "all", limit: int = 200, offset: int = 0):
        exports, members, files = self._t("exports", "members", "files")
        if file:
            self._known(file)
            rows = _rows(listing.exports_of_file(exports, file, filter))
        elif pattern:
            rows = _rows(listing.exports_by_pattern(exports, members, pattern, lk.own_named_imports(files), directory, filter, limit, offset, self.config))
        else:
            rows = _rows(listing.exports_by_file(exports, directory, filter, limit, offset, self.config))
        return rows, fmt.table("exports", rows)

    def dependency_graph(self, file: str, depth: int = 1, filter: str = "all", reverse: bool = False, transitive: bool = False):
        if depth != -1 and depth < 1:
            raise ToolError("depth must be -1 or at least 1.")
        known, (edges, files, packages) = self._known(file), self._t("edges", "files", "packages")
        keep = path_filter(F.col("path"), filter, self.config)
        depth = -1 if transitive else depth
        down = closure.transitive(edges, file, "downstream", depth).where(keep)
        if reverse:
            rows = _rows(down)
            return rows, fmt.transitive(file, [], [], rows)
        up = closure.transitive(edges, file, "upstream", depth).where(keep)
        resolved = resolve.resolve_all(files.where(F.col("path") == file).unionByName(files.where(F.col("path") != file).withColumns({c: F.lit(None).cast(files.schema[c].dataType) for c in ("imports", "dependencies")})), packages)
        external = sorted({r["specifier"] for r in _rows(closure.external_specifiers(files.where(F.col("path") == file), resolved))})
        ups, downs = _rows(up), _rows(down)
        if depth == 1:
            return ups + downs, fmt.dependencies(file, [r["path"] for r in ups], external, [r["path"] for r in downs], known["imports"] or [])
        both = {r["path"] for r in ups} & {r["path"] for r in downs}
        return ups + downs, fmt.transitive(file, ups, external, downs, both)

    def dependency_cycles(self, file: str | None = None, filter: str = "all", edge_mode: str = "runtime", include_mod_hierarchy: bool = False, explain: bool = False):
        edges, files = self._t("edges", "files")
        if file:
            self._known(file)
        nodes = None if filter == "all" else files.where(path_filter(F.col("path"), filter, self.config)).select(F.col("path").alias("node"))
        found = scc.cycles(edges, edge_mode, include_mod_hierarchy, nodes, file)
        groups: dict[str, list[str]] = {}
        for r in _rows(found.orderBy("component", "node")):
            groups.setdefault(r["component"], []).append(r["node"])
        inner = _rows(scc.explain_edges(found, edges, edge_mode, include_mod_hierarchy)) if explain else []
        return [{"component": k, "files": v} for k, v in groups.items()], fmt.cycles(list(groups.values()), inner)

    def search(self, term: str | None = None, export: str | None = None, imports: str | None = None, depends_on: str | None = None, min_loc: int | None = None, max_loc: int | None = None, limit: int = 50):
        exports, members, files, edges = self._t("exports", "members", "files", "edges")
        again = lk.own_named_imports(files)
        filtered = any(x is not None for x in (export, imports, depends_on, min_loc, max_loc))
        if term is None and export is not None and all(x is None for x in (imports, depends_on, min_loc, max_loc)):
            rows = _rows(search.export_search(export, exports, again, limit))
            return rows, fmt.table("exports", rows)
        passed = search.filter_search(files, exports, edges, export, imports, depends_on, min_loc, max_loc, again) if filtered or term is None else None
        if term is None:
            rows = sorted(_rows(passed), key=lambda r: (-(r["loc"] or 0), r["path"]))
            return rows, fmt.table("files", rows)
        hits = search.bare_search(term, exports, members, files, again, limit)
        rows = _rows(search.combined_search(hits, passed) if passed is not None else hits)
        rows.sort(key=lambda r: (search.SECTIONS.index(r["section"]), -r["score"], r["name"], r["file_path"]))
        return rows, fmt.table("hits", rows)

    def read_symbol(self, name: str, truncate: bool = True, line_numbers: bool = False):
        if self.content is None:
            raise ToolError("No source texts are attached.")
        exports, members, files = self._t("exports", "members", "files")
        try:
            places = _rows(outline.resolve_symbol(name, exports, members, lk.own_named_imports(files)))
        except ValueError as e:
            raise ToolError(str(e)) from None
        if not places:  # a symbol that its file keeps to itself
            path, _, own = name.rpartition(":")
            places = _rows(find_hidden(self.content, own, path or None).orderBy("file_path", "start_line"))
        if not places:
            near = _rows(outline.member_suggestions(self.content.sparkSession.createDataFrame([(name.rsplit(".", 1)[-1],)], "wanted string"), members)) if "." in name else []
            raise ToolError(f"Symbol '{name}' not found." + (f" Did you mean {', '.join(r['suggestion'] for r in near)}?" if near else ""))
        if len(places) > 1:
            raise ToolError(f"Symbol '{name}' is ambiguous: " + ", ".join(f"{p['file_path']}:{p['name']}" for p in places))
        p = places[0]
        one = self.content.sparkSession.createDataFrame([(p["file_path"], p["start_line"], p["end_line"])], "file_path string, start_line long, end_line long")
        body = _rows(outline.source_slice(one, self.content))
        text = body[0]["body"] if body else ""
        if truncate and len(text.encode()) > outline.MAX_SYMBOL_BYTES and "." not in name:
            inner = _rows(members.where((F.col("file_path") == p["file_path"]) & F.col("dotted_name").startswith(p["name"] + ".")).orderBy("start_line"))
            if inner:
                return inner, fmt.table(f"members of {p['name']}", [{"name": m["dotted_name"], "start": m["start_line"], "end": m["end_line"]} for m in inner])
        return [{**p, "body": text}], fmt.symbol(name, p["file_path"], p["start_line"], p["end_line"], text, line_numbers)

    def file_outline(self, file: str, include_private: bool = False, truncate: bool = True):
        known, (exports, members, files) = self._known(file), self._t("exports", "members", "files")
        rows = _rows(outline.file_outline(file, exports, members, include_private))
        if include_private and self.content is not None:
            text = self.content.where(F.col("path") == file).select("text").first()
            found = parse_file(file, text[0] or "") if text else None
            shown = {(r["parent"], r["name"]) for r in rows}
            for h in found.hidden if found else []:
                parent, _, own = h.name.rpartition(".")
                if (parent or None, own) not in shown:
                    rows.append({"parent": parent or None, "name": own, "start_line": h.start, "end_line": h.end, "size": h.end - h.start + 1, "signature": h.signature, "visibility": h.visibility, "kind": h.kind})
        again = _rows(outline.reexports(files.where(F.col("path") == file), exports).where(F.col("file_path") == file).orderBy("name"))
        return rows, fmt.outline(file, known["loc"], known["imports"], known["dependencies"], rows, again)

    def list_files(self, directory: str | None = None, pattern: str | None = None, limit: int = 200, offset: int = 0, sort_by: str = "loc", order: str | None = None, group_by: str | None = None, filter: str = "all"):
        files, exports, edges = self._t("files", "exports", "edges")
        chosen = listing.select_files(files, directory, pattern, filter, self.config)
        if group_by == "subdir":
            rows = _rows(listing.rollup_subdir(chosen, directory or "", sort_by))
            return rows, fmt.rollup(rows)
        rows = _rows(listing.list_files(files, exports, edges, sort_by, order, limit, offset, directory=directory, pattern=pattern, which=filter, config=self.config))
        return rows, fmt.file_list(rows, _rows(listing.summary(chosen))[0], directory, offset)

    def glossary(self, pattern: str, limit: int = 10, mode: str = "source", precision: str = "named", exact: bool = False, truncate: bool = True):
        exports, members, edges, files, packages = self._t("exports", "members", "edges", "files", "packages")
        try:
            first, total = gl.glossary_page(gl.build_glossary(pattern, exports, members, edges, mode, exact, self.config), limit)
        except ValueError as e:
            raise ToolError(str(e)) from None
        rows = _rows(first.orderBy(F.lower("name"), "name", "file_path"))
        functions = lk.function_index(exports.where(F.col("name") == pattern), files)
        if precision in ("named", "call-site") and "." not in pattern and not functions.isEmpty():
            pairs = [(r["file_path"], u) for r in rows if r["name"] == pattern for u in r["used_by"].split(",") if u]
            users = files.sparkSession.createDataFrame(pairs, "target string, user string")
            kinds = gl.classify_users(pattern, users, files, resolve.import_specifiers(users.select(F.col("user").alias("source"), "target"), packages))
            kept = {(r["target"], r["user"]) for r in _rows(kinds) if r["class"] in ("named", "unknown")}
            if precision == "call-site" and self.content is not None:
                calls = {r["user"] for r in _rows(verified_users(users, self.content, pattern, exports)) if r["class"] == "caller"}
                kept = {(t, u) for t, u in kept if u in calls}
            for r in rows:
                if r["name"] == pattern:
                    own = [u for u in r["used_by"].split(",") if (r["file_path"], u) in kept]
                    r["used_by"], r["n_used_by"] = ",".join(own), len(own)
        elif "." in pattern and self.content is not None:
            for r in rows:
                if r["name"] == pattern and r["used_by"]:
                    users = files.sparkSession.createDataFrame([(u,) for u in r["used_by"].split(",")], "user string")
                    own = sorted(x["user"] for x in _rows(verified_users(users, self.content, pattern, exports)) if x["class"] == "caller")
                    r["used_by"], r["n_used_by"] = ",".join(own), len(own)
        return rows, fmt.glossary(rows, _rows(total)[0]["total"])

    def find_similar(self, name: str, signature: str | None = None, kind: str | None = None, directory: str | None = None, limit: int = 10, include_tests: bool = False):
        exports, members, files = self._t("exports", "members", "files")
        pool = similar.candidates(exports, members, files)
        probe = pool.where(F.col("name") == name).orderBy(F.desc("file_path")).limit(1)
        if probe.isEmpty() or signature or kind:
            seed = files.sparkSession.createDataFrame([(name, "", None, None, signature, kind or "fn")], "name string, file_path string, start_line long, end_line long, signature string, kind string")
            probe = similar.candidates(seed.withColumn("visibility", F.lit("public")).select("name", "file_path", "start_line", "end_line", "signature", "visibility", "kind"), members.limit(0))
        rows = _rows(similar.find_similar(probe, pool, directory, include_tests, limit))
        return rows, fmt.table("similar", [{**r, "score": round(r["score"], 3)} for r in rows])

    def dupe_clusters(self, directory: str | None = None, kind: tuple[str, ...] = (), min_score: float = 0.90, limit: int = 10, include_tests: bool = False):
        exports, members, files = self._t("exports", "members", "files")
        found = similar.dupe_clusters(similar.candidates(exports, members, files), min_score, limit, directory=directory, kinds=tuple(kind), include_tests=include_tests)
        groups = {r["cluster"]: {"score": round(r["score"], 6), "size": r["size"], "members": []} for r in _rows(found["clusters"])}
        for m in _rows(found["members"].orderBy("cluster", "file_path", "name")):
            groups[m["cluster"]]["members"].append({k: m[k] for k in ("name", "file_path", "start_line")})
        rows = sorted(groups.values(), key=lambda g: (-g["score"], -g["size"], g["members"][0]["file_path"], g["members"][0]["name"]))
        return rows, fmt.as_json([{"clusters": rows, "diagnostics": _rows(found["diagnostics"]), "stats": {"clusters": len(rows)}}])

    def run(self, name: str, arguments: dict, as_json: bool = False) -> str:
        """The tool's text, at most 10,240 bytes unless `truncate` is false. Unknown arguments are refused, but for dupe_clusters."""
        if name not in NAMES:
            raise ToolError(f"Unknown tool: {name}")
        tool = getattr(self, name)
        known = inspect.signature(tool).parameters
        if name != "dupe_clusters" and set(arguments) - set(known):
            raise ToolError(f"Unknown arguments: {sorted(set(arguments) - set(known))}")
        rows, text = tool(**{k: v for k, v in arguments.items() if k in known})
        text = fmt.as_json(rows) if as_json else text
        return fmt.capped(text) if arguments.get("truncate", True) else text


def handle(tools: Tools, line: str) -> str | None:
    """One JSON-RPC request as a line; errors of tools are successful responses with text."""
    try:
        request = json.loads(line)
    except ValueError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}})
    method, number = request.get("method"), request.get("id")
    if number is None:
        return None
    reply = lambda result: json.dumps({"jsonrpc": "2.0", "id": number, "result": result}, ensure_ascii=False)
    if method == "initialize":
        return reply({"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeglass", "version": "0.1.0"}})
    if method == "ping":
        return reply({})
    if method == "tools/list":
        return reply({"tools": [{"name": n, "description": "", "inputSchema": {"type": "object", "properties": {p: {} for p in inspect.signature(getattr(Tools, n)).parameters if p != "self"}}} for n in NAMES]})
    if method == "tools/call":
        params = request.get("params") or {}
        try:
            text = tools.run(params.get("name", ""), params.get("arguments") or {})
        except (ToolError, TypeError, ValueError) as e:
            text = f"ERROR: {e}"
        return reply({"content": [{"type": "text", "text": text}]})
    return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": "Method not found"}})


def serve(tools: Tools, source=sys.stdin, sink=sys.stdout) -> None:
    for line in source:
        if line.strip() and (out := handle(tools, line)) is not None:
            print(out, file=sink, flush=True)
