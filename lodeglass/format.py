"""Results as text. Rows are few by then: pages, top-k lists, one file's facts."""

from __future__ import annotations

import json

RESPONSE_BYTES = 10_240
_SPECIAL = ":#[]{},&*!|>'\"%@`"


def quoted(text: str) -> str:
    """Single quotes around what YAML could misread."""
    return "'" + text.replace("'", "''") + "'" if not text or any(c in text for c in _SPECIAL) else text


def one_line(text: str) -> str:
    return " ".join(text.split())


def capped(text: str, limit: int = RESPONSE_BYTES) -> str:
    """Cut at a line's end, with a note, where the text is over the limit in bytes."""
    raw = text.encode()
    if len(raw) <= limit:
        return text
    kept = raw[:limit].decode(errors="ignore")
    kept = kept[: kept.rfind("\n")] if "\n" in kept else kept
    return f"{kept}\n# cut: {len(kept.encode())} of {len(raw)} bytes shown; narrow the query or switch truncation off"


def listed(items) -> str:
    return "[" + ", ".join(items) + "]"


def file_list(rows: list[dict], total: dict, directory: str | None = None, offset: int = 0) -> str:
    """Files with their counts, aligned."""
    head = f"summary: {total['total']} files · {total['total_loc']} LOC"
    if total.get("largest"):
        head += f" · largest: {total['largest']} ({total['largest_loc']} LOC)"
    out = ["---", *([f"directory: {directory}"] if directory else []), head, f"total: {total['total']}"]
    if rows and len(rows) < total["total"]:
        out.append(f"showing: {offset + 1}-{offset + len(rows)} of {total['total']}" + (f"; next offset: {offset + len(rows)}" if offset + len(rows) < total["total"] else ""))
    out.append("files:")
    width = max((len(r["path"]) for r in rows), default=0)
    for r in rows:
        more = f", ↓ {r['n_downstream']} downstream" if r["n_downstream"] else ""
        out.append(f"  - {r['path']:<{width}}  # loc: {r['loc']}, exports: {r['n_exports']}{more}")
    return "\n".join([*out, "# ↓ N = direct dependents resolved by the dependency graph."])


def rollup(rows: list[dict]) -> str:
    files, loc = sum(r["n_files"] for r in rows), sum(r["loc"] or 0 for r in rows)
    width = max((len(r["bucket"]) for r in rows), default=0)
    return "\n".join(["---", f"summary: {files} files · {loc} LOC", f"buckets: {len(rows)}", *(f"  {r['bucket']:<{width}}  {r['n_files']} files  · {r['loc']} LOC" for r in rows)])


def lookup(row: dict, exports: list[dict]) -> str:
    out = ["---", f"symbol: {quoted(row['name'])}", f"file: {row['file_path']}"]
    if row["start_line"]:
        out.append(f"lines: [{row['start_line']}, {row['end_line']}]")
    out += ["exports:", *(f"  {quoted(e['name'])}: [{e['start_line']}, {e['end_line']}]" for e in exports)]
    for name in ("imports", "dependencies"):
        if row.get(name):
            out.append(f"{name}: {listed(row[name])}")
    if row.get("additional"):
        out.append(f"# {row['additional']} additional definitions")
    return "\n".join([*out, f"loc: {row['loc']}"])


def outline(path: str, loc: int, imports, dependencies, rows: list[dict], reexports: list[dict] = ()) -> str:
    out = ["---", f"file: {path}", f"loc: {loc}"]
    out += [f"{n}: {listed(v)}" for n, v in (("imports", imports), ("dependencies", dependencies)) if v]

    def facts(r, pad):
        lines = [f"{pad}lines: [{r['start_line']}, {r['end_line']}]", f"{pad}size: {r['size']}"] if r["start_line"] else []
        return lines + [f"{pad}{n}: {quoted(one_line(r[n]))}" if n == "kind" else f"{pad}{n}: {one_line(r[n])}" for n in ("signature", "visibility", "kind") if r[n]]

    again = {r["name"] for r in reexports}
    out.append("symbols:")
    for r in rows:
        if r["parent"] is None and r["name"] not in again:
            out += [f"  {quoted(r['name'])}:", *facts(r, "    ")]
            own = [m for m in rows if m["parent"] == r["name"]]
            if own:
                out.append("    members:")
                for m in own:
                    out += [f"      - name: {m['name']}", *facts(m, "        ")]
    if reexports:
        out += ["re_exports:", *(f"  {quoted(r['name'])}: {r['origin']}:{r['origin_line']}" for r in reexports)]
    return "\n".join(out)


def dependencies(path: str, local: list[str], external: list[str], downstream: list[str], imports=()) -> str:
    out = ["---", f"file: {path}"]
    out += [f"{n}: {listed(v)}" for n, v in (("local_deps", local), ("external", external)) if v]
    if downstream:
        out += ["downstream:", *(f"  - {d}" for d in downstream)]
    return "\n".join(out + ([f"imports: {listed(imports)}"] if imports else []))


def transitive(path: str, upstream: list[dict], external: list[str], downstream: list[dict], circular: set[str] = frozenset()) -> str:
    out = ["---", f"file: {path}"]
    for name, rows in (("upstream", upstream), ("downstream", downstream)):
        if rows:
            out += [f"{name}:", *(f"  - {r['path']}  # depth: {r['depth']}" + (" (circular)" if name == "downstream" and r["path"] in circular else "") for r in rows)]
    return "\n".join(out + ([f"external: {listed(external)}"] if external else []))


def cycles(components: list[list[str]], edges: list[dict] = ()) -> str:
    out = ["---", f"cycles: {len(components)}"]
    for i, nodes in enumerate(components, 1):
        out += [f"- cycle: {i}", f"  size: {len(nodes)}", "  files:", *(f"    - {n}" for n in nodes)]
        own = [e for e in edges if e["component"] == nodes[0]]
        if own:
            out += ["  edges:", *(f"    - {e['source']} -> {e['target']}  # {e['kind']}" for e in own)]
    return "\n".join(out)


def symbol(name: str, path: str, start: int, end: int, body: str, line_numbers: bool = False) -> str:
    if line_numbers:
        body = "\n".join(f"{i:>5}  {line}" for i, line in enumerate(body.split("\n"), start))
    return "\n".join(["---", f"symbol: {quoted(name)}", f"file: {path}", f"lines: [{start}, {end}]", "source: |", *("  " + line for line in body.split("\n"))])


def glossary(rows: list[dict], total: int) -> str:
    out = ["---", f"total: {total}"]
    for r in rows:
        users = [u for u in r["used_by"].split(",") if u]
        out += [f"{quoted(r['name'])}:", f"  - src: {r['file_path']}" + (f" [{r['start_line']}, {r['end_line']}]" if r["start_line"] else ""), f"    used_by: {listed(users)}"]
    return "\n".join(out)


def table(title: str, rows: list[dict]) -> str:
    """Any rows, a line each."""
    return "\n".join(["---", f"{title}: {len(rows)}", *("  - " + ", ".join(f"{k}: {quoted(str(v)) if isinstance(v, str) else v}" for k, v in r.items() if v is not None) for r in rows)])


def as_json(rows: list[dict]) -> str:
    """Ordered keys, so that equal results are equal bytes."""
    return json.dumps(rows, ensure_ascii=False, sort_keys=True, default=str)
