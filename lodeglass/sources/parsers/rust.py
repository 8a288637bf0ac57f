"""Rust, by patterns over code without comments and strings."""

from __future__ import annotations

import re

from lodeglass.sources.parsers.model import Parsed, Source, Symbol

_ITEM = re.compile(r"(?:^|(?<=[\s;}{\]]))((?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:async\s+|unsafe\s+|const\s+(?=fn|unsafe|async|extern)|extern\s+(?=fn)\s*)*)(fn|struct|enum|trait|mod|const|static|type|union)\s+(?:mut\s+)?([A-Za-z_]\w*)")
_MACRO = re.compile(r"(#\[macro_export\]\s*)?\bmacro_rules!\s*([A-Za-z_]\w*)")
_IMPL = re.compile(r"(?:^|(?<=[\s;}\]]))(?:unsafe\s+)?impl\b\s*(<[^{;]*?>\s*)?(?:(?!for\b)([^{;]*?)\s+for\s+)?([^{;]*?)\s*(?:where\b[^{]*)?\{")
_USE = re.compile(r"(?:^|(?<=[\s;}]))(pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+);")
_KINDS = {"fn": "fn", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "mod": "module", "const": "const", "static": "const", "type": "type"}


def _visibility(head: str) -> str:
    if "pub" not in head:
        return "private"
    return "crate" if "(" in head else "public"


def use_paths(tree: str) -> list[tuple[str, str]]:
    """(path, name in scope) of each leaf of a use tree; globs have name `*`."""
    tree = tree.strip()
    brace = tree.find("{")
    if brace < 0:
        path, _, alias = tree.partition(" as ")
        path = re.sub(r"\s+", "", path)
        return [(path, (alias.strip() or path.split("::")[-1]))] if path else []
    prefix, out, depth, run = re.sub(r"\s+", "", tree[:brace]), [], 0, ""
    for c in tree[brace + 1 : tree.rfind("}")] + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            for path, name in use_paths(run):
                out.append((prefix.rstrip(":") if path == "self" else prefix + path, prefix.rstrip(":").split("::")[-1] if name == "self" else name))
            run = ""
        else:
            run += c
    return out


def _dependency(path: str) -> str | None:
    """`crate::…` stays, `super::x` becomes `../x`; a closing CamelCase part goes."""
    parts = path.split("::")
    if parts[0] not in ("crate", "super"):
        return None
    while len(parts) > 1 and (parts[-1] == "*" or parts[-1][:1].isupper()):
        parts.pop()
    if parts[0] == "crate":
        return "::".join(parts) if len(parts) > 1 else None
    ups = 0
    while parts and parts[0] == "super":
        ups, parts = ups + 1, parts[1:]
    return "../" * ups + "/".join(parts) if parts else None


def parse(text: str, path: str) -> Parsed:
    src = Source(re.sub(r"(?<![\w'])'(?=[a-z_]\w*\b(?!'))", " ", text), quotes='"', multiline='"')
    src.text = text
    out, code = Parsed(), src.code
    modules = [(m.start(), src.close(src.block(m.start())[0])) for m in _ITEM.finditer(code) if m[2] == "mod" and src.block(m.start())[0] >= 0]
    inside = lambda at: sum(a < at < b for a, b in modules)
    binary = path.endswith("main.rs") or "/bin/" in f"/{path}"
    tops: dict[str, Symbol] = {}
    for m in _ITEM.finditer(code):
        if src.level(m.start(2)) != inside(m.start(2)):
            continue
        attrs = code[max(0, code.rfind("\n\n", 0, m.start())) : m.start()]
        kind = "test" if m[2] == "fn" and re.search(r"#\[\s*(?:\w+::)?test\b[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*$", attrs) else _KINDS[m[2]]
        symbol = src.symbol(m[3], m.start(1) if m[1].strip() else m.start(2), kind, _visibility(m[1]))
        out.exports.append(symbol)
        tops.setdefault(m[3], symbol)
        if m[2] == "fn" and "pub" in m[1] and not inside(m.start(2)):
            out.function_names.append(m[3])
        body, end = src.block(m.start(2))
        if body >= 0 and m[2] in ("struct", "enum", "trait"):
            _inner(src, m[2], m[3], body, end, _visibility(m[1]), out)
    for m in _MACRO.finditer(code):
        out.exports.append(src.symbol(m[2], m.start(), "macro", "public" if m[1] else "private"))
    for m in _IMPL.finditer(code):
        target = re.sub(r"<.*", "", m[3]).strip().split("::")[-1]
        name = f"impl {' '.join(m[2].split())} for {target}" if m[2] else f"impl {target}"
        brace = m.end() - 1
        out.exports.append(src.symbol(name, m.start(), "impl", "private", end=src.close(brace)))
        if target in tops and not binary:
            level = src.level(brace + 1)
            for f in _ITEM.finditer(code, brace + 1, src.close(brace)):
                if f[2] == "fn" and src.level(f.start(2)) == level:
                    symbol = src.symbol(f"{target}.{f[3]}", f.start(1) if f[1].strip() else f.start(2), "method", "public" if m[2] else _visibility(f[1]), parent=target)
                    out.members.append(symbol)
                    if symbol.visibility == "private":
                        out.hidden.append(symbol)
    for m in _USE.finditer(code):
        for use, name in use_paths(m[2]):
            root = use.split("::")[0]
            dep = _dependency(use)
            if dep:
                out.add_dependency(dep)
            elif root not in ("crate", "super", "self"):
                out.add_import(root)
            source = "::".join(use.split("::")[:-1])
            if name == "*":
                out.namespace_imports += [source] if source not in out.namespace_imports else []
            elif source:
                out.add_named(source, [use.split("::")[-1]])
            if m[1] and name != "*":
                line = src.line(m.start())
                out.exports.append(Symbol(name, line, line, " ".join(m[0].split()), _visibility(m[1]), "module"))
    derives = [d.strip() for m in re.findall(r"#\[derive\(([^)]*)\)", code) for d in m.split(",") if d.strip()]
    traits = [" ".join(m[2].split()) for m in _IMPL.finditer(code) if m[2]]
    out.custom = {"unsafe_blocks": len(re.findall(r"\bunsafe\s*\{", code)), "derives": list(dict.fromkeys(derives)), "trait_impls": list(dict.fromkeys(traits)), "lifetimes": list(dict.fromkeys(re.findall(r"'[a-z_]\w*\b(?!')", text))), "async_functions": re.findall(r"\basync\s+fn\s+(\w+)", code), "function_names": out.function_names}
    return out.finish(text)


def _inner(src: Source, what: str, name: str, body: int, end: int, visibility: str, out: Parsed) -> None:
    level = src.level(body + 1)
    if what == "trait":
        for f in _ITEM.finditer(src.code, body + 1, end):
            if f[2] == "fn" and src.level(f.start(2)) == level:
                out.members.append(src.symbol(f"{name}.{f[3]}", f.start(2), "method", visibility, parent=name))
        return
    pattern = r"(?:^|(?<=[,{\s]))((?:pub(?:\s*\([^)]*\))?\s+)?)([a-z_]\w*)\s*:(?!:)" if what == "struct" else r"(?:^|(?<=[,{\s\]]))()([A-Z]\w*)(?=\s*[,({=}]|\s*$)"
    for f in re.finditer(pattern, src.code[body + 1 : end - 1]):
        at = body + 1 + f.start(2)
        depth = src.code[body + 1 : at].count("(") - src.code[body + 1 : at].count(")")
        if src.level(at) == level and depth == 0:
            stop = re.search(r",|\n|$", src.code[at : end - 1])
            out.members.append(src.symbol(f"{name}.{f[2]}", at, "field" if what == "struct" else "variant", _visibility(f[1]) if what == "struct" else visibility, end=at + stop.start(), parent=name))


def calls(text: str, symbol: str, method: bool) -> str | None:
    code = Source(re.sub(r"(?<![\w'])'(?=[a-z_]\w*\b(?!'))", " ", text), quotes='"', multiline='"').code
    if method:
        return "direct" if re.search(rf"(?:\.|::)\s*{re.escape(symbol)}\s*(?:::<[^>]*>)?\(", code) else None
    names = {symbol}
    for m in _USE.finditer(code):
        names |= {name for use, name in use_paths(m[2]) if use.split("::")[-1] == symbol and name != "*"}
    if any(re.search(rf"(?<![\w.:]){re.escape(n)}\s*(?:::<[^>]*>)?[(!]", re.sub(r"\bfn\s+\w+", "", code)) for n in names):
        return "direct"
    return "namespace" if re.search(rf"::\s*{re.escape(symbol)}\s*(?:::<[^>]*>)?\(", code) else None
