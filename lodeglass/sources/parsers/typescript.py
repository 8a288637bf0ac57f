"""TypeScript and JavaScript, by patterns over code without comments and strings."""

from __future__ import annotations

import re

from lodeglass.sources.parsers.model import Parsed, Source, Symbol

_NAME = r"[A-Za-z_$][\w$]*"
#: Exported forms in order; the first form that names something decides its kind.
_FORMS = (
    (rf"export\s+(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*({_NAME})", "fn"),
    (rf"export\s+(?:declare\s+)?(?:const|let|var)\s+({_NAME})", "const"),
    (rf"export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+({_NAME})", "struct"),
    (rf"export\s+(?:default\s+)?(?:declare\s+)?interface\s+({_NAME})", "trait"),
    (rf"export\s+(?:declare\s+)?type\s+({_NAME})\s*[=<]", "type"),
    (rf"export\s+default\s+({_NAME})\s*;?\s*(?:\n|$)", "const"),
    (rf"export\s+(?:declare\s+)?(?:const\s+)?enum\s+({_NAME})", "enum"),
    (rf"export\s+\*\s+as\s+({_NAME})", "const"),
    (rf"export\s+(?:declare\s+)?(?:namespace|module)\s+({_NAME})", "const"),
)
_LIST = re.compile(r"export\s+(type\s+)?\{([^}]*)\}")
_TOP = re.compile(rf"(?:^|[;}}\n])[ \t]*((?:async\s+)?function\s*\*?\s*({_NAME})|(?:abstract\s+)?class\s+({_NAME})|(?:const|let|var)\s+({_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{_NAME}\s*=>))")
_IMPORT = re.compile(r"\b(import|export)\b(?!\s*\()\s*(type\b(?!\s*,|\s+from))?([^;'\"`()=]*?)(?:\bfrom\s*)?(['\"])([^'\"\n]+)\4")
_DYNAMIC = re.compile(r"\b(?:require|import)\s*\(\s*(['\"])([^'\"\n]+)\1\s*\)")
_MEMBER = re.compile(rf"((?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set|accessor)\s+)*)\*?\s*(#?{_NAME})\s*[?!]?\s*(?=([(<])|[:=;\n}}])")
_TEST = re.compile(r"(?:^|[;\n{}])\s*(?:describe|it|test)(?:\.\w+)*\s*\(\s*(['\"`])((?:\\.|(?!\1).)*)\1")
_WORDS = frozenset("if for while switch return catch function new typeof await yield throw else do super import export const let var".split())


def _members(src: Source, cls: str, brace: int, out: Parsed) -> None:
    at, end = brace + 1, src.close(brace) - 1
    level = src.level(brace + 1)
    while at < end:
        m = _MEMBER.search(src.code, at, end)
        if not m:
            break
        head, name = m[1], m[2]
        if src.level(m.start(2)) != level or name in _WORDS or not re.search(r"[{};\n]\s*$|^\s*$", src.code[brace + 1 : m.start()].rstrip(" \t") or ""):
            at = m.end(2)
            continue
        body, stop = src.block(m.start(2))
        method = bool(m[3])
        stop = min(stop, end)
        if not method:
            body, stop = -1, min(x for x in (src.code.find(";", m.end(2)), src.code.find("\n", m.end(2)), stop) if x >= 0) if src.code[m.end(2) : m.end(2) + 1] != "=" else stop
        visible = "private" if "private" in head or name.startswith("#") else "protected" if "protected" in head else "public"
        symbol = Symbol(f"{cls}.{name.lstrip('#')}", src.line(m.start()), src.line(max(m.start(), stop - 1)), src.signature(m.start() + len(m[0]) - len(m[0].lstrip()), body, stop), visible, "method" if method else "field", cls)
        out.members.append(symbol)
        if visible != "public":
            out.hidden.append(symbol)
        at = max(stop, m.end(2))


def _nested(src: Source, outer: str, brace: int, out: Parsed) -> None:
    """Functions directly inside a function, and what its prologue keeps for them."""
    level, end = src.level(brace + 1), src.close(brace) - 1
    first = end
    for m in re.finditer(rf"(?:async\s+)?function\s*\*?\s*({_NAME})", src.code[brace:end]):
        if src.level(brace + m.start()) == level:
            first = min(first, brace + m.start())
            out.members.append(src.symbol(f"{outer}.{m[1]}", brace + m.start(), "fn", "non_exported", parent=outer, relationship="nested-fn"))
    for m in re.finditer(rf"\b(?:const|let|var)\s+({_NAME})\s*(:[^=;\n]+)?(?:=\s*(new\b|[^;\n]*\(|[^;\n]*\bas\b))?", src.code[brace:first]):
        if first < end and src.level(brace + m.start()) == level and (m[2] or m[3]):
            out.members.append(src.symbol(f"{outer}.{m[1]}", brace + m.start(), "const", "non_exported", parent=outer, relationship="closure-state"))


def parse(text: str, path: str) -> Parsed:
    out, src = Parsed(), Source(text)
    code = src.code
    seen: set[str] = set()
    for form, kind in _FORMS:
        for m in re.finditer(form, code):
            if m[1] in seen or src.level(m.start()) or m[1] in ("function", "class", "async", "abstract", "new"):
                continue
            seen.add(m[1])
            symbol = src.symbol(m[1], m.start(), kind)
            out.exports.append(symbol)
            if kind == "fn":
                out.function_names.append(m[1])
            brace, _ = src.block(m.start())
            if kind == "struct" and brace >= 0:
                _members(src, m[1], brace, out)
    for m in _LIST.finditer(code):
        for item in m[2].split(","):
            words = item.replace("type ", "").split()
            name = words[-1] if words else ""
            if name and name not in seen:
                seen.add(name)
                out.exports.append(src.symbol(name, m.start(), "const", end=m.end()))
    for m in _TOP.finditer(code):
        if src.level(m.start(1)):
            continue
        name = m[2] or m[3] or m[4]
        brace, _ = src.block(m.start(1))
        if m[2] and brace >= 0:
            _nested(src, name, brace, out)
        if name not in seen and not re.search(r"\bexport\s+(?:default\s+)?$", code[: m.start(1)]):
            out.hidden.append(src.symbol(name, m.start(1), "struct" if m[3] else "fn", "non_exported"))
        elif name in seen and m[3] and brace >= 0 and not any(s.parent == name for s in out.members):
            _members(src, name, brace, out)
    for m in re.finditer(rf"\bexport\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_NAME})", code):
        brace, _ = src.block(m.start())
        if brace >= 0 and src.level(m.start()) == 0:
            _nested(src, m[1], brace, out)
    for m in _IMPORT.finditer(text):
        if code[m.start() : m.start() + 6] not in ("import", "export"):
            continue
        _import_clause(out, m[1], bool(m[2]), m[3].strip(), m[5])
    for m in _DYNAMIC.finditer(text):
        if code[m.start()] != " ":
            _edge(out, m[2], False)
    out.exports += [Symbol(m[2], src.line(m.start(1)), src.line(src.block(m.start(1))[1] - 1), None, "non_exported", "test") for m in _TEST.finditer(text) if m[2] not in seen and not (seen.add(m[2]))]
    decorators = re.findall(rf"(?<![\w$])@({_NAME})", code)
    out.custom = {"decorators": list(dict.fromkeys(decorators)), "function_names": out.function_names}
    return out.finish(text)


def _edge(out: Parsed, source: str, type_only: bool) -> None:
    out.add_dependency(source, type_only) if source.startswith((".", "/")) else out.add_import(source)


def _import_clause(out: Parsed, word: str, type_word: bool, clause: str, source: str) -> None:
    braces = re.search(r"\{([^}]*)\}", clause)
    items = [x.strip() for x in braces[1].split(",") if x.strip()] if braces else []
    rest = re.sub(r"\{[^}]*\}", "", clause).replace(",", " ").split()
    all_types = bool(items) and all(x.startswith("type ") for x in items) and not rest
    _edge(out, source, type_word or all_types)
    names = [re.split(r"\s+as\s+", x.removeprefix("type ").strip())[0] for x in items]
    if names:
        out.add_named(source, names)
    if "*" in clause and (word == "import" or not names) and source not in out.namespace_imports and source not in out.named_imports:
        out.namespace_imports.append(source)
    elif word == "import" and rest and rest[0] not in ("*", "type") and "*" not in clause:
        out.add_named(source, ["default"])


def calls(text: str, symbol: str, method: bool) -> str | None:
    """As for Python: direct calls, by alias or by namespace."""
    code = Source(text).code
    if method:
        return "direct" if re.search(rf"\.\s*{re.escape(symbol)}\s*(?:<[^>\n]*>)?\(", code) else None
    names, spaces = {symbol}, set()
    for m in _IMPORT.finditer(text):
        for item in re.findall(r"\{([^}]*)\}", m[3]):
            names |= {x.split()[-1] for x in item.split(",") if x.split()[:1] == [symbol]}
        spaces |= set(re.findall(rf"\*\s+as\s+({_NAME})", m[3]))
    if any(re.search(rf"(?<![\w$.])(?<!function ){re.escape(n)}\s*(?:<[^>\n]*>)?\(", code) for n in names):
        return "direct"
    return "namespace" if any(re.search(rf"(?<![\w$.]){re.escape(s)}\s*\.\s*{re.escape(symbol)}\s*\(", code) for s in spaces) else None
