"""The other languages: one scanner, driven by a table of forms for each."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from lodeglass.sources.parsers.model import Parsed, Source

_ID = r"[A-Za-z_]\w*"


@dataclass(frozen=True)
class Language:
    """`forms`: (pattern, kind), group `n` is the name; `level`: depths of braces at which exports lie (None: any); `members`: forms inside exported
    types, as members if `member_style`, else as further exports; `shown`: by name and head; `uses`: (pattern, what to do with its first group)."""

    forms: tuple[tuple[str, str], ...]
    uses: tuple[tuple[str, Callable[[Parsed, str], None]], ...] = ()
    members: tuple[tuple[str, str], ...] = ()
    member_style: bool = False
    level: int | None = 0
    shown: Callable[[str, str], bool] = lambda name, head: True
    comment: str = "//"
    block: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    ends: str | None = None  # pattern of block ends for languages without braces
    custom: dict[str, str] = field(default_factory=dict)


def _import(out: Parsed, x: str) -> None:
    out.add_import(x)


def _depend(out: Parsed, x: str) -> None:
    out.add_dependency(x)


def _by_dot(out: Parsed, x: str) -> None:
    out.add_dependency(x) if x.startswith(".") or "/" in x else out.add_import(x)


def _two_parts(out: Parsed, x: str) -> None:
    out.add_import(".".join(x.split(".")[:2]))


def _java(out: Parsed, x: str) -> None:
    _two_parts(out, x)
    out.add_dependency(x)


def _root(sep: str) -> Callable[[Parsed, str], None]:
    return lambda out, x: out.add_import(x.lstrip("\\").split(sep)[0])


def _dart(out: Parsed, x: str) -> None:
    if x.startswith("package:"):
        out.add_import(x[8:].split("/")[0])
    elif x.startswith("dart:"):
        out.add_import(x)
    else:
        out.add_dependency(x if x.startswith(".") else "./" + x)


def _go(out: Parsed, x: str) -> None:
    out.add_dependency(x) if "." in x.split("/")[0] else out.add_import(x)


_C_USES = ((r"#[ \t]*include[ \t]*<([^>\n]+)>", _import), (r'#[ \t]*include[ \t]*"([^"\n]+)"', _depend))
_MODS = r"(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp|partial|readonly|async|override|virtual|unsafe|extern|new|open|inline|data|inner|annotation|companion|const|lateinit|suspend|operator|infix|tailrec|external|internal|case|implicit|lazy|fileprivate|mutating|class|required|convenience|indirect|dynamic|weak)\s+)*"

LANGUAGES: dict[str, Language] = {
    "go": Language(
        forms=((rf"^func\s+(?:\([^)]*\)\s*)?(?P<n>{_ID})", "fn"), (rf"^type\s+(?P<n>{_ID})\s+struct\b", "struct"), (rf"^type\s+(?P<n>{_ID})\s+interface\b", "trait"), (rf"^type\s+(?P<n>{_ID})", "type"), (rf"^(?:const|var)\s+(?P<n>{_ID})", "const"), (rf"(?:(?<=[(\n])[ \t]+)(?P<n>[A-Z]\w*)(?:\s+[\w.*\[\]]+)?\s*=", "const")),
        uses=((r'^import\s+(?:[\w.]+\s+)?"([^"\n]+)"', _go), (r'^[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*$', _go)),
        shown=lambda name, head: name[:1].isupper() and not head.strip().startswith("func ("), quotes='"`',
    ),
    "java": Language(
        forms=((rf"(?P<h>{_MODS})(?:class|record)\s+(?P<n>{_ID})", "struct"), (rf"(?P<h>{_MODS})@?interface\s+(?P<n>{_ID})", "trait"), (rf"(?P<h>{_MODS})enum\s+(?P<n>{_ID})", "enum")),
        members=((rf"public\s+{_MODS}(?:<[^>{{]*>\s*)?[\w<>\[\],.? ]*?\b(?P<n>{_ID})\s*\(", "method"),), member_style=True,
        uses=((r"^\s*import\s+(?:static\s+)?([\w.]+)", _java),), custom={"annotations": r"@([A-Z]\w*)"},
    ),
    "c": Language(
        forms=((rf"^(?P<h>(?:[\w*]+[ \t\n]+)+?[*\s]*)(?P<n>{_ID})\s*\([^;{{}}]*\)\s*\{{", "fn"), (rf"^(?:typedef\s+)?struct\s+(?P<n>{_ID})\s*\{{", "struct"), (rf"^(?:typedef\s+)?enum\s+(?P<n>{_ID})\s*\{{", "enum"), (rf"^typedef\b[^;{{]*?\b(?P<n>{_ID})\s*;", "type"), (rf"\}}\s*(?P<n>{_ID})\s*;", "type"), (rf"^[ \t]*#[ \t]*define[ \t]+(?P<n>{_ID})", "macro")),
        uses=_C_USES, shown=lambda name, head: "static" not in head.split(name)[0].split(), quotes='"\'',
        custom={"macros": r"^[ \t]*#[ \t]*define[ \t]+(\w+)", "typedefs": r"\btypedef\b[^;{]*?\b(\w+)\s*;"},
    ),
    "cpp": Language(
        forms=((rf"^[ \t]*(?P<h>(?:[\w:*&<>,]+[ \t]+)+[*&]*)(?P<n>{_ID})\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|->\s*[\w:<>]+|\s)*\{{", "fn"), (rf"(?<!enum )\bclass\s+(?:\w+\s+)?(?P<n>{_ID})\s*(?:final\s*)?(?::[^{{;]*)?\{{", "struct"), (rf"\bstruct\s+(?P<n>{_ID})\s*(?::[^{{;]*)?\{{", "struct"), (rf"\benum\s+(?:class\s+)?(?P<n>{_ID})", "enum")),
        uses=_C_USES, level=None, custom={"namespaces": r"\bnamespace\s+([\w:]+)"}, shown=lambda name, head: name not in ("if", "for", "while", "switch", "return", "catch"),
    ),
    "cs": Language(
        forms=((rf"public\s+{_MODS}(?:class|record)\s+(?P<n>{_ID})", "struct"), (rf"public\s+{_MODS}interface\s+(?P<n>{_ID})", "trait"), (rf"public\s+{_MODS}struct\s+(?P<n>{_ID})", "struct"), (rf"public\s+{_MODS}enum\s+(?P<n>{_ID})", "enum"), (rf"public\s+{_MODS}[\w<>\[\],.?]+\s+(?P<n>{_ID})\s*(?:<[^>]*>)?\(", "method")),
        uses=((r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", _root(".")),), level=None, custom={"namespaces": r"\bnamespace\s+([\w.]+)", "attributes": r"^\s*\[([A-Z]\w*)"},
    ),
    "rb": Language(
        forms=((rf"^class\s+(?P<n>[\w:]+)", "struct"), (rf"^module\s+(?P<n>[\w:]+)", "module"), (r"^def\s+(?:self\.)?(?P<n>\w+[?!=]?)", "fn")), uses=((r"^\s*require\s+['\"]([^'\"]+)", _import), (r"^\s*require_relative\s+['\"]([^'\"]+)", lambda out, x: out.add_dependency(x if x.startswith(".") else "./" + x))),
        shown=lambda name, head: not name.startswith("_"), comment="#", block=("=begin", "=end"), ends=r"^end\b", level=None, custom={"mixins": r"^\s*(?:include|extend|prepend)\s+([\w:]+)"},
    ),
    "php": Language(
        forms=((rf"^\s*(?:abstract\s+|final\s+|readonly\s+)*class\s+(?P<n>{_ID})", "struct"), (rf"^\s*interface\s+(?P<n>{_ID})", "trait"), (rf"^\s*trait\s+(?P<n>{_ID})", "trait"), (rf"^\s*enum\s+(?P<n>{_ID})", "enum"), (rf"^\s*function\s+&?(?P<n>{_ID})", "fn"), (rf"^\s*const\s+(?P<n>{_ID})", "const")),
        members=((rf"public\s+(?:static\s+|final\s+|abstract\s+)*function\s+&?(?P<n>{_ID})", "method"),),
        uses=((r"^use\s+(?:function\s+|const\s+)?([\w\\]+)", _root("\\")), (r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)", _depend)), comment="// #", custom={"namespaces": r"^namespace\s+([\w\\]+)", "traits_used": r"^\s+use\s+([\w\\]+)"},
    ),
    "swift": Language(
        forms=((rf"(?:public|open)\s+{_MODS}class\s+(?P<n>{_ID})", "struct"), (rf"(?:public|open)\s+{_MODS}(?:struct|actor)\s+(?P<n>{_ID})", "struct"), (rf"(?:public|open)\s+{_MODS}protocol\s+(?P<n>{_ID})", "trait"), (rf"(?:public|open)\s+{_MODS}enum\s+(?P<n>{_ID})", "enum"), (rf"(?:public|open)\s+{_MODS}func\s+(?P<n>{_ID})", "fn"), (rf"(?:public|open)\s+{_MODS}(?:let|var)\s+(?P<n>{_ID})", "const"), (rf"(?:public|open)\s+typealias\s+(?P<n>{_ID})", "type")),
        uses=((r"^\s*(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+)?(\w+)", _import),), custom={"protocols": r"\bprotocol\s+(\w+)", "extensions": r"\bextension\s+(\w+)"},
    ),
    "kt": Language(
        forms=((rf"(?P<h>{_MODS})interface\s+(?P<n>{_ID})", "trait"), (rf"(?P<h>{_MODS})enum\s+class\s+(?P<n>{_ID})", "enum"), (rf"(?P<h>{_MODS})(?<!enum )class\s+(?P<n>{_ID})", "struct"), (rf"(?P<h>{_MODS})object\s+(?P<n>{_ID})", "struct"), (rf"(?P<h>{_MODS})fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<n>{_ID})\s*\(", "fn"), (rf"(?P<h>{_MODS})va[lr]\s+(?P<n>{_ID})", "const"), (rf"(?P<h>{_MODS})typealias\s+(?P<n>{_ID})", "type")),
        members=((rf"(?P<h>{_MODS})fun\s+(?:<[^>]*>\s*)?(?P<n>{_ID})\s*\(", "method"),), member_style=True, uses=((r"^\s*import\s+([\w.]+)", _two_parts),), shown=lambda name, head: not re.search(r"\b(?:private|internal|protected)\b", head),
        custom={"data_classes": r"\bdata\s+class\s+(\w+)", "sealed_classes": r"\bsealed\s+(?:class|interface)\s+(\w+)", "companion_objects": r"\bcompanion\s+(object)"},
    ),
    "dart": Language(
        forms=((rf"^(?:abstract\s+|base\s+|final\s+|sealed\s+)*class\s+(?P<n>{_ID})", "struct"), (rf"^(?:base\s+)?mixin\s+(?:class\s+)?(?P<n>{_ID})", "trait"), (rf"^enum\s+(?P<n>{_ID})", "enum"), (rf"^extension\s+(?P<n>{_ID})\s+on", "impl"), (rf"^typedef\s+(?P<n>{_ID})", "type"), (rf"^(?:[\w<>?,]+\s+)(?P<n>{_ID})\s*\([^;{{]*\)\s*(?:async\*?\s*)?(?:\{{|=>)", "fn"), (rf"^(?:final|const|var|late)\s+(?:[\w<>?,]+\s+)?(?P<n>{_ID})\s*=", "const")),
        uses=((r"^\s*(?:import|export)\s+['\"]([^'\"]+)", _dart),), shown=lambda name, head: not name.startswith("_"), custom={"mixins": r"\bmixin\s+(\w+)", "extensions": r"\bextension\s+(\w+)"},
    ),
    "ex": Language(
        forms=((r"^\s*defmodule\s+(?P<n>[\w.]+)", "module"), (r"^\s*defprotocol\s+(?P<n>[\w.]+)", "trait"), (r"^\s*def\s+(?P<n>\w+[?!]?)", "fn"), (r"^\s*defdelegate\s+(?P<n>\w+[?!]?)", "fn"), (r"^\s*defmacro\s+(?P<n>\w+[?!]?)", "macro"), (r"^\s*defguard\s+(?P<n>\w+)", "fn")),
        uses=((r"^\s*(?:use|import|alias|require)\s+([\w.]+)", _root(".")),), comment="#", block=None, quotes='"', ends=r"^\s*end\b", level=None, custom={"macros": r"^\s*defmacro\s+(\w+)", "protocols": r"^\s*defprotocol\s+([\w.]+)", "behaviours": r"^\s*@behaviour\s+([\w.]+)"},
    ),
    "lua": Language(forms=((r"^function\s+(?P<n>[\w.:]+)\s*\(", "fn"), (r"^(?P<n>[\w.]+)\s*=\s*function\b", "fn")), uses=((r"\brequire\s*\(?\s*['\"]([^'\"]+)", _by_dot),), comment="--", block=("--[[", "]]"), ends=r"^end\b", level=None),
    "scala": Language(
        forms=((rf"^(?P<h>{_MODS})class\s+(?P<n>{_ID})", "struct"), (rf"^(?P<h>{_MODS})trait\s+(?P<n>{_ID})", "trait"), (rf"^(?P<h>{_MODS})object\s+(?P<n>{_ID})", "struct"), (rf"^(?P<h>{_MODS})def\s+(?P<n>{_ID})", "fn"), (rf"^(?P<h>{_MODS})va[lr]\s+(?P<n>{_ID})", "const")),
        uses=((r"^\s*import\s+(\w+)", _import),), shown=lambda name, head: not re.search(r"\b(?:private|protected)\b", head), custom={"case_classes": r"\bcase\s+class\s+(\w+)", "implicits": r"\bimplicit\s+(?:val|def|class|object)\s+(\w+)", "annotations": r"^\s*@(\w+)"},
    ),
    "zig": Language(forms=((rf"^pub\s+(?:inline\s+|extern\s+|export\s+)*fn\s+(?P<n>{_ID})", "fn"), (rf"^pub\s+(?:const|var)\s+(?P<n>{_ID})", "const")), uses=((r"@import\(\s*\"([^\"]+)\"", lambda out, x: out.add_dependency(x if x.startswith(".") else "./" + x) if x.endswith(".zig") or x.startswith(".") else out.add_import(x)),), block=None, custom={"comptime_blocks": r"\b(comptime)\s*\{", "test_blocks": r"^test\s+\"([^\"]+)\""}),
}
EXTENSIONS = {"go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "hh": "cpp", "cxx": "cpp", "hxx": "cpp", "cs": "cs", "rb": "rb", "php": "php", "swift": "swift", "kt": "kt", "kts": "kt", "dart": "dart", "ex": "ex", "exs": "ex", "lua": "lua", "scala": "scala", "sc": "scala", "zig": "zig"}


def parse(text: str, path: str) -> Parsed:
    lang = LANGUAGES[EXTENSIONS[path.rsplit(".", 1)[-1]]]
    out, src = Parsed(), Source(text, lang.comment, lang.block, lang.quotes)
    seen: set[tuple[str, int]] = set()
    for pattern, kind in lang.forms:
        for m in re.finditer(pattern, src.code, re.M):
            name, at = m["n"], m.start("n")
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            line = src.line(start)
            if (lang.level is not None and src.level(start) != lang.level) or (name, src.line(at)) in seen:
                continue
            if not lang.shown(name, m[0]):
                out.hidden.append(src.symbol(name, start, kind, "non_exported"))
                continue
            seen.add((name, src.line(at)))
            if lang.ends:  # up to the `end` of the same indentation
                indent = len(re.match(r"[ \t]*", text[src.starts[line - 1] :])[0])
                stop = next((e.end() for e in re.finditer(rf"^[ \t]{{{indent}}}end\b", src.code[at:], re.M)), None)
                symbol = src.symbol(name, start, kind, end=at + stop if stop else at)
                symbol.signature = " ".join(text[start : text.find("\n", start) if "\n" in text[start:] else None].split())
            else:
                symbol = src.symbol(name, start, kind)
            out.exports.append(symbol)
            if kind == "fn":
                out.function_names.append(name)
            brace = src.block(start)[0]
            if lang.members and brace >= 0 and kind in ("struct", "trait", "enum"):
                level = src.level(brace + 1)
                for inner, inner_kind in lang.members:
                    for f in re.finditer(inner, src.code[brace : src.close(brace)], re.M):
                        place = brace + f.start()
                        if src.level(brace + f.start("n")) == level and lang.shown(f["n"], f[0]):
                            own = src.symbol(f"{name}.{f['n']}" if lang.member_style else f["n"], place, inner_kind, parent=name)
                            (out.members if lang.member_style else out.exports).append(own)
    for pattern, use in lang.uses:
        for m in re.finditer(pattern, text, re.M):
            if src.code[m.start() + len(m[0]) - len(m[0].lstrip())] != " ":
                use(out, m[1])
            elif lang.comment != "//" or m[0].lstrip().startswith('"'):
                use(out, m[1])
    out.custom = {k: list(dict.fromkeys(re.findall(p, text, re.M))) for k, p in lang.custom.items()}
    return out.finish(text)


def calls(text: str, symbol: str, method: bool) -> str | None:
    return "direct"  # no verifier for these languages: users are kept
