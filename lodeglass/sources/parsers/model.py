"""What a parser finds in a file, and helpers that parsers share."""

from __future__ import annotations

import bisect
import json
import re
from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    start: int
    end: int
    signature: str | None = None
    visibility: str | None = "public"
    kind: str | None = None
    parent: str | None = None
    relationship: str | None = None


@dataclass
class Parsed:
    exports: list[Symbol] = field(default_factory=list)
    members: list[Symbol] = field(default_factory=list)
    hidden: list[Symbol] = field(default_factory=list)  # top-level, not exported
    imports: list[str] = field(default_factory=list)
    dependencies: list[str] = field(default_factory=list)
    dependency_kinds: dict[str, str] = field(default_factory=dict)
    named_imports: dict[str, list[str]] = field(default_factory=dict)
    namespace_imports: list[str] = field(default_factory=list)
    function_names: list[str] = field(default_factory=list)
    custom: dict[str, object] = field(default_factory=dict)
    loc: int = 0

    def add_import(self, name: str) -> None:
        if name and name not in self.imports:
            self.imports.append(name)

    def add_dependency(self, name: str, type_only: bool = False) -> None:
        """Repeated specifiers merge: type-only only if all are."""
        if not name:
            return
        if name not in self.dependencies:
            self.dependencies.append(name)
            self.dependency_kinds[name] = "type-only" if type_only else "runtime"
        elif not type_only:
            self.dependency_kinds[name] = "runtime"

    def add_named(self, source: str, names: list[str]) -> None:
        own = self.named_imports.setdefault(source, [])
        own += [n for n in names if n not in own]

    def finish(self, text: str) -> Parsed:
        """Equal top-level names become `name @ line N`; of equal members the first stays; everything by line."""
        self.loc = len(text.splitlines())
        count: dict[str, int] = {}
        for s in self.exports:
            count[s.name] = count.get(s.name, 0) + 1
        for s in self.exports:
            if count[s.name] > 1:
                s.name = f"{s.name} @ line {s.start}"
        self.exports.sort(key=lambda s: s.start)
        seen: set[str] = set()
        self.members = [s for s in self.members if not (s.name in seen or seen.add(s.name))]
        return self

    def custom_json(self) -> dict[str, str]:
        return {k: json.dumps(v) for k, v in self.custom.items() if v}


class Source:
    """A text with its comments and strings blanked out, so that patterns and brackets see code only; offsets stay."""

    def __init__(self, text: str, line_comment: str = "//", block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`", multiline: str = "`"):
        self.text = text
        parts = []
        if block:
            parts.append(re.escape(block[0]) + r".*?(?:" + re.escape(block[1]) + r"|\Z)")
        if line_comment:
            parts.append(r"(?:" + "|".join(re.escape(x) for x in line_comment.split()) + r")[^\n]*")
        for q in quotes:
            parts.append(q + (r"(?:\\.|[^\\" + q + r"])*" if q in multiline else r"(?:\\.|[^\\\n" + q + r"])*") + q + "?")
        blank = lambda m: re.sub(r"[^\n]", " ", m[0])
        self.code = re.sub("|".join(parts), blank, text, flags=re.S)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.depth = self._depths()

    def _depths(self) -> list[int]:
        """Offsets at which the depth of braces changes, and the depth from there on."""
        self.changes, self.levels, level = [0], [0], 0
        for m in re.finditer(r"[{}]", self.code):
            level = level + 1 if m[0] == "{" else max(0, level - 1)
            self.changes.append(m.end())
            self.levels.append(level)
        return self.levels

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)

    def level(self, offset: int) -> int:
        """Braces open at an offset."""
        return self.levels[bisect.bisect_right(self.changes, offset) - 1]

    def block(self, offset: int) -> tuple[int, int]:
        """(start of the body, end) of the construct at `offset`: up to its closing brace, or the end of its statement (body -1)."""
        depth = 0
        for m in re.finditer(r"[{}()\[\];\n]", self.code[offset:]):
            c, at = m[0], offset + m.start()
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "{" and depth <= 0:
                return at, self.close(at)
            elif c == "}" and depth <= 0:
                return -1, at
            elif c == ";" and depth <= 0:
                return -1, at + 1
        return -1, len(self.code)

    def close(self, brace: int) -> int:
        """The offset after the brace that closes the one at `brace`."""
        level = self.level(brace)
        i = bisect.bisect_right(self.changes, brace + 1)
        while i < len(self.changes):
            if self.levels[i] <= level:
                return self.changes[i]
            i += 1
        return len(self.code)

    def signature(self, start: int, body: int, end: int) -> str:
        """The text up to the body, white space made single."""
        raw = self.text[start : body if body >= 0 else end]
        return " ".join(raw.split()).rstrip(" ;{=")

    def symbol(self, name: str, start: int, kind: str | None, visibility: str | None = "public", end: int | None = None, **more) -> Symbol:
        body, stop = self.block(start) if end is None else (-1, end)
        return Symbol(name, self.line(start), self.line(max(start, stop - 1)), self.signature(start, body, stop), visibility, kind, **more)
