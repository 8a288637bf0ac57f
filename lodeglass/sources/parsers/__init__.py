"""Parsers by file extension."""

from __future__ import annotations

from lodeglass.sources.parsers import generic, python, rust, typescript
from lodeglass.sources.parsers.model import Parsed

_MODULES = {"py": python, "rs": rust, "ts": typescript, "tsx": typescript, "js": typescript, "jsx": typescript, **{ext: generic for ext in generic.EXTENSIONS}}
SUPPORTED = tuple(sorted(_MODULES))


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""


def parse_file(path: str, text: str) -> Parsed | None:
    """None for extensions without a parser."""
    module = _MODULES.get(extension(path))
    return module.parse(text, path) if module else None


def call_site(path: str, text: str | None, symbol: str) -> str | None:
    """How a file calls `symbol` or `Type.method`: direct, namespace or None. Unreadable and unsupported files count as direct callers."""
    module = _MODULES.get(extension(path))
    name = symbol.rsplit(".", 1)[-1]
    if module is None or text is None or not name.isidentifier():
        return "direct"
    return module.calls(text, name, "." in symbol)
