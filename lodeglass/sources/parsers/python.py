"""Python, by its own grammar."""

from __future__ import annotations

import ast

from lodeglass.sources.parsers.model import Parsed, Symbol


def _visibility(name: str) -> str:
    return "private" if name.startswith("_") and not name.startswith("__") else "public"


def _span(node: ast.AST) -> tuple[int, int]:
    first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
    return first, node.end_lineno or node.lineno


def _signature(lines: list[str], node: ast.AST) -> str:
    first, body = node.lineno, getattr(node, "body", None)
    last = max(first, body[0].lineno - 1) if body and body[0].lineno > first else first
    text = " ".join(" ".join(lines[first - 1 : last]).split())
    head = text.rsplit(":", 1)[0] if body and ":" in text else text
    return head.strip()


def _kind(node: ast.AST) -> str:
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return "test" if node.name.startswith("test_") else "fn"
    if isinstance(node, ast.ClassDef):
        bases = {b.attr if isinstance(b, ast.Attribute) else getattr(b, "id", getattr(getattr(b, "value", None), "id", "")) for b in node.bases}
        return "trait" if bases & {"Protocol", "ABC"} else "struct"
    return "const"


def _targets(node: ast.AST) -> list[str]:
    targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
    return [t.id for t in targets if isinstance(t, ast.Name)]


def relative_specifier(level: int, module: str | None) -> str:
    """One dot is `./`, n dots are n - 1 times `../`; dots in the module become `/`."""
    return ("./" if level == 1 else "../" * (level - 1)) + (module or "").replace(".", "/")


def parse(text: str, path: str) -> Parsed:
    out, lines = Parsed(), text.splitlines()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out.finish(text)
    top: dict[str, ast.AST] = {}
    imported: dict[str, int] = {}
    listed: list[str] | None = None
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            top[node.name] = node
            if not isinstance(node, ast.ClassDef) and not node.name.startswith("_"):
                out.function_names.append(node.name)
        for name in _targets(node):
            if name == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                listed = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            elif name != "__all__":
                top.setdefault(name, node)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                out.add_import(a.name)
                out.namespace_imports += [a.name] if a.name not in out.namespace_imports else []
                imported[(a.asname or a.name).split(".")[0]] = node.lineno
        elif isinstance(node, ast.ImportFrom):
            source = relative_specifier(node.level, node.module) if node.level else node.module or ""
            out.add_dependency(source) if node.level else out.add_import(source)
            for a in node.names:
                if a.name == "*":
                    out.namespace_imports += [source] if source not in out.namespace_imports else []
                else:
                    out.add_named(source, [a.name])
                    imported[a.asname or a.name] = node.lineno
    for name in listed if listed is not None else top:
        node = top.get(name)
        if node is None:
            line = imported.get(name, 0)
            out.exports.append(Symbol(name, line, line, None, "public", "const"))
        elif listed is not None or isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) or name[0].isupper() or name.isupper():
            out.exports.append(Symbol(name, *_span(node), _signature(lines, node), _visibility(name), _kind(node)))
    shown = {s.name for s in out.exports}
    out.hidden = [Symbol(n, *_span(x), _signature(lines, x), "non_exported", _kind(x)) for n, x in top.items() if n not in shown]
    for cls in (n for n in tree.body if isinstance(n, ast.ClassDef)):
        for node in cls.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                private = node.name.startswith("_") and node.name != "__init__"
                if private and node.name.startswith("__") and node.name.endswith("__"):
                    continue
                target = out.hidden if private else out.members
                if cls.name in shown or private:
                    target.append(Symbol(f"{cls.name}.{node.name}", *_span(node), _signature(lines, node), "private" if private else "public", "method", cls.name))
            elif cls.name in shown:
                out.members += [Symbol(f"{cls.name}.{n}", *_span(node), _signature(lines, node), _visibility(n), "field", cls.name) for n in _targets(node)]
    decorators = [ast.unparse(d).split("(")[0] for n in ast.walk(tree) for d in getattr(n, "decorator_list", [])]
    out.custom = {"decorators": list(dict.fromkeys(decorators)), "function_names": out.function_names}
    return out.finish(text)


def calls(text: str, symbol: str, method: bool) -> str | None:
    """`direct` if the file calls the symbol (for methods by attribute), `namespace` if only through a module, None if not or unreadable."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return "direct"
    aliases, found = {symbol}, None
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            aliases |= {a.asname for a in node.names if a.name == symbol and a.asname}
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Attribute) and f.attr == symbol:
                if method:
                    return "direct"
                found = "namespace"
            elif isinstance(f, ast.Name) and f.id in aliases and not method:
                return "direct"
    return found
