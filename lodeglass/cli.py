"""Command line: `python -m lodeglass.cli COMMAND`. Indexing commands work on a source tree, query commands are the tools."""

from __future__ import annotations

import argparse
import inspect
import sys
import time

from pyspark.sql import functions as F

from lodeglass.sources import scan as sc
from lodeglass.sources.config import CONFIG_NAME, TEMPLATE, load_config
from lodeglass.sources.index import incremental_generate
from lodeglass.sources.workspace import packages
from lodeglass.tools import ToolError, Tools, serve

ALIASES = {"lookup": "lookup_export", "exports": "list_exports", "deps": "dependency_graph", "cycles": "dependency_cycles", "search": "search", "read": "read_symbol", "outline": "file_outline", "ls": "list_files", "glossary": "glossary", "similar": "find_similar", "dupes": "dupe_clusters"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodeglass")
    top.add_argument("--root", default=".", help="source tree")
    top.add_argument("--index", help="folder of the index; default ROOT/.lodeglass")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--force", action="store_true")
    for name in ("generate", "validate", "status", "clean", "serve", "watch"):
        p = sub.add_parser(name)
        if name == "generate":
            p.add_argument("--force", action="store_true")
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--no-git", action="store_true")
            p.add_argument("--sha")
        if name == "clean":
            p.add_argument("--drop", action="store_true")
        if name == "watch":
            p.add_argument("--interval", type=float, default=0.3)
            p.add_argument("--rounds", type=int, default=-1)
    for alias, tool in ALIASES.items():
        p = sub.add_parser(alias)
        p.add_argument("--json", action="store_true")
        for name, spec in inspect.signature(getattr(Tools, tool)).parameters.items():
            if name == "self":
                continue
            kind = spec.annotation if isinstance(spec.annotation, str) else str(spec.annotation)
            flag = "--" + name.replace("_", "-")
            if spec.default is inspect.Parameter.empty:
                p.add_argument(name)
            elif isinstance(spec.default, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=spec.default)
            elif isinstance(spec.default, tuple):
                p.add_argument(flag, nargs="*", default=spec.default)
            else:
                p.add_argument(flag, type=int if "int" in kind else float if "float" in kind else str, default=spec.default)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    from lodeglass.plans.store import IndexStore
    from lodeglass.session import local_session

    args = parser().parse_args(argv)
    root = sc.find_root(args.root)
    config = load_config(root)
    if args.command == "init":
        target = root / CONFIG_NAME
        if not target.exists() or args.force:
            target.write_text(TEMPLATE, encoding="utf-8")
        print(f"settings: {target}")
        return 0
    spark = spark or local_session()
    store = IndexStore(spark, args.index or f"file://{root}/.lodeglass")

    def content():
        return sc.scan(spark, f"file://{root}", config, sc.list_local(root, config))

    def generate(force=False, git=True, sha=None):
        counts = incremental_generate(store, content(), force, packages(spark, root))
        if counts.get("reparse") or counts["removed"] or force:
            store.write_meta({"generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **(sc.git_meta(root, sha) if git else {})})
        return counts

    if args.command == "generate":
        if args.dry_run:
            print("\n".join(sc.list_local(root, config)))
        else:
            print(generate(args.force, not args.no_git, args.sha))
    elif args.command == "validate":
        from lodeglass.plans import incremental

        current = content()
        prints = current.select("path", "source_mtime").join(incremental.content_hash(current), "path")
        wrong = incremental.validate(incremental.decide(prints, store.fingerprints()), store.load("files")).orderBy("path").collect()
        print("\n".join(f"{r['path']}: {r['reason']}" for r in wrong) or "up to date")
        return int(bool(wrong))
    elif args.command == "status":
        meta = store.meta()
        print(f"settings: {'found' if (root / CONFIG_NAME).exists() else 'defaults'}\nlanguages: {', '.join(config.languages)}\nfiles: {len(sc.list_local(root, config))} found, {store.load('files').agg(F.count('*')).first()[0]} indexed")
        dirty = {"true": "dirty", "false": "clean"}.get(meta.get("git_dirty"), "unknown")
        print(f"git: {meta.get('git_sha', '')[:12] or 'unknown'} {meta.get('git_branch', 'detached')} {dirty}")
    elif args.command == "clean":
        store.clear(args.drop)
    elif args.command == "watch":
        rounds = args.rounds
        while rounds:
            print(generate(), flush=True)
            rounds -= 1
            if rounds:
                time.sleep(args.interval)
    elif args.command == "serve":
        serve(Tools(store, content().select("path", "text"), config))
    else:
        tool = ALIASES[args.command]
        own = {k: v for k, v in vars(args).items() if k in inspect.signature(getattr(Tools, tool)).parameters}
        try:
            print(Tools(store, content().select("path", "text"), config).run(tool, own, args.json))
        except ToolError as e:
            print(f"ERROR: {e}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
