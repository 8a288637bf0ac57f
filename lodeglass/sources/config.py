"""Settings: a TOML file, then environment variables, then validation."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

CONFIG_NAME = ".lodeglass.toml"
IGNORE_NAME = ".lodeglassignore"

# Defaults that results depend on.
DEFAULT_MAX_LINES = 100_000
DEFAULT_LANGUAGES = ("ts", "tsx", "js", "jsx", "py", "rs", "go", "java", "cpp", "hpp", "cc", "hh", "cxx", "hxx", "cs", "rb", "php", "c", "h", "zig", "lua", "scala", "sc", "swift", "kt", "kts", "dart", "ex", "exs")
DEFAULT_TEST_PATHS = ("/e2e/", "/test/", "/tests/", "/tests.rs", "/test.rs", "/spec/", "/__tests__/")
DEFAULT_TEST_SUFFIXES = (".spec.ts", ".test.ts", ".e2e-spec.ts", ".spec.js", ".test.js", "_test.go", "_test.rs", "_tests.rs", ".spec.tsx", ".test.tsx")


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...] = DEFAULT_LANGUAGES
    max_lines: int = DEFAULT_MAX_LINES
    exclude: tuple[str, ...] = ()
    test_paths: tuple[str, ...] = DEFAULT_TEST_PATHS
    test_suffixes: tuple[str, ...] = DEFAULT_TEST_SUFFIXES

    @property
    def own_test_patterns(self) -> bool:
        """Whether the user named test patterns; the languages' conventions then do not apply."""
        return (self.test_paths, self.test_suffixes) != (DEFAULT_TEST_PATHS, DEFAULT_TEST_SUFFIXES)


def load_config(root: str | Path, env: dict[str, str] | None = None) -> Config:
    """Unknown keys or broken TOML give the defaults; empty language lists do as well."""
    env = dict(os.environ) if env is None else env
    config, path = Config(), Path(root) / CONFIG_NAME
    if path.is_file():
        try:
            raw = tomllib.loads(path.read_text(encoding="utf-8"))
            known = {f.name for f in fields(Config)}
            if set(raw) <= known:
                config = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        except (tomllib.TOMLDecodeError, UnicodeDecodeError, TypeError):
            config = Config()
    split = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())
    if env.get("LODEGLASS_MAX_LINES", "").isdigit():
        config = replace(config, max_lines=int(env["LODEGLASS_MAX_LINES"]))
    if "LODEGLASS_LANGUAGES" in env:
        config = replace(config, languages=split(env["LODEGLASS_LANGUAGES"]))
    if "LODEGLASS_EXCLUDE" in env:
        config = replace(config, exclude=split(env["LODEGLASS_EXCLUDE"]))
    return config if config.languages else replace(config, languages=DEFAULT_LANGUAGES)


TEMPLATE = f"""# Settings of the code index; every key may be left out.
max_lines = {DEFAULT_MAX_LINES}
languages = [{", ".join(f'"{x}"' for x in DEFAULT_LANGUAGES)}]
exclude = []
"""
