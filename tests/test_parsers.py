import json

from lodeglass.sources.parsers import call_site, parse_file
from lodeglass.sources.parsers.rust import use_paths
from lodeglass.sources.workspace import discover, strip_jsonc


def names(p):
    return {s.name: s.kind for s in p.exports}


def test_python():
    p = parse_file("a/m.py", "import os.path\nfrom . import x\nfrom ..b import y as z\nfrom q import *\nLIMIT = 3\nlower = 1\n\n@deco\ndef f(a,\n      b):\n    pass\n\nclass P(Protocol):\n    size: int = 0\n    def __init__(self): pass\n    def _hidden(self): pass\n    def run(self): pass\n\ndef _g(): pass\n")
    assert names(p) == {"LIMIT": "const", "f": "fn", "P": "trait", "_g": "fn"}
    assert (p.imports, p.dependencies) == (["os.path", "q"], ["./", "../b"]) and p.named_imports["../b"] == ["y"]
    f = next(s for s in p.exports if s.name == "f")
    assert (f.start, f.end, f.signature) == (8, 11, "def f(a, b)")
    assert {m.name: m.kind for m in p.members} == {"P.size": "field", "P.__init__": "method", "P.run": "method"}
    assert {h.name for h in p.hidden} >= {"lower", "P._hidden"} and p.function_names == ["f"] and "deco" in p.custom["decorators"] and "q" in p.namespace_imports
    listed = parse_file("m.py", "from a import b\n__all__ = ['b', 'c', 'nope']\ndef c(): pass\ndef d(): pass\n")
    assert names(listed) == {"b": "const", "c": "fn", "nope": "const"}
    assert parse_file("m.py", "def (").exports == []


def test_typescript():
    text = """
import React, { useState as s } from 'react';
import type { T } from './types';
import { type A, type B } from './ab';
import * as ns from '../ns';
export { x, y as z } from './xy';
export * from './all';
export default class App extends Base {
  private count = 0;
  #secret: string;
  static async load<T>(id: T): Promise<void> { if (id) { return; } }
  get name(): string { return "class Fake {}"; }
}
export const make = (a: number) => a; // export function not() {}
export async function go(x: number): Promise<string> {
  const state: Map<string, number> = new Map();
  const plain = 1;
  function inner(y: number) { return y; }
  return inner(x) + `${x}`;
}
export interface Shape { area(): number }
export type Id = string | number;
export enum Color { Red }
function quiet() {}
export namespace N { export const q = 1; }
const e = require('express');
"""
    p = parse_file("src/app.ts", text)
    assert names(p) == {"App": "struct", "make": "const", "go": "fn", "Shape": "trait", "Id": "type", "Color": "enum", "N": "const", "x": "const", "z": "const"}
    assert set(p.dependencies) == {"./types", "./ab", "../ns", "./xy", "./all"} and set(p.imports) == {"react", "express"}
    assert [p.dependency_kinds[d] for d in ("./types", "./ab", "./xy")] == ["type-only", "type-only", "runtime"]
    assert p.named_imports["react"] == ["useState", "default"] or set(p.named_imports["react"]) == {"useState", "default"}
    assert set(p.namespace_imports) == {"../ns", "./all"}
    got = {m.name: (m.kind, m.visibility, m.relationship) for m in p.members}
    assert got["App.load"][:2] == ("method", "public") and got["App.count"][1] == "private" and got["App.name"][0] == "method"
    assert got["go.inner"][2] == "nested-fn" and got["go.state"][2] == "closure-state" and "go.plain" not in got
    assert "quiet" in {h.name for h in p.hidden} and p.function_names == ["go"]


def test_rust():
    text = """
use std::collections::{HashMap, hash_map::Entry as E};
use crate::core::Run;
use super::util;
pub use self::inner::Thing;
#[derive(Debug, Clone)]
pub struct Foo<'a> { pub name: &'a str, size: usize }
enum Kind { A, B(u8) }
pub(crate) trait Act { fn act(&self); }
impl<'a> Foo<'a> { pub fn new() -> Self { Foo { name: "}", size: 1 } } fn hide(&self) {} }
impl Act for Foo<'_> { fn act(&self) {} }
pub async fn run() {}
#[test]
fn check() {}
mod inner { pub fn deep() {} }
#[macro_export]
macro_rules! say { () => {} }
"""
    p = parse_file("src/lib.rs", text)
    kinds = names(p)
    assert {k: kinds[k] for k in ("Foo", "Kind", "Act", "run", "check", "inner", "deep", "say", "Thing", "impl Foo", "impl Act for Foo")} == {"Foo": "struct", "Kind": "enum", "Act": "trait", "run": "fn", "check": "test", "inner": "module", "deep": "fn", "say": "macro", "Thing": "module", "impl Foo": "impl", "impl Act for Foo": "impl"}
    assert p.imports == ["std"] and p.dependencies == ["crate::core", "../util"]
    assert {m.name: m.kind for m in p.members} == {"Foo.name": "field", "Foo.size": "field", "Kind.A": "variant", "Kind.B": "variant", "Act.act": "method", "Foo.new": "method", "Foo.hide": "method", "Foo.act": "method"}
    assert next(s for s in p.exports if s.name == "Act").visibility == "crate" and "Clone" in p.custom["derives"]
    assert use_paths("a::{b, c::{self, d as e}, f::*}") == [("a::b", "b"), ("a::c", "c"), ("a::c::d", "e"), ("a::f::*", "*")]


def test_other_languages():
    cases = {
        "a.go": ('package m\nimport (\n\t"fmt"\n\t"example.com/m/x"\n)\nfunc Run(a int) {}\nfunc (s *S) Do() {}\nfunc quiet() {}\ntype S struct { a int }\ntype I interface{}\nconst Max = 1\n', {"Run": "fn", "S": "struct", "I": "trait", "Max": "const"}, ["fmt"], ["example.com/m/x"]),
        "A.java": ("package p;\nimport java.util.List;\n@Service\npublic class A { public int go(int a) { return a; } private void no() {} }\nenum E { X }\n", {"A": "struct", "E": "enum"}, ["java.util"], ["java.util.List"]),
        "a.c": ('#include <stdio.h>\n#include "x.h"\n#define N 3\nstatic int hide(int a) { return a; }\nint show(int a) { return a; }\nstruct P { int a; };\ntypedef unsigned U;\n', {"N": "macro", "show": "fn", "P": "struct", "U": "type"}, ["stdio.h"], ["x.h"]),
        "a.rb": ("require 'json'\nrequire_relative 'b'\nclass C\n  def m\n  end\nend\nmodule M\nend\ndef go(x)\nend\n", {"C": "struct", "M": "module", "go": "fn"}, ["json"], ["./b"]),
        "a.php": ("<?php\nnamespace A;\nuse B\\C;\nrequire 'x.php';\nclass K { public function f() {} private function g() {} }\nfunction top() {}\n", {"K": "struct", "f": "method", "top": "fn"}, ["B"], ["x.php"]),
        "a.swift": ("import UIKit\npublic struct S { }\nfunc quiet() {}\nopen class C {}\npublic func go() {}\n", {"S": "struct", "C": "struct", "go": "fn"}, ["UIKit"], []),
        "a.kt": ("import a.b.c\nclass K { fun m() {} private fun n() {} }\nprivate fun no() {}\nfun yes() {}\nval v = 1\n", {"K": "struct", "yes": "fn", "v": "const"}, ["a.b"], []),
        "a.dart": ("import 'package:flutter/x.dart';\nimport './y.dart';\nclass C {}\nclass _H {}\nvoid go(int a) { }\n", {"C": "struct", "go": "fn"}, ["flutter"], ["./y.dart"]),
        "a.ex": ("defmodule A.B do\n  use GenServer\n  def go(x), do: x\n  defp no(x), do: x\nend\n", {"A.B": "module", "go": "fn"}, ["GenServer"], []),
        "a.lua": ("local x = require('./x')\nrequire 'y'\nfunction M.go()\nend\nlocal function no()\nend\n", {"M.go": "fn"}, ["y"], ["./x"]),
        "a.scala": ("import cats.data\ncase class C(a: Int)\nprivate object P\ntrait T\ndef go = 1\n", {"C": "struct", "T": "trait", "go": "fn"}, ["cats"], []),
        "a.zig": ('const s = @import("std");\nconst l = @import("l.zig");\npub fn go() void {}\nfn no() void {}\npub const N = 1;\n', {"go": "fn", "N": "const"}, ["std"], ["./l.zig"]),
        "A.cs": ("using System.Text;\nnamespace N { public class A { public int Go(int x) { return x; } int No() { return 1; } } public enum E { X } }\n", {"A": "struct", "Go": "method", "E": "enum"}, ["System"], []),
        "a.cpp": ('#include <vector>\nnamespace n { class A { }; struct S { }; }\nint go(int a) { return a; }\nenum class E { X };\n', {"A": "struct", "S": "struct", "go": "fn", "E": "enum"}, ["vector"], []),
    }
    for path, (text, exports, imports, deps) in cases.items():
        p = parse_file(path, text)
        assert (names(p), p.imports, p.dependencies) == (exports, imports, deps), path
    assert {m.name for m in parse_file("A.java", cases["A.java"][0]).members} == {"A.go"}
    assert parse_file("x.unknown", "a") is None


def test_call_sites():
    assert call_site("a.ts", "import { f as g } from './x';\ng(1);", "f") == "direct"
    assert call_site("a.ts", "import * as x from './x';\nx.f(1);", "f") == "namespace"
    assert call_site("a.ts", "import { f } from './x'; // f(1)\nconst s = 'f(1)';", "f") is None
    assert call_site("a.py", "from x import f\nf()", "f") == "direct" and call_site("a.py", "import x\nx.f()", "f") == "namespace" and call_site("a.py", "x = 1", "f") is None
    assert call_site("a.rs", "use crate::x::f;\nfn main() { f(); }", "f") == "direct" and call_site("a.rs", "fn f() {}", "f") is None
    assert call_site("a.ts", "thing.run<T>(1)", "Type.run") == "direct" and call_site("a.ts", "run(1)", "Type.run") is None
    assert call_site("a.go", "x", "f") == "direct" and call_site("a.ts", None, "f") == "direct"


def test_workspaces(tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("Cargo.toml", '[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/out"]\n')
    put("crates/my-core/Cargo.toml", '[package]\nname = "my-core"\n')
    put("crates/out/Cargo.toml", '[package]\nname = "out"\n')
    put("go.work", "go 1.22\nuse (\n  ./svc // the service\n)\n")
    put("svc/go.mod", "module example.com/svc\n")
    put("pyproject.toml", '[project]\nname = "top-py"\n[tool.uv.workspace]\nmembers = ["py/*"]\n')
    put("py/a/pyproject.toml", '[project]\nname = "py-a"\n')
    put("package.json", '{"workspaces": ["ignored/*"]}')
    put("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - '!packages/skip'\n")
    put("packages/a/package.json", '{"name": "@org/a"}')
    put("packages/bare/x.js", "")
    put("packages/skip/package.json", '{"name": "skip"}')
    put("deno.jsonc", '{\n  // root\n  "name": "@d/root",\n}')
    got = discover(tmp_path)
    assert got == [("deno", "@d/root", ""), ("go", "example.com/svc", "svc"), ("js", "@org/a", "packages/a"), ("js", "bare", "packages/bare"), ("python", "py_a", "py/a"), ("python", "top_py", ""), ("rust", "my_core", "crates/my-core")]
    assert json.loads(strip_jsonc('{"a": "//x", /* c */ "b": [1, 2,],}')) == {"a": "//x", "b": [1, 2]}
