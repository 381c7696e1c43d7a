"""One query for each grammar: every document becomes a small source text of that language, which is outlined.

{a} stands for the document's id and {b} for its length. What the outline must hold is written beside each text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.outline import grammar_decls
from ..sources.tables import read_table

#: format: text, imports, declarations (first row, last row, indent, text); depth 2.
SAMPLES: dict[str, tuple[str, str, list[tuple[int, int, int, str]]]] = {
    "Go": (
        'package p{a}\n\nimport (\n\t"fmt"\n\t"net/p{b}"\n)\n\ntype Box{a} struct {\n\tN int\n}\n\nfunc (b *Box{a}) Grow(n int) error {\n\treturn nil // }\n}\n\nconst Limit = {b}\n',
        "fmt|net/p{b}",
        [(8, 10, 0, "type Box{a} struct"), (12, 14, 0, "func (b *Box{a}) Grow(n int) error"), (16, 16, 0, "const Limit = {b}")],
    ),
    "Rust": (
        "use std::io;\nuse crate::m{b}::*;\n\n#[derive(Clone)]\npub struct B{a}<'x> {\n    n: &'x str,\n}\n\nimpl<'x> B{a}<'x> {\n    pub fn new(n: &'x str) -> Self {\n        B{a} { n }\n    }\n}\n\nmod inner {\n    pub fn f{b}() {}\n}\n",
        "std::io|crate::m{b}::*",
        [(5, 7, 0, "pub struct B{a}<'x>"), (9, 13, 0, "impl<'x> B{a}<'x>"), (10, 12, 1, "pub fn new(n: &'x str) -> Self"), (15, 17, 0, "mod inner"), (16, 16, 1, "pub fn f{b}()")],
    ),
    "Python": (
        'import os, m{b} as m\nfrom a.b{a} import (\n    c,\n)\n\n\n@deco\nclass B{a}(Base):\n    """def no(): pass"""\n\n    @property\n    def size(self) -> int:\n        return {b}\n\n\nasync def run(a, b={b}):\n    pass\n',
        "os|m{b}|a.b{a}",
        [(7, 13, 0, "class B{a}(Base):"), (11, 13, 1, "def size(self) -> int:"), (16, 17, 0, "async def run(a, b={b}):")],
    ),
    "JavaScript": (
        "import x from './m{b}';\n\nexport function f{a}(a, b) {\n  return `}${a}`;\n}\nconst N = {b};\nexport const g = (x) => {\n  return x;\n};\nclass C{a} extends B {\n  go() { return 1; }\n}\n",
        "./m{b}",
        [(3, 5, 0, "function f{a}(a, b)"), (7, 9, 0, "const g = (x) => {"), (10, 12, 0, "class C{a} extends B"), (11, 11, 1, "go()")],
    ),
    "TypeScript": (
        "import { q } from \"m{b}\";\n\nexport interface I{a} {\n  size: number;\n  run(x: string): void;\n}\n\nexport abstract class C{a} {\n  private n = {b};\n  async go<T>(x: T): Promise<T> {\n    return x;\n  }\n}\n\nexport type T{a} = string | number;\nenum E{a} { A, B }\n",
        "m{b}",
        [(3, 6, 0, "interface I{a}"), (4, 4, 1, "size: number"), (5, 5, 1, "run(x: string): void"), (8, 13, 0, "abstract class C{a}"), (9, 9, 1, "private n = {b}"), (10, 12, 1, "async go<T>(x: T): Promise<T>"), (15, 15, 0, "type T{a} = string | number;"), (16, 16, 0, "enum E{a}")],
    ),
    "TSX": (
        "import React from 'react';\n\nexport const V{a} = () => {\n  return <div>{b}</div>;\n};\n\nexport default function App(p: P{b}) {\n  return <V{a} />;\n}\n",
        "react",
        [(3, 5, 0, "const V{a} = () => {"), (7, 9, 0, "function App(p: P{b})")],
    ),
    "Java": (
        'package p;\n\nimport java.util.List;\nimport static a.B{b}.*;\n\npublic class C{a} extends D {\n    private final int n = {b};\n\n    @Override\n    public String toString() {\n        return "}";\n    }\n\n    enum E { X, Y }\n}\n',
        "java.util.List|a.B{b}.*",
        [(6, 15, 0, "public class C{a} extends D"), (7, 7, 1, "private final int n = {b}"), (9, 12, 1, "@Override public String toString()"), (14, 14, 1, "enum E")],
    ),
    "C": (
        '#include <stdio.h>\n#include "m{b}.h"\n\ntypedef struct {\n  int x;\n} T{a};\n\nstruct P{a} { int y; };\nstatic int n{a} = {b};\nint add(int a, int b);\n\nint add(int a, int b)\n{\n  return a + b; /* } */\n}\n',
        '<stdio.h>|"m{b}.h"',
        [(4, 6, 0, "typedef struct {"), (8, 8, 0, "struct P{a}"), (9, 9, 0, "static int n{a} = {b}"), (10, 10, 0, "int add(int a, int b)"), (12, 15, 0, "int add(int a, int b)")],
    ),
    "C++": (
        "#include <vector>\n\nnamespace n{a} {\ntemplate <typename T>\nclass V{b} : public B {\n public:\n  int size() const;\n private:\n  int x_;\n};\n}\n\nint main() { return {b}; }\n",
        "<vector>",
        [(3, 11, 0, "namespace n{a}"), (4, 10, 1, "template class V{b} : public B"), (7, 7, 2, "int size() const"), (9, 9, 2, "int x_"), (13, 13, 0, "int main()")],
    ),
    "Ruby": (
        "require 'json'\nrequire_relative \"m{b}\"\n\nmodule M{a}\n  class C{b} < B\n    def go(x)\n      [1].each do |y|\n        puts y if x\n      end\n    end\n  end\nend\n\ndef top(a)\n  a\nend\n",
        "json|m{b}",
        [(4, 12, 0, "module M{a}"), (5, 11, 1, "class C{b} < B"), (6, 10, 2, "def go(x)"), (14, 16, 0, "def top(a)")],
    ),
    "Shell": (
        "#!/bin/bash\nsource lib{b}.sh\nFOO{a}=bar\nexport API_KEY=\"s e c\"\n\nmain{a}() {\n  local x=1\n  if true; then echo \"}\"; fi\n}\n\nfunction helper {\n  Y=2\n}\n",
        "lib{b}.sh",
        [(3, 3, 0, "FOO{a}="), (4, 4, 0, "API_KEY="), (6, 9, 0, "main{a}()"), (11, 13, 0, "helper()")],
    ),
    "XML": (
        '<?xml version="1.0"?>\n<root id="r{a}">\n  <item>v{b}</item>\n  <password>hunter{a}</password>\n  <set>\n    <e token="t{b}x"/>\n  </set>\n</root>\n',
        "",
        [(2, 8, 0, '<root id="r{a}"> (3 children)'), (3, 3, 1, "<item> v{b}"), (4, 4, 1, "<password> <redacted>"), (5, 7, 1, "<set> (1 child)"), (6, 6, 2, '<e token="<redacted>">')],
    ),
    "HTML": (
        '<!DOCTYPE html>\n<html>\n<head>\n<title>T{a}</title>\n<link rel="s" href="m{b}.css">\n<script src="a.js"></script>\n</head>\n<body>\n<main id="m{a}">\n<h1>H{b}</h1>\n<img src="i.png">\n</main>\n</body>\n</html>\n',
        "m{b}.css|a.js",
        [(4, 4, 0, "<title> T{a}"), (5, 5, 0, '<link href="m{b}.css">'), (6, 6, 0, '<script src="a.js">'), (9, 12, 0, '<main id="m{a}"> (2 children)'), (10, 10, 1, "<h1> H{b}"), (11, 11, 1, '<img src="i.png">')],
    ),
    "CSS": (
        '@import url("r{b}.css");\n/* { */\n.a{a}, b > c {\n  color: red;\n}\n@media (max-width: {b}px) {\n  .x { a: b }\n}\n@font-face { a: b }\n',
        "r{b}.css",
        [(3, 5, 0, ".a{a}, b > c"), (6, 8, 0, "@media (max-width: {b}px)"), (7, 7, 1, ".x")],
    ),
    "Markdown": (
        "# Title {a}\n\ntext\n\n## Part {b}\n```\n# no\n```\n### Deep\n## Next\nUnder {a}\n===\nlast\n",
        "",
        [(1, 10, 0, "# Title {a}"), (5, 9, 1, "## Part {b}"), (9, 9, 2, "### Deep"), (10, 10, 1, "## Next"), (11, 13, 0, "Under {a}")],
    ),
    "JSON": (
        '{\n  "id": {a},\n  "inner": { // c\n    "ok": true,\n    "apiKey": "k{b}"\n  },\n  "list": [1, [2], {b}],\n}\n',
        "",
        [(1, 8, 0, "{object, 3 keys}"), (2, 2, 1, '"id": {a}'), (3, 6, 1, '"inner": {object, 2 keys}'), (4, 4, 2, '"ok": true'), (5, 5, 2, '"apiKey": <redacted>'), (7, 7, 1, '"list": [array, 3 items]')],
    ),
    "YAML": (
        "id: {a}\ninner:\n  name: n{b} # c\n  list:\n  - 1\n  - k: 2\n    v: 3\nflow: {x: 1, y: [2, 3]}\ntoken: t{b}x\nempty:\n",
        "",
        [(1, 1, 0, "id: {a}"), (2, 7, 0, "inner: {2 keys}"), (3, 3, 1, "name: n{b}"), (4, 7, 1, "list: [2 items]"), (8, 8, 0, "flow: {2 keys}"), (8, 8, 1, "x: 1"), (8, 8, 1, "y: [2 items]"), (9, 9, 0, "token: <redacted>"), (10, 10, 0, "empty:")],
    ),
    "TOML": (
        'top = {a}\n\n[a.b{b}]\nx = """\nmulti = 1\n"""\ny = [\n  1,\n]\n[[list]]\nsecret = "s{b}"\n',
        "",
        [(1, 1, 0, "top"), (3, 9, 0, "[a.b{b}]"), (4, 6, 1, "x"), (7, 9, 1, "y"), (10, 11, 0, "[[list]]"), (11, 11, 1, "secret")],
    ),
}


def _name(fmt: str) -> str:
    return "outline_" + {"C++": "cpp"}.get(fmt, fmt.lower())


def _query(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    sample = SAMPLES[fmt][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read_table(spark, sf_dir, "documents")
        text = F.replace(F.replace(F.lit(sample), F.lit("{a}"), F.col("doc_id").cast("string")), F.lit("{b}"), F.col("n_chars").cast("string"))
        out = grammar_decls(docs.select(F.col("doc_id").alias("file_id"), F.lit(fmt).alias("fmt"), text.alias("text")), 2)
        each = out.select(F.col("file_id").alias("doc_id"), F.array_join("imports", "|").alias("imports"), F.explode("decls").alias("d"))
        return each.select("doc_id", "imports", (F.col("d.start") + 1).alias("first"), (F.col("d.end") + 1).alias("last"), F.col("d.indent").cast("long").alias("indent"), F.col("d.text").alias("text"))

    return run


def grammar_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {_name(fmt): _query(fmt) for fmt in SAMPLES}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def grammar_sql() -> dict[str, str]:
    out = {}
    for fmt, (_, imports, decls) in SAMPLES.items():
        fill = "replace(replace({}, '{{a}}', CAST(doc_id AS VARCHAR)), '{{b}}', CAST(n_chars AS VARCHAR))".format
        values = ", ".join(f"({a}, {b}, {i}, {_quoted(t)})" for a, b, i, t in decls)
        out[_name(fmt)] = f"SELECT doc_id, {fill(_quoted(imports))} AS imports, CAST(f AS BIGINT) AS first, CAST(l AS BIGINT) AS last, CAST(n AS BIGINT) AS indent, {fill('t')} AS text FROM documents, (VALUES {values}) AS v(f, l, n, t)"
    return out
