"""One query for each grammar: every document becomes a source text in which each of its lines, however many, makes a piece of code.

The length of a line chooses the piece. {i} stands for the line's number and {t} for its letters, digits and spaces. What a piece adds to the
outline is written beside it; where it stands, what the caps leave and what the root counts, SQL works out from the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse.base import MAX_DECLS, MAX_IMPORTS
from ..operators.outline import grammar_decls
from ..sources.tables import read_table


@dataclass(frozen=True)
class Piece:
    text: str
    decls: tuple[tuple[int, int, int, str], ...] = ()  # first row, last row, indent, text; rows from 0
    found: str = ""


@dataclass(frozen=True)
class Source:
    pieces: tuple[Piece, ...]
    head: str = ""
    foot: str = ""
    root: tuple[str, str, str] | None = None  # declaration of the whole text: before and after the number of lines, and after the number one


def _d(*decl) -> tuple:
    return (decl,)


_C_PIECES = (Piece('#include "m{i}.h"\n', found='"m{i}.h"'), Piece("int f{i}(int a)\n{\n  return a; /* {t} } */\n}\n", _d(0, 3, 0, "int f{i}(int a)")))
_JS_PIECES = (
    Piece("import x{i} from './m{i}';\n", found="./m{i}"),
    Piece("function f{i}(a) {\n  return `{t}}`;\n}\n", _d(0, 2, 0, "function f{i}(a)")),
    Piece("// function no() { {t}\n"),
)
SOURCES: dict[str, Source] = {
    "Go": Source(
        (
            Piece('import "m{i}/x"\n', found="m{i}/x"),
            Piece('func F{i}(a int) string {\n\treturn "{t}" // }\n}\n', _d(0, 2, 0, "func F{i}(a int) string")),
            Piece("type T{i} struct {\n\tN int // {t}\n}\n", _d(0, 2, 0, "type T{i} struct")),
            Piece("/* {t}\nfunc no() {\n*/\n"),
        ),
        head="package p\n\n",
    ),
    "Rust": Source(
        (
            Piece("use a::m{i};\n", found="a::m{i}"),
            Piece("pub fn f{i}(n: u8) -> u8 {\n    // {t} }\n    n\n}\n", _d(0, 3, 0, "pub fn f{i}(n: u8) -> u8")),
            Piece("struct S{i} {\n    n: u8, // {t}\n}\n", _d(0, 2, 0, "struct S{i}")),
            Piece("/* fn no() { {t}\n*/\n"),
        )
    ),
    "Python": Source(
        (
            Piece("import m{i}\n", found="m{i}"),
            Piece('def f{i}(a):\n    """{t}\n    def no(): pass"""\n    return a\n', _d(0, 3, 0, "def f{i}(a):")),
            Piece('class C{i}(B):\n    x = "{t}"\n\n    def go(self):\n        return 1\n', ((0, 4, 0, "class C{i}(B):"), (3, 4, 1, "def go(self):"))),
            Piece("# def no(): {t}\n"),
        )
    ),
    "JavaScript": Source((*_JS_PIECES, Piece('class C{i} extends B {\n  go() { return "{t}"; }\n}\n', ((0, 2, 0, "class C{i} extends B"), (1, 1, 1, "go()"))))),
    "TypeScript": Source((*_JS_PIECES, Piece("export interface I{i} {\n  size: number; // {t}\n}\n", ((0, 2, 0, "interface I{i}"), (1, 1, 1, "size: number"))))),
    "TSX": Source((*_JS_PIECES, Piece("export const V{i} = () => {\n  return <div>{t}</div>;\n};\n", _d(0, 2, 0, "const V{i} = () => {")))),
    "Java": Source(
        (
            Piece("import a.M{i};\n", found="a.M{i}"),
            Piece("class C{i} extends D {\n    // {t}\n    int go(int a) {\n        return 1;\n    }\n}\n", ((0, 5, 0, "class C{i} extends D"), (2, 4, 1, "int go(int a)"))),
            Piece("/* class No { {t}\n*/\n"),
        ),
        head="package p;\n",
    ),
    "C": Source((*_C_PIECES, Piece("struct S{i} {\n  int x; // {t}\n};\n", _d(0, 2, 0, "struct S{i}")))),
    "C++": Source((*_C_PIECES, Piece("class V{i} : public B {\n public:\n  int size() const; // {t}\n};\n", ((0, 3, 0, "class V{i} : public B"), (2, 2, 1, "int size() const"))))),
    "Ruby": Source(
        (
            Piece("require 'm{i}'\n", found="m{i}"),
            Piece('def f{i}(a)\n  "{t} end"\nend\n', _d(0, 2, 0, "def f{i}(a)")),
            Piece("class C{i} < B\n  # end {t}\n  def go\n    1\n  end\nend\n", ((0, 5, 0, "class C{i} < B"), (2, 4, 1, "def go"))),
        )
    ),
    "Shell": Source(
        (
            Piece("source m{i}.sh\n", found="m{i}.sh"),
            Piece('f{i}() {\n  echo "{t} }"\n}\n', _d(0, 2, 0, "f{i}()")),
            Piece('V{i}="{t}"\n', _d(0, 0, 0, "V{i}=")),
            Piece("# g() { {t}\n"),
        )
    ),
    "XML": Source(
        (
            Piece("<!-- {t} <no> --><item>v{i}</item>\n", _d(0, 0, 1, "<item> v{i}")),
            Piece('<set>\n<e id="e{i}"/>\n</set>\n', ((0, 2, 1, "<set> (1 child)"), (1, 1, 2, '<e id="e{i}">'))),
        ),
        head="<root>\n",
        foot="</root>\n",
        root=("<root> (", " children)", " child)"),
    ),
    "HTML": Source(
        (
            Piece("<h2>H{i}</h2>\n", _d(0, 0, 0, "<h2> H{i}")),
            Piece('<script src="m{i}.js"></script>\n', _d(0, 0, 0, '<script src="m{i}.js">'), found="m{i}.js"),
            Piece('<main id="m{i}">\n<!-- {t} <no> -->\n<p>P{i}</p>\n</main>\n', ((0, 3, 0, '<main id="m{i}"> (1 child)'), (2, 2, 1, "<p> P{i}"))),
        )
    ),
    "CSS": Source(
        (
            Piece('@import url("m{i}.css");\n', found="m{i}.css"),
            Piece(".a{i}, b {\n  color: red; /* {t} } */\n}\n", _d(0, 2, 0, ".a{i}, b")),
            Piece("@media (max-width: {i}px) {\n  .x { a: b }\n}\n", ((0, 2, 0, "@media (max-width: {i}px)"), (1, 1, 1, ".x"))),
        )
    ),
    "JSON": Source(
        (
            Piece('  "k{i}": {i},\n', _d(0, 0, 1, '"k{i}": {i}')),
            Piece('  "o{i}": {\n    // {t} }\n    "n": [1, "]"]\n  },\n', ((0, 3, 1, '"o{i}": {object, 1 key}'), (2, 2, 2, '"n": [array, 2 items]'))),
        ),
        head="{\n",
        foot="}\n",
        root=("{object, ", " keys}", " key}"),
    ),
    "YAML": Source(
        (
            Piece("k{i}: {i}\n", _d(0, 0, 0, "k{i}: {i}")),
            Piece("m{i}:\n  a: 1 # {t}\n  b:\n  - x\n  - y\n", ((0, 4, 0, "m{i}: {2 keys}"), (1, 1, 1, "a: 1"), (2, 4, 1, "b: [2 items]"))),
            Piece("# k: {t}\n"),
        )
    ),
    "TOML": Source(
        (
            Piece("[a{i}]\nx = 1 # {t}\n", ((0, 1, 0, "[a{i}]"), (1, 1, 1, "x"))),
            Piece("[[l{i}]]\ny = [\n  1, # {t} ]\n]\n", ((0, 3, 0, "[[l{i}]]"), (1, 3, 1, "y"))),
        )
    ),
}


def _name(fmt: str) -> str:
    return "lines_" + {"C++": "cpp"}.get(fmt, fmt.lower())


def _query(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    source = SOURCES[fmt]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read_table(spark, sf_dir, "documents")
        texts = F.array(*[F.lit(p.text) for p in source.pieces])

        def piece(line, i):
            with_number = F.replace(F.get(texts, F.length(line) % len(source.pieces)), F.lit("{i}"), i.cast("string"))
            return F.replace(with_number, F.lit("{t}"), F.regexp_replace(line, "[^A-Za-z0-9 ]", ""))

        body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), piece), "")
        files = docs.select(F.col("doc_id").alias("file_id"), F.lit(fmt).alias("fmt"), F.concat(F.lit(source.head), body, F.lit(source.foot)).alias("text"))
        out = grammar_decls(files, 2)
        each = out.select(F.col("file_id").alias("doc_id"), F.array_join("imports", "|").alias("imports"), "truncated", F.explode("decls").alias("d"))
        return each.select("doc_id", "imports", "truncated", (F.col("d.start") + 1).alias("first"), (F.col("d.end") + 1).alias("last"), F.col("d.indent").cast("long").alias("indent"), F.col("d.text").alias("text"))

    return run


def line_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {_name(fmt): _query(fmt) for fmt in SOURCES}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def line_sql() -> dict[str, str]:
    out = {}
    for fmt, source in SOURCES.items():
        rows = [(k, n, *d) for k, p in enumerate(source.pieces) for n, d in enumerate(p.decls)]
        values = ", ".join(f"({k}, {n}, {a}, {b}, {indent}, {_quoted(t)})" for k, n, a, b, indent, t in rows)
        heights = " ".join(f"WHEN {k} THEN {p.text.count(chr(10))}" for k, p in enumerate(source.pieces))
        found = " ".join(f"WHEN {k} THEN {_quoted(p.found)}" for k, p in enumerate(source.pieces) if p.found) or "WHEN -1 THEN ''"
        head = source.head.count("\n")
        fill = "replace({}, '{{i}}', CAST(i AS VARCHAR))".format
        root = ""
        if source.root:
            before, after, after_one = map(_quoted, source.root)
            rows_in_all = f"{head} + sum(h) + {source.foot.count(chr(10))}"
            root = f"UNION ALL SELECT doc_id, -1, 0, 1, {rows_in_all}, 0, {before} || count(*) || CASE WHEN count(*) = 1 THEN {after_one} ELSE {after} END FROM s GROUP BY doc_id"
        out[_name(fmt)] = f"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS i, length(ls[i]) % {len(source.pieces)} AS k FROM x, unnest(range(1, len(ls) + 1)) AS u(i)),
s AS (SELECT *, CASE k {heights} END AS h FROM l),
p AS (SELECT *, {head} + 1 + sum(h) OVER (PARTITION BY doc_id ORDER BY i) - h AS r, CASE k {found} END AS m FROM s),
v(k, n, a, b, indent, t) AS (VALUES {values}),
d AS (SELECT doc_id, i, n, r + a AS f, r + b AS e, indent, {fill('t')} AS t FROM p JOIN v USING (k) {root}),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, n) AS nth, count(*) OVER (PARTITION BY doc_id) AS total FROM d),
g AS (SELECT doc_id, list({fill('m')} ORDER BY i) FILTER (m IS NOT NULL) AS ms FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(CASE WHEN len(ms) <= {MAX_IMPORTS} THEN ms ELSE list_append(ms[1:{MAX_IMPORTS}], '(+' || (len(ms) - {MAX_IMPORTS}) || ' more)') END, '|'), '') AS imports, total > {MAX_DECLS} AS truncated,
       CAST(f AS BIGINT) AS first, CAST(e AS BIGINT) AS last, CAST(indent AS BIGINT) AS indent, t AS text
FROM c JOIN g USING (doc_id) WHERE nth <= {MAX_DECLS}"""
    return out
