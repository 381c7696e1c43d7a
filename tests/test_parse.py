import random
import string

import pytest

from skelmap.functions.formats import GRAMMARS
from skelmap.functions.parse import MAX_DECLS, parse
from skelmap.plans.grammar_queries import SAMPLES


def rows(fmt, text, depth=1, **options):
    out = parse(fmt, text, depth, **options)
    return out.imports, [(a + 1, b + 1, i, t) for a, b, i, t in out.decls]


@pytest.mark.parametrize("fmt", SAMPLES)
def test_samples(fmt):
    text, imports, decls = SAMPLES[fmt]
    fill = lambda s: s.replace("{a}", "7").replace("{b}", "123")
    got, found = rows(fmt, fill(text), 2)
    assert "|".join(got) == fill(imports)
    assert found == [(a, b, i, fill(t)) for a, b, i, t in decls]


@pytest.mark.parametrize("fmt", SAMPLES)
def test_depth_bounds_the_indent(fmt):
    text = SAMPLES[fmt][0]
    whole = rows(fmt, text, 8)[1]
    for depth in (0, 1, 2):
        assert rows(fmt, text, depth)[1] == [d for d in whole if d[2] <= depth]


@pytest.mark.parametrize("fmt", SAMPLES)
def test_broken_input_is_borne(fmt):
    rng = random.Random(fmt)
    text = SAMPLES[fmt][0]
    for _ in range(60):
        s = list(text)
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(len(s))
            s[at : at + rng.randrange(3)] = rng.choice(list("{}[]()<>\"'`#/*\n\\:;=-") + [""] + list(string.ascii_letters[:3]))
        t = "".join(s)
        n = len(t.split("\n"))
        for a, b, i, x in parse(fmt, t[: rng.randrange(len(t) + 1)], 3).decls:
            assert 0 <= a <= b < n + 1 and 0 <= i <= 3 and len(x) <= 201


@pytest.mark.parametrize("fmt", SAMPLES)
def test_empty(fmt):
    assert rows(fmt, "") == ([], []) and rows(fmt, "\n\n") == ([], [])


MANY = {
    "Go": "func f{}() {{}}\n", "Rust": "fn f{}() {{}}\n", "Python": "def f{}():\n    pass\n", "JavaScript": "function f{}() {{}}\n", "Java": "class C{} {{}}\n", "C": "int f{}(void) {{ return 0; }}\n",
    "Ruby": "def f{}\nend\n", "Shell": "f{}() {{\n  :\n}}\n", "CSS": ".a{} {{ x: y }}\n", "Markdown": "# h{}\n", "YAML": "k{}: 1\n", "TOML": "k{} = 1\n", "HTML": "<p>{}</p>\n",
}


@pytest.mark.parametrize("fmt", MANY)
def test_declarations_are_capped(fmt):
    out = parse(fmt, "".join(MANY[fmt].format(i) for i in range(550)), 1)
    assert len(out.decls) == MAX_DECLS and out.truncated
    few = parse(fmt, "".join(MANY[fmt].format(i) for i in range(500)), 1)
    assert len(few.decls) == 500 and not few.truncated


#: fmt: a declaration, and an import that stands after more of them than are kept
LATE = {
    "CSS": (".a {{ x: y }}\n", '@import url("late");\n'),
    "JavaScript": ("function f{}() {{}}\n", "import x from 'late';\n"),
    "TSX": ("const V{} = () => <b/>;\n", "import x from 'late';\n"),
    "Rust": ("fn f{}() {{}}\n", "use late;\n"),
    "TypeScript": ("interface I{} {{ a: b }}\n", "import x from 'late';\n"),
    "Go": ("func f{}() {{}}\n", 'import "late"\n'),
    "Java": ("class C{} {{ int go() {{ return 1; }} }}\n", "import late;\n"),
    "Ruby": ("def f{}\nend\n", "require 'late'\n"),
    "Shell": ("f{}() {{\n  :\n}}\n", "source late\n"),
}


@pytest.mark.parametrize("fmt", LATE)
def test_imports_are_found_after_the_last_declaration_that_is_kept(fmt):
    piece, late = LATE[fmt]
    out = parse(fmt, "".join(piece.format(i) for i in range(MAX_DECLS + 1)) + late, 2)
    assert out.imports == ["late"] and len(out.decls) == MAX_DECLS and out.truncated


#: fmt: a declaration that is open when the cap is reached, a part of it, its end, and its row in the outline
OPEN = {
    "JSON": ("{\n", '"k{}": 1,\n', "}\n", (1, 602, 0, "{object, 600 keys}")),
    "TOML": ("[t]\n", "k{} = 1\n", "", (1, 601, 0, "[t]")),
    "Ruby": ("class C\n", "def f{}; end\n", "end\n", (1, 602, 0, "class C")),
}


@pytest.mark.parametrize("fmt", OPEN)
def test_declarations_that_are_open_at_the_cap_get_their_end(fmt):
    head, part, foot, row = OPEN[fmt]
    text = head + "".join(part.format(i) for i in range(600)) + foot
    out = parse(fmt, text, 2)
    assert rows(fmt, text, 2)[1][0] == row and len(out.decls) == MAX_DECLS and out.truncated


def test_wide_header_is_clipped():
    (_, _, _, text), = rows("Go", "func f(" + ", ".join(f"a{i} int" for i in range(400)) + ") {\n}\n")[1]
    assert len(text) == 201 and text.endswith("…")


def test_imports_are_distinct_and_capped():
    imports, _ = rows("Python", "".join(f"import m{i % 45}\n" for i in range(90)))
    assert imports == [f"m{i}" for i in range(40)] + ["(+5 more)"]


# --- secrets must not come out -------------------------------------------------------------------------------------------

SECRET = "hunter2-swordfish"
LEAKS = {
    "JSON": f'{{"password": "{SECRET}", "db": {{"url": "pg://u:{SECRET}@h"}}, "aws_secret": ["{SECRET}"]}}',
    "YAML": f"password: {SECRET}\ndb:\n  url: pg://u:{SECRET}@h\n  apiKey: '{SECRET}'\nflow: {{token: {SECRET}}}\n",
    "TOML": f'password = "{SECRET}"\n[a]\nx = "{SECRET}"\n',
    "XML": f'<a><password>{SECRET}</password><add key="k" connectionString="Server=x;Password={SECRET}"/><u>pg://u:{SECRET}@h</u></a>',
    "Shell": f"export API_KEY={SECRET}\nTOKEN='{SECRET}'\n",
    "Go": f'const apiKey = "{SECRET}"\n',
    "Rust": f'const TOKEN: &str = "{SECRET}";\n',
    "C": f'static const char *password = "{SECRET}";\n',
    "HTML": f'<a href="https://u:{SECRET}@h/x">go</a>',
}


@pytest.mark.parametrize("fmt", LEAKS)
def test_nothing_leaks(fmt):
    imports, decls = rows(fmt, LEAKS[fmt], 8)
    assert decls and SECRET not in str(decls) and SECRET not in str(imports)


def test_numbers_under_sensitive_keys_are_shown():
    assert rows("JSON", '{"password": 12345}')[1][1] == (1, 1, 1, '"password": 12345')


# --- languages -----------------------------------------------------------------------------------------------------------


def texts(fmt, source, depth=1, **options):
    return [t for _, _, _, t in rows(fmt, source, depth, **options)[1]]


def test_go_groups():
    source = "package p\ntype (\n\tA struct{ x int }\n\tB int\n)\nvar (\n\tx = 1\n)\n"
    assert rows("Go", source)[1] == [(3, 3, 0, "type A struct"), (4, 4, 0, "type B int"), (6, 8, 0, "var (")]
    assert texts("Go", source, parity=True) == ["type A struct", "var ("]


def test_go_results_with_braces():
    assert texts("Go", "func f(g func() struct{}) (m map[string]interface{}) {\n}\nfunc main() {}\n") == ["func f(g func() struct{}) (m map[string]interface{})", "func main()"]


def test_rust_traits_and_strings():
    source = 'trait T {\n    fn a(&self);\n    fn b(&self) -> char { \'}\' }\n}\nfn f() -> &\'static str { r#"}"# }\nstatic mut X: u8 = 1;\n'
    assert rows("Rust", source)[1] == [(1, 4, 0, "trait T"), (2, 2, 1, "fn a(&self)"), (3, 3, 1, "fn b(&self) -> char"), (5, 5, 0, "fn f() -> &'static str"), (6, 6, 0, "static mut X: u8 = 1")]
    assert "fn a(&self)" not in texts("Rust", source, parity=True)


def test_python_decorators_and_nesting():
    source = "@a\n@b(1)\ndef f(x,\n      y):\n    def inner(): pass\n    return 1\n\n\nclass C:\n    @property\n    def p(self): return 1\n\n    @staticmethod\n    def s(): pass\n\n    class D:\n        def deep(self): pass\n"
    assert rows("Python", source, 1)[1] == [(1, 6, 0, "def f(x, y):"), (9, 17, 0, "class C:"), (10, 11, 1, "def p(self):"), (13, 14, 1, "def s():"), (16, 17, 1, "class D:")]


def test_python_strings_hide_code():
    assert texts("Python", 'X = """\ndef no():\n    pass\n"""\n# def no2(): pass\ndef yes(): return "class No:"\n') == ["def yes():"]


def test_javascript_bindings():
    source = "const A = 1;\nlet b = 'x';\nconst c = async (x) => { return x };\nvar d = function () {};\nexport const e = class {};\nconst { f } = require('y');\nexport { A };\n"
    assert texts("JavaScript", source) == ["const c = async (x) => { return x };", "var d = function () {};", "const e = class {};"]


def test_javascript_without_semicolons():
    source = "import a from 'a'\nfunction f() {\n  return 1\n}\nclass B {\n  m() {\n    return 2\n  }\n}\nexport default f\n"
    assert rows("JavaScript", source) == (["a"], [(2, 4, 0, "function f()"), (5, 9, 0, "class B"), (6, 8, 1, "m()")])


def test_cpp_guards_and_parity():
    source = '#ifndef H\n#define H\n#include <a>\nstruct S { int x; };\n#endif\nextern "C" {\nint f(int);\n}\n'
    assert rows("C++", source) == (["<a>"], [(4, 4, 0, "struct S"), (4, 4, 1, "int x"), (7, 7, 0, "int f(int)")])
    assert rows("C++", source, parity=True) == ([], [])


def test_shell_locals_are_left_out():
    assert texts("Shell", "f() {\n  local x=1\n  Y=2\n}\nif true; then\n  Z=3\nfi\nW=4\n") == ["f()", "W="]


def test_xml_long_and_empty():
    assert texts("XML", f"<a><b>{'x' * 60}</b><c/><!-- <d/> --></a>", 2) == ["<a> (2 children)", "<b> <60 B>", "<c>"]


def test_html_void_and_unclosed():
    assert rows("HTML", '<link rel="x" href="a.css">\n<ul>\n<li>one\n<li>two\n</ul>\n', 1) == (["a.css"], [(1, 1, 0, '<link href="a.css">'), (2, 5, 0, "<ul> (2 children)"), (3, 3, 1, "<li> one"), (4, 4, 1, "<li> two")])


def test_json_long_string_and_roots():
    assert texts("JSON", '{"k": "' + "v" * 100 + '", "n": [], "o": {}}') == ["{object, 3 keys}", '"k": "<string, 102 B>"', '"n": [array, 0 items]', '"o": {object, 0 keys}']
    assert texts("JSON", "// c\n[1, 2]") == ["[array, 2 items]"]
    assert texts("JSON", "true") == ["true"]
    assert len(rows("JSON", "[" * 200_000)[1]) == 1


def test_yaml_documents_and_blocks():
    source = "---\na: 1\n---\nb: |\n  x: y\n  z\nc:\n- 1\n- 2\nanchor: &x\n  k: v\n"
    assert rows("YAML", source, 1)[1] == [(1, 2, 0, "--- document 1"), (2, 2, 0, "a: 1"), (3, 11, 0, "--- document 2"), (4, 6, 0, "b: | x: y z"), (7, 9, 0, "c: [2 items]"), (10, 11, 0, "anchor: {1 key}"), (11, 11, 1, "k: v")]


def test_toml_depth_hides_keys():
    source = 'a = 1\n[t]\nb = 2\n[[u]]\nc = """\n[no]\n"""\n'
    assert texts("TOML", source, 0) == ["a", "[t]", "[[u]]"]
    assert texts("TOML", source, 1) == ["a", "[t]", "b", "[[u]]", "c"]


def test_css_at_rules():
    assert texts("CSS", "@charset 'x';\n@keyframes spin { from { a: b } }\n@supports (x: y) { .q { } }\n@page { margin: 0 }\na::after { content: '}' }\n") == ["@keyframes spin", "@supports (x: y)", ".q", "a::after"]


def python_by_ast(source):
    import ast

    found = []

    def walk(body, depth):
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                found.append((min([x.lineno, *(d.lineno for d in x.decorator_list)]), x.end_lineno, depth))
                if isinstance(x, ast.ClassDef) and depth < 1:
                    walk(x.body, depth + 1)

    walk(ast.parse(source).body, 0)
    return found


def test_python_ranges_against_the_ast():
    """This repository's own files, and some of the standard library."""
    import glob
    import os
    from pathlib import Path

    paths = [*Path(__file__).resolve().parent.parent.rglob("*.py"), *sorted(glob.glob(os.path.join(os.path.dirname(os.__file__), "*.py")))[:60]]
    for path in paths:
        source = Path(path).read_text(errors="replace")
        got = [(a, b, i) for a, b, i, _ in rows("Python", source, 1)[1]]
        assert got == python_by_ast(source)[: len(got)] and (len(got) == MAX_DECLS or len(got) == len(python_by_ast(source))), path


def test_strings_over_lines_end_nothing():
    assert rows("Python", 'def f():\n    """a\nb\n\n    c"""\n    return 1\nx = 1\n')[1] == [(1, 6, 0, "def f():")]
    assert rows("JavaScript", "const f = () => `a\nfunction no() {}\n${b}`\nfunction g() {}\n")[1] == [(1, 3, 0, "const f = () => `a"), (4, 4, 0, "function g()")]
    assert rows("Go", "var s = `\nfunc no() {}\n`\nfunc f() {}\n")[1] == [(1, 3, 0, "var s = `"), (4, 4, 0, "func f()")]
    assert rows("Shell", "A='x\nB=1\n'\nC=2\n")[1] == [(1, 3, 0, "A="), (4, 4, 0, "C=")]
    assert rows("Ruby", 'def f\n  x = "a\nend\n"\n  x\nend\n')[1] == [(1, 6, 0, "def f")]


def test_c_headers_with_macros_and_form_feeds():
    source = "__BEGIN_DECLS\n\nextern int f (int);\n\f\ntypedef int t;\n# define X(a) \\\n  { a\nstruct s { int x; };\n__END_DECLS\n"
    assert rows("C", source)[1] == [(3, 3, 0, "extern int f (int)"), (5, 5, 0, "typedef int t"), (8, 8, 0, "struct s")]


HOSTILE = ["(", "{", "[", "a={}", "a,\n", "\n", "@a\n", '<a "', '<a "" ', "</b>", "<!", "<![", "x: [\n", "---\n#\n", "/*", "def f(", "class A\n", "=begin\n", "<<E\n", "${", "$((", "`", "(]", ".a{", '<x"', "public class A {"]


@pytest.mark.parametrize("fmt", sorted(GRAMMARS))
def test_hostile_text_takes_time_in_proportion(fmt):
    """Four times the text takes about four times as long, and not sixteen times."""
    import time

    for piece in HOSTILE:
        took = []
        for size in (40_000, 160_000):
            text = (piece * (size // len(piece) + 1))[:size]
            started = time.perf_counter()
            parse(fmt, text, 2, False)
            took.append(time.perf_counter() - started)
        assert took[1] < 0.4 or took[1] < 9 * took[0], (piece, took)


def test_deeply_nested_html():
    assert parse("HTML", "<body>" * 5000 + "<div>" * 5000 + "<script src='a.js'>", 2, False).imports == ["a.js"]


def test_unclosed_quotes_and_tags():
    found = parse("XML", '<a x="1"><b y=\'2><c/></a>', 2, False).decls
    assert [d[3] for d in found][0].startswith("<a")
    assert [d[3] for d in parse("XML", '<a><b q="<x>"/><c></c></a>', 2, False).decls] == ["<a> (2 children)", '<b q="<x>">', "<c>"]
