import os
import shutil

import pytest
from pyspark.sql import functions as F

from skelmap.operators import directory
from skelmap.plans import api
from skelmap.plans.register import register_functions
from skelmap.sources import tree


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    return str(root)


@pytest.fixture
def small(tmp_path):
    return write(tmp_path, {
        "a.rs": "fn main() {}\n", "a/b.rs": "struct B;\n", "a-b/c.rs": "fn c() {}\n", ".env": "TOKEN=abc\n", "__init__.py": "import os\n", "_priv/h.py": "class H:\n    def m(self): pass\n",
        "node_modules/x.js": "function no() {}\n", ".hidden/y.py": "def no(): pass\n", ".github/ci.yml": "on: push\n", "src/bin/tool.rs": "fn tool() {}\n", "target/gen.rs": "fn no() {}\n", "image.png": "", ".env.d/x.py": "",
    })


def rels(spark, root, **options):
    return ["/".join(r.rel) for r in api.files_table(spark, root, **options).orderBy("rel").collect()]


def test_tree_source_sees_what_file_sources_hide(spark, small):
    # component order: a/b before a-b before a.rs
    assert rels(spark, small) == [".env", ".github/ci.yml", "__init__.py", "_priv/h.py", "a/b.rs", "a-b/c.rs", "a.rs", "src/bin/tool.rs"]
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(small).where(F.col("path").endswith(".env")).count() == 0


def test_tree_source_passes_over_links(spark, tmp_path):
    root = write(tmp_path / "in", {"a.py": "x = 1\n"})
    outside = write(tmp_path / "out", {"secret.py": "y = 1\n"})
    os.symlink(os.path.join(outside, "secret.py"), os.path.join(root, "link.py"))
    os.symlink(outside, os.path.join(root, "dir"))
    assert rels(spark, root) == ["a.py"]
    assert api.index(spark, "link.py", cwd=root)[1]


def test_walk_stops_at_the_limit(tmp_path):
    root = write(tmp_path, {f"f{i:02}.py": "" for i in range(40)})
    rows, cut = tree.walk(root, 10)
    assert cut and [r[2] for r in rows] == [f"f{i:02}.py" for i in range(10)]
    assert not tree.walk(root, 40)[1]


def test_listing_holds_everything(small):
    names = [r[2] for r in tree.listing(small)]
    assert ".hidden" in names and "node_modules" in names and "image.png" in names
    assert tree.listing(small + "/nope") is None


def test_bounded_read(tmp_path):
    path = os.path.join(write(tmp_path, {"a.txt": "x" * 100}), "a.txt")
    assert tree.read_bounded(path, 100) == b"x" * 100 and tree.read_bounded(path, 99) is None and tree.read_bounded(path + "no") is None


def test_one_file(spark, small):
    text, bad = api.index(spark, "_priv/h.py", cwd=small)
    assert not bad and text == "h.py\n  [1-2]      class H:\n    [2-2]      def m(self):\n"
    assert api.index(spark, "_priv/h.py", 0, cwd=small)[0] == "h.py\n  [1-2]      class H:\n"
    assert api.index(spark, ".env", cwd=small)[0] == ".env\n  [1-1]      TOKEN\n  (values omitted — .env may contain secrets)\n"


def test_errors(spark, small, tmp_path_factory):
    assert api.index(spark, "", cwd=small) == ("index: missing `path` argument.", True)
    assert api.index(spark, "image.png", cwd=small) == ('index: unsupported file type ".png" — no tree-sitter grammar for it. Fall back to `read` for this file.', True)
    outside = write(tmp_path_factory.mktemp("o"), {"a.py": "x"})
    text, bad = api.index(spark, outside + "/a.py", cwd=small)
    assert bad and "is outside the workspace" in text
    big = os.path.join(small, "big.py")
    with open(big, "w") as f:
        f.write("#" * (2 * 1024 * 1024 + 1))
    assert api.index(spark, "big.py", cwd=small) == ("index: file is 2097153 bytes (> 2 MB limit) — too large to outline. Fall back to `read` (use offset/limit to page through it).", True)


def test_misses(spark, tmp_path):
    root = write(tmp_path / "w", {"pkg/save_test.go": "package p\n", "pkg/.hidden": ""})
    text, bad = api.index(spark, "pkg/save.go", cwd=root)
    assert bad and text == "index: no such path pkg/save.go — `save.go` is not in pkg/, which contains: .hidden  save_test.go"
    assert "`nope` is not in the workspace root" in api.index(spark, "nope/deep/x.py", cwd=root)[0]
    assert api.index(spark, "pkg/save_test.go/x", cwd=root)[0].startswith("index: cannot access pkg/save_test.go/x")
    assert "No directory above it exists inside the workspace" in api.index(spark, "/nowhere/else/x.py", cwd=root)[0]
    os.makedirs(os.path.join(root, "empty"))
    assert api.index(spark, "empty/x", cwd=root)[0].endswith("empty/ is empty.")
    many = write(tmp_path / "m", {f"f{i:02}.py": "" for i in range(62)})
    text, _ = api.index(spark, "g.py", cwd=many)
    assert "f49.py  … and 12 more (62 total). Use `glob`" in text and "f50.py" not in text and len(text) < 2000


def test_directory_of_nothing(spark, tmp_path):
    root = write(tmp_path, {"image.png": "", "data.bin": ""})
    text, bad = api.index(spark, ".", cwd=root)
    assert bad and text == "index: . contains no supported source files to outline. It contains: data.bin  image.png Use `grep`/`read` to explore it."


def test_skeleton_tier(spark, small):
    text, bad = api.index(spark, ".", cwd=small)
    assert not bad and text.startswith(". — 8 supported files\n\n.env (1 lines, 10 B)\n  [1-1]      TOKEN\n")
    assert text.index("a/b.rs (") < text.index("a-b/c.rs (") < text.index("a.rs (") and "abc" not in text


def test_map_tier(spark, tmp_path):
    root = write(tmp_path, {f"d{i % 3}/f{i:02}.py": "x = 1\ny = 2\n" for i in range(40)})
    text, bad = api.index(spark, ".", cwd=root)
    assert not bad and len(text) < 8000
    assert text.startswith(". — 40 supported files in 3 directories\n(map only — `index <file>` or `index <subdir>` for skeletons)\n\nd0/f00.py (2 lines, 12 B)\n")
    assert text.count("(2 lines, 12 B)") == 40


def test_a_cut_walk_is_told(spark, tmp_path):
    root = write(tmp_path, {f"f{i:02}.py": "x\n" for i in range(60)})
    text, bad = api.index(spark, ".", cwd=root, max_entries=40)
    assert not bad and text.startswith(". — 40+ supported files in 1+ directories — walk stopped at 40 entries, so this is a LOWER BOUND;")
    text, _ = api.index(spark, ".", cwd=root, max_entries=10)
    assert text.startswith(". — 10 supported files — walk stopped at 10 entries") and text.count(".py (1 lines, 2 B)") == 10


def test_map_budget(spark, tmp_path):
    root = write(tmp_path, {f"f{i:02}.py": "x\n" for i in range(35)} | {f"big{i}.py": "#" * 2_000_000 for i in range(5)} | {"huge.py": "#" * 3_000_000})
    text, _ = api.index(spark, ".", cwd=root)
    assert "big3.py (1 lines, 1.9 MB)" in text and "big4.py (? lines, 1.9 MB)" in text and "huge.py (? lines, 2.9 MB)" in text and "f34.py (1 lines, 2 B)" in text
    assert "(2 line counts skipped past a 8.0 MB read budget — sizes above are exact)" in text


def test_rollup_tier(spark, tmp_path):
    root = write(tmp_path, {f"pkg{i % 2}/sub/f{i}.py": "x\n" for i in range(320)} | {"top.py": "y\n"})
    text, bad = api.index(spark, ".", cwd=root)
    assert not bad and len(text) < 4000
    assert text == ". — 321 supported files in 3 directories\n(rolled up — `index <subdir>` to descend)\n\n" + "pkg0/                          160 files 320 B\npkg1/                          160 files 320 B\ntop.py                           1 file  2 B\n"


def test_outline_tree(spark, small):
    got = {r.rel: r.text for r in api.outline_tree(spark, small).collect()}
    assert set(got) == {".env", ".github/ci.yml", "__init__.py", "_priv/h.py", "a/b.rs", "a-b/c.rs", "a.rs", "src/bin/tool.rs"}
    assert got["a/b.rs"] == "a/b.rs\n  [1-1]      struct B;\n"


def test_outline_of_odd_contents(spark):
    from skelmap.operators.outline import outline

    rows = [(1, "a.ini", "INI", bytearray(b"a\x00b")), (2, "b.py", "Python", bytearray(b"def f(\xff): pass\n")), (3, "c.env", "dotenv", bytearray(b"")), (4, "d.txt", "log/text", bytearray(b"")), (5, "e.py", "Python", None), (6, "f.json", "JSON", bytearray(b"")), (7, "Makefile", "Makefile", bytearray(b"\n"))]
    got = {r.file_id: (r.text, r.is_error) for r in outline(spark.createDataFrame(rows, "file_id long, name string, fmt string, content binary")).collect()}
    assert got[1] == ("a.ini\n  (looks binary — use `read`)\n", False)
    assert got[2] == ("b.py\n  [1-1]      def f(\ufffd):\n", False)
    assert got[3] == ("c.env\n  (no keys found)\n", False)
    assert got[4] == ("d.txt\n  lines: 0   bytes: 0 B\n  (use `read` offset/limit to page through it)\n", False)
    assert got[5] == ("index: cannot read e.py. Fall back to `read`.", True)
    assert got[6] == ("f.json\n  (no imports or top-level declarations found)\n", False)
    assert got[7] == ("Makefile\n  (no targets or variables found)\n", False)


def test_line_format_cap(spark):
    from skelmap.operators.outline import outline

    df = spark.createDataFrame([(1, "x.env", "dotenv", bytearray("".join(f"K{i}=1\n" for i in range(501)).encode()))], "file_id long, name string, fmt string, content binary")
    text = outline(df).first().text
    assert text.count("] ") >= 500 and "K499" in text and "K500" not in text and "output truncated at 500 entries" in text


def test_nearest_ancestors(spark):
    dirs = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "rel array<string>")
    asked = spark.createDataFrame([(1, ["a", "b", "x.py"]), (2, ["a", "c", "d", "x.py"]), (3, ["q"]), (4, ["a", "b", "c", "d"])], "id int, rel array<string>")
    got = {r.id: (r.ancestor, r.missing) for r in directory.nearest_ancestors(asked, dirs).collect()}
    assert got == {1: ("a/b", "x.py"), 2: ("a", "c"), 3: ("", "q"), 4: ("a/b", "c")}


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT sk_human_bytes(1280) h, sk_format('x/Dockerfile.dev') f, sk_squash(' a\n b ') s, sk_sensitive_key('apiKey') k, sk_redact('password', 'abc') r, sk_line_count('a\nb') n").first()
    assert (r.h, r.f, r.s, r.k, r.r, r.n) == ("1.2 KB", "Dockerfile", "a b", True, "<redacted>", 2)
    rows = spark.sql("SELECT t.id, o.* FROM (SELECT 1 AS id, '{\"a\": {\"b\": 1}}' AS body) t, LATERAL sk_outline(t.body, 'JSON', 2) o ORDER BY ord").collect()
    assert [(x.ord, x.start_line, x.end_line, x.depth, x.text) for x in rows] == [(0, 1, 1, 0, "{object, 1 key}"), (1, 1, 1, 1, '"a": {object, 1 key}'), (2, 1, 1, 2, '"b": 1')]


def test_stream_of_new_files(spark, tmp_path):
    from skelmap.streaming.incremental import outline_stream

    src, out = tmp_path / "src", str(tmp_path / "out")
    write(src, {"a.py": "def f(): pass\n"})

    def run():
        q = outline_stream(spark, str(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    write(src, {"b.json": '{"k": 1}', "c.zig": ""})
    run()
    got = {os.path.basename(r.path): (r.fmt, [d["text"] for d in r.decls]) for r in spark.read.parquet(out).collect()}
    assert got == {"a.py": ("Python", ["def f():"]), "b.json": ("JSON", ["{object, 1 key}", '"k": 1'])}
    shutil.rmtree(out)


def test_the_walk_keeps_what_it_came_to(tmp_path):
    """Depth first: a folder's files come before the names after the folder, and none is lost when the budget ends."""
    (tmp_path / "a").mkdir()
    for i in range(5):
        (tmp_path / "a" / f"f{i}.py").write_text("")
    for n in ("b.py", "c.py"):
        (tmp_path / n).write_text("")
    names = lambda budget: ["/".join(r[1]) for r in tree.walk(str(tmp_path), budget)[0]]
    assert names(4) == ["a/f0.py", "a/f1.py", "a/f2.py"] and tree.walk(str(tmp_path), 4)[1]
    assert names(7) == [f"a/f{i}.py" for i in range(5)] + ["b.py"] and tree.walk(str(tmp_path), 7)[1]
    assert names(8) == [f"a/f{i}.py" for i in range(5)] + ["b.py", "c.py"] and not tree.walk(str(tmp_path), 8)[1]
    assert names(2) == ["a/f0.py"]


def test_one_bad_entry_does_not_lose_the_listing(tmp_path, monkeypatch):
    import os

    (tmp_path / "x.py").write_text("abc")
    (tmp_path / "gone.py").write_text("")
    own = os.scandir

    class Entry:
        def __init__(self, e):
            self.e, self.name, self.path = e, e.name, e.path

        def is_dir(self, follow_symlinks=True):
            return self.e.is_dir(follow_symlinks=follow_symlinks)

        def stat(self, follow_symlinks=True):
            if self.name == "gone.py":
                raise FileNotFoundError(self.path)
            return self.e.stat(follow_symlinks=follow_symlinks)

    class Listed:
        def __init__(self, path):
            self.it = own(path)

        def __enter__(self):
            return (Entry(e) for e in self.it)

        def __exit__(self, *a):
            self.it.close()

    monkeypatch.setattr(tree.os, "scandir", Listed)
    assert [(r[2], r[3]) for r in tree.listing(str(tmp_path))] == [("gone.py", 0), ("x.py", 3)]


def test_a_tree_is_read_once(spark, small):
    """One listing, one read of bodies, one trip to Python workers for grammars, no join and no shuffle."""
    plan = api.outline_tree(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(w) for w in ("BatchScan", "MapInPandas", "ArrowEvalPython", "Exchange", "Join")] == [1, 1, 1, 0, 0]


def test_files_may_share_an_id(spark):
    from skelmap.operators.outline import outline

    rows = [(1, "a.py", "Python", bytearray(b"import os\n"), 10), (1, "b.env", "dotenv", bytearray(b"A=1\n"), 20), (None, "c.log", "log/text", bytearray(b"x"), 30), (None, "d.md", "Markdown", None, 40)]
    got = {r.tag: (r.name, r.is_error, r.text) for r in outline(spark.createDataFrame(rows, "file_id long, name string, fmt string, content binary, tag int"), keep=["tag"]).collect()}
    assert {k: v[:2] for k, v in got.items()} == {10: ("a.py", False), 20: ("b.env", False), 30: ("c.log", False), 40: ("d.md", True)}
    assert got[20][2] == "b.env\n  [1-1]      A\n  (values omitted — .env may contain secrets)\n"
