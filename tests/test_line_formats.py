import random

from pyspark.sql import functions as F

from skelmap.functions.parse import markup
from skelmap.operators import line_formats as lf
from skelmap.operators import limits


def files(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, text string")


def decls(df, shift=1):
    return [(r.start + shift, r.end + shift, r.indent, r.text) for r in df.orderBy("file_id", "start").collect()]


def test_env_shows_names_only(spark):
    text = "# comment\nHOST=example\n\nexport API_KEY = s3cret=x\n  SPACED = v\n=none\nnot a binding\nexport  WIDE=1\n"
    out = decls(lf.env_decls(files(spark, text)))
    assert out == [(2, 2, 0, "HOST"), (4, 4, 0, "API_KEY"), (5, 5, 0, "SPACED"), (8, 8, 0, "WIDE")]
    assert "s3cret" not in str(out)


def test_env_without_keys(spark):
    assert decls(lf.env_decls(files(spark, "", "\n\n# x\n"))) == []


def test_ini_sections(spark):
    text = "; top\nbare = 1\n\n[one]\nkey = v\npath: /x\n\n[two]\nz=hidden\n"
    assert decls(lf.ini_decls(files(spark, text))) == [(2, 2, 0, "bare"), (4, 7, 0, "[one]"), (5, 5, 1, "key"), (6, 6, 1, "path"), (8, 9, 0, "[two]"), (9, 9, 1, "z")]


def test_make_targets(spark):
    text = "CC := gcc\nFLAGS ?= -O2\n.PHONY: all\nall: a b\n\tsecret recipe\n# note: x\nclean:\n\trm\n  indented: no\n"
    out = decls(lf.make_decls(files(spark, text)))
    assert out == [(1, 1, 0, "CC ="), (2, 2, 0, "FLAGS ="), (3, 3, 0, ".PHONY: all"), (4, 5, 0, "all: a b"), (7, 9, 0, "clean:")]
    assert "recipe" not in str(out)


def test_docker_stages(spark):
    text = "ARG TOKEN=abc\nFROM node:20 AS build\n# c\nRUN npm ci \\\n  && echo\nENV A=1 B=two\nENV LEGACY value\nfrom scratch\nCOPY --from=build /x /y\nLABEL url=db://u:p@h\n"
    out = decls(lf.docker_decls(files(spark, text)))
    assert out == [(1, 1, 0, "ARG TOKEN"), (2, 7, 0, "FROM node:20 AS build"), (4, 4, 1, "RUN npm ci \\"), (6, 6, 1, "ENV A B"), (7, 7, 1, "ENV LEGACY"), (8, 10, 0, "from scratch"), (9, 9, 1, "COPY --from=build /x /y"), (10, 10, 1, "LABEL <redacted>")]
    old = decls(lf.docker_decls(files(spark, text), parity=True))
    assert (7, 7, 1, "ENV LEGACY value") in old and (10, 10, 1, "LABEL url=db://u:p@h") in old


def test_csv(spark):
    rows = lf.csv_digest(files(spark, "a,b,c\n1,2,3\n4,5,6\n", "1\t2\n3\t4\n", "", "x;y,z;w\n", "only\n")).orderBy("file_id").collect()
    assert [(r.header, r.n_cols, r.n_rows, r.delimiter) for r in rows] == [("a, b, c", 3, 2, ","), (None, 2, 2, "\\t"), (None, 1, 0, ","), ("x, y,z, w", 3, 0, ";"), ("only", 1, 0, ",")]


def test_log(spark):
    a, b, c = lf.log_digest(files(spark, "\nstart up\nWARN low\nERROR bad ERROR\nend\n\n", "", "plain\ntext")).orderBy("file_id").collect()
    assert (a.n_lines, a.first_row, a.first_text, a.last_row, a.last_text, a.error, a.warn, a.fatal, a.first_error_row) == (6, 2, '"start up"', 5, '"end"', 1, 1, 0, 4)
    assert (b.n_lines, b.first_row, b.last_text, b.first_error_row) == (0, None, None, None)
    assert (c.n_lines, c.error, c.first_error_row, c.size_text) == (2, 0, None, "10 B")


def test_binary_sniff(spark):
    df = spark.createDataFrame([(0, bytearray(b"a\x00b")), (1, bytearray(b"x" * 8192 + b"\x00")), (2, bytearray("é".encode()))], "i int, c binary")
    assert [r.b for r in df.orderBy("i").select(lf.looks_binary(F.col("c")).alias("b")).collect()] == [True, False, False]


def stack_model(found, last):
    """Depth and end of headings by a stack."""
    out, open_ = [], []
    for i, (row, level) in enumerate(found):
        while open_ and open_[-1] >= level:
            open_.pop()
        end = next((r - 1 for r, k in found[i + 1 :] if k <= level), last)
        out.append((row, len(open_), max(end, row)))
        open_.append(level)
    return out


def test_nested_sections_against_a_stack(spark):
    rng = random.Random(4)
    docs, rows = {}, []
    for d in range(150):
        n, last = rng.randrange(1, 15), 0
        found = []
        for _ in range(n):
            last += rng.randrange(1, 4)
            found.append((last, rng.randrange(1, 7)))
        docs[d] = stack_model(found, last + 2)
        rows += [(d, r, k, last + 2) for r, k in found]
    df = spark.createDataFrame(rows, "d long, row long, level int, last long")
    got: dict[int, list] = {}
    for r in lf.nested_sections(df, ["d"], "row", "level", F.col("last")).orderBy("d", "row").collect():
        got.setdefault(r.d, []).append((r.row, r.depth, r.end))
    assert got == docs


def test_nested_sections_in_blocks(spark):
    """Groups of one row to several thousand, blocks of any size, level 7 as text between headings, null groups, clashing columns."""
    rng = random.Random(8)
    for block in (1, 3, 64, 1 << 16):
        rows, want = [], {}
        for d in (None, 1, 2, 3, 4):
            n, at, found = rng.choice((1, 40, 3000)), rng.randrange(300), []
            for _ in range(n):
                at += rng.randrange(1, 4)
                found.append((at, rng.choice((1, 2, 3, 3, 4, 5, 5, 6, 6, 7, 7, 7))))
            rows += [(d, r, k, "x", 1) for r, k in found]
            heads = [(r, k) for r, k in found if k < 7]
            want[d] = stack_model(heads, at)
        df = spark.createDataFrame(rows, "d long, row long, level int, _by0 string, last long")
        out = lf.nested_sections(df, ["d"], "row", "level", block=block)
        assert out.columns == [*df.columns, "depth", "end"]
        got = {d: [] for d in want}
        for r in sorted(out.where("level < 7").collect(), key=lambda r: r.row):
            got[r.d].append((r.row, r.depth, r.end))
        assert got == want and out.count() == len(rows)
        assert lf.nested_sections(df.limit(0), ["d"], "row", "level", block=block).collect() == []


def test_nested_sections_of_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 5, 1), (1, None, 1), (1, 9, None), (1, 12, 3)], "d long, row long, level int")
    got = sorted(((r.row, r.level, r.depth, r.end) for r in lf.nested_sections(df, ["d"], "row", "level", block=4).collect()), key=repr)
    stack = stack_model([(5, 1), (5, 1), (5, 2), (12, 3)], 12)
    assert got == sorted([(r, k, depth, end) for (r, depth, end), k in zip(stack, (1, 1, 2, 3))] + [(None, 1, 0, 4), (9, None, 0, 12)], key=repr)


def test_one_large_group_is_dealt_over_tasks(spark):
    n = 400_000
    df = spark.range(n).select(F.lit(1).alias("d"), F.col("id").alias("row"), (F.when(F.col("id") == 0, 1).otherwise(2 + F.col("id") % 3)).cast("int").alias("level"))
    out = lf.nested_sections(df, ["d"], "row", "level", block=1 << 12)
    # row 0 is the only one of level 1; then levels 3, 4, 2, 3, 4, 2, ...
    wrong = out.where((F.col("row") > 2) & ((F.col("depth") != F.col("level") - 1) | (F.col("end") != F.least(F.lit(n - 1), F.col("row") + F.when(F.col("level") == 2, 2).when(F.col("level") == 3, 1).otherwise(0)))))
    assert out.count() == n and wrong.count() == 0
    assert out.where("row = 0").select("depth", "end").first() == (0, n - 1)
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < n / 2


def test_markdown_headings():
    lines = ["# A", "", "```", "# no", "```", "Set", "===", "- item", "---", "para", "more", "---", "    # code", "#nospace", "###### six", "####### seven"]
    assert markup.headings(lines) == [(0, 1, "# A"), (5, 1, "Set"), (9, 2, "para"), (14, 6, "###### six")]


def greedy_model(sizes, budget, readable):
    out = []
    for s in sizes:
        skipped = s > budget
        read = not skipped and s <= readable
        budget -= s if read else 0
        out.append((read, skipped))
    return out


def test_greedy_budget(spark):
    rng = random.Random(8)
    cases = [[rng.randrange(0, 60) for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, sizes array<bigint>")
    got = [[(x["read"], x["skipped"]) for x in r.o] for r in df.orderBy("i").select(limits.greedy_budget(F.col("sizes"), 100, 50).alias("o")).collect()]
    assert got == [greedy_model(c, 100, 50) for c in cases]


def test_capped(spark):
    df = spark.createDataFrame([(["b", "a", "b", "", None],), ([f"x{i}" for i in range(45)],)], "v array<string>")
    a, b = (r.c for r in df.select(limits.capped(F.col("v"), 40).alias("c")).collect())
    assert a == ["b", "a"] and b == [f"x{i}" for i in range(40)] + ["(+5 more)"]


def test_within_budget(spark):
    df = spark.createDataFrame([("g", i, 100) for i in range(20)] + [("h", 0, 5000), ("h", 1, 1)], "g string, i int, size int")
    got = {(r.g, r.i) for r in limits.within_budget(df, ["g"], [F.col("i")], "size", 8, 450).collect()}
    assert got == {("g", i) for i in range(5)} | {("h", 0)}
    got = {(r.g, r.i) for r in limits.within_budget(df, ["g"], [F.col("i")], "size", 3, 10**9).collect()}
    assert got == {("g", i) for i in range(3)} | {("h", 0), ("h", 1)}


def test_spans_against_a_loop(spark):
    """Stages and sections end before the next header, told by a loop over the lines."""
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(["FROM a", "FROM\tb", "  from c", "RUN x", "# FROM no", "", "[s]", "k=v", "; [n]", "[]"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    got = {}
    for r in lf.docker_decls(files(spark, *texts)).collect():
        got.setdefault(r.file_id, {})[r.start] = (r.end, r.indent)
    sections = {}
    for r in lf.ini_decls(files(spark, *texts)).collect():
        sections.setdefault(r.file_id, {})[r.start] = (r.end, r.indent)
    for i, text in enumerate(texts):
        ls, stages, parts = text.split("\n")[: None if not text.endswith("\n") else -1] if text else [], {}, {}
        upper = [s.strip().upper() for s in ls]
        starts = [n for n, s in enumerate(ls) if s.lstrip().upper().startswith("FROM ")]
        first = next((n for n, s in enumerate(upper) if s.split()[:1] == ["FROM"]), 10**9)
        heads = [n for n, s in enumerate(ls) if s == "[s]"]
        for n, s in enumerate(upper):
            after = lambda found: next((m - 1 for m in found if m > n), len(ls) - 1)
            if s.split()[:1] == ["FROM"]:
                stages[n] = (after(starts), 0)
            elif s.startswith("RUN"):
                stages[n] = (n, int(n > first))
            if ls[n] == "[s]":
                parts[n] = (after(heads), 0)
            elif ls[n] == "k=v":
                parts[n] = (n, int(bool(heads) and n > heads[0]))
        assert got.get(i, {}) == stages and sections.get(i, {}) == parts, text


def test_long_runs_take_time_in_proportion(spark):
    import time

    df = files(spark, "x" + " " * 300_000 + "=1", "x" + ":" * 300_000 + "y=1", "FROM x\n" * 40_000, "[s]\n" * 40_000, None, "")
    began = time.time()
    for scan in (lf.env_decls, lf.ini_decls, lf.make_decls, lf.docker_decls):
        scan(df).count()
    assert time.time() - began < 60


def test_declarations_don_t_shuffle(spark):
    for scan in (lf.env_decls, lf.ini_decls, lf.make_decls, lf.docker_decls):
        assert "Exchange" not in scan(files(spark, "a=1"))._jdf.queryExecution().executedPlan().toString()
