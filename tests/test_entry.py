import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark, sf):
    df = entry.entry(spark)
    assert df.count() == 200 and df.columns[0] == "doc_id"


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def own_queries():
    from skelmap.plans import queries

    return [n for n in queries.queries() if n in queries.oracle_sql()]


def normal(rows, columns):
    def one(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", own_queries())
def test_query_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    assert normal([r.asDict() for r in df.collect()], columns) == normal([dict(zip(names, r)) for r in want.fetchall()], columns)


def test_the_library_does_not_lean_on_llm():
    for path in (ROOT / "skelmap").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_built_ins_stay_in_the_engine(spark, sf):
    """Queries of built-in expressions run no Python; those over one table without groups don't shuffle."""
    for name in ("doc_line_count", "doc_text_summary", "doc_csv_sniff", "doc_secret_bindings", "page_landmarks", "page_links_capped", "format_of_url"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("EvalPython|InPandas|InArrow|Exchange", plan), name


def test_columns_are_pruned_at_the_scan(spark, sf):
    plan = entry.queries()["doc_text_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = entry.queries()["page_tier"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "page_id" not in re.search("ReadSchema: (.*)", plan)[1]


def test_caps_are_cut_before_the_shuffle(spark, sf):
    plan = entry.queries()["decl_cap"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_the_rest_works_without_llm(tmp_path):
    """The entry imports without the subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "skelmap", tmp_path / "skelmap", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    from skelmap.plans import queries

    assert out.stdout.split(" ", 2) == [str(len(queries.queries())), str(len(queries.oracle_sql())), "[]\n"], out.stderr


def test_workers_need_no_copy_of_the_package(tmp_path, sf):
    """Functions travel by value: workers that can't import the package run them."""
    import os
    import subprocess
    import sys

    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
def probe(rows):
    import importlib.util
    yield importlib.util.find_spec("skelmap") is None
import __spark_entry__ as e
print("RESULT", spark.sparkContext.parallelize([0], 1).mapPartitions(probe).first(), e.queries()["outline_rust"](spark, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "RESULT True 1000" in out.stdout, out.stderr[-2000:]


def test_page_order_ranks_hosts_of_any_size(spark, tmp_path):
    """A host of over 300 pages, which a directory map would not show, is ranked whole, over several ranges."""
    import random

    rng = random.Random(8)
    urls = [f"http://{'hot' if i % 4 else f'h{i % 7}'}.org/{rng.randrange(9)}/{rng.choice('ab')}{'/x' * rng.randrange(3)}" for i in range(1000)]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = {r.page_id: (r.host, r.place) for r in entry.queries()["page_order_all"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(name, old)
    want, n = {}, {}
    for i, parts in sorted(((i, u.split("//")[1].split("/")) for i, u in enumerate(urls)), key=lambda x: (x[1][1:], x[0])):
        n[parts[0]] = n.get(parts[0], 0) + 1
        want[i] = (parts[0], n[parts[0]])
    assert got == want and n["hot.org"] == 750


def test_secret_scan_judges_every_binding(spark, tmp_path):
    texts = ["color = red and password: hunter2\nurl=https://a:b@c.d", "nothing here", None, "a=1 b=2", "x" * 5000 + " token = abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.k, r.redact) for r in entry.queries()["doc_secret_bindings"](spark, str(tmp_path)).collect())
    assert got == [(0, "color", False), (0, "password", True), (0, "url", True), (3, "a", False), (3, "b", False), (4, "token", True)]


def test_secret_scan_takes_values_with_vertical_tabs(spark, tmp_path):
    """A value ends where the SQL's does: at a blank, tab, line end or form feed."""
    import duckdb

    texts = ["password=\x0bhunter2", "token: 1\x0babc", "salt =\x0c5 dsn=a\tb", "key=a\rb"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in entry.queries()["doc_secret_bindings"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(entry.oracle_sql()["doc_secret_bindings"]).fetchall())
    assert [(r[0], r[1], r[-1]) for r in got] == [(0, "password", True), (1, "token", True), (2, "dsn", True), (3, "key", True)]


def test_page_order_takes_odd_addresses(spark, tmp_path):
    """Pages without an address or host are ranked among themselves, missing paths last; the query string goes, line separators in it too."""
    import duckdb

    urls = ["http://h.org/b", "", None, "/", "?x/y", "http://h.org/a?q\r/z", "http://h.org/a# ", "http://h.org", None, "http://h.org/a?q\n/z", "http://h.org/a?q\n"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {(r[0], r[1], r[2]) for r in con.execute(entry.oracle_sql()["page_order_all"]).fetchall()}
    got = [(r.page_id, r.host, r.place) for r in entry.queries()["page_order_all"](spark, str(tmp_path)).collect()]
    assert len(got) == len(urls) and set(got) == want
    assert [i for i, host, _ in sorted(got, key=lambda r: r[2]) if host is None] == [1, 3, 4, 2, 8]


def test_typescript_lines_beyond_the_caps_against_sql(spark, tmp_path):
    """Documents with declarations around the cap of 500, the cap between an interface and its member too, and imports after it."""
    import random

    import duckdb

    rng = random.Random(11)
    mixed = ["\n".join("export class {"[: 4 * rng.randrange(3)] + "x" * k for k in rng.choices(range(4), [rng.random() for _ in range(4)], k=rng.randrange(300, 900))) for _ in range(30)]
    one_kind = ["\n".join(["xxx"] * n + ["x"] * m + [""] * 50) for n in (249, 250, 251) for m in (0, 1, 2)]
    spark.createDataFrame(list(enumerate([*mixed, *one_kind, None])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["lines_typescript"])
    columns = [d[0] for d in want.description]
    want = sorted(want.fetchall(), key=repr)
    got = sorted((tuple(r) for r in entry.queries()["lines_typescript"](spark, str(tmp_path)).select(*columns).collect()), key=repr)
    late = {r[0] for r in want if r[columns.index("truncated")]}
    assert got == want and len(late) > 10
