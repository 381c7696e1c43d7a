import random
import re

import pytest
from pyspark.sql import functions as F

from skelmap.functions import formats, redact, text

SENSITIVE = "password db_password AUTH_TOKEN apiKey aws-secret-access-key \"privateKey\" session.id Cookie connectionString signature key 'pwd' userPass".split(" ")
HARMLESS = "author monkey keyboard passenger tokenizer secretary authority keyed compass salty sessions_x1y name id".split(" ")
SECRETS = ["a password=x", "Server=db;Pwd=abc", "postgres://user:pw@host/db", "https://x/?api_key=1", "TOKEN=zz"]
PLAINS = ["https://example.com/a@b:c", "localhost:8080", "http://host:80/x", "password = x", "user:pw@host", ""]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_human_bytes(spark):
    values = [0, 27, 1023, 1024, 1280, 1536, 1048575, 1048576, 2 * 1048576, 1331, 5_000_000_000]
    want = ["0 B", "27 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "2.0 MB", "1.3 KB", "4768.4 MB"]
    assert column(spark, values, text.human_bytes, "bigint") == want
    rng = random.Random(1)
    more = [rng.randrange(1 << rng.randrange(1, 34)) for _ in range(500)] + [i * 128 + 64 for i in range(8, 200)]
    assert column(spark, more, text.human_bytes, "bigint") == [text.py_human_bytes(n) for n in more]


def test_lines_and_counts(spark):
    values = ["", "a\nb\n", "a\nb", "\n", "a\r\nb\r\n", "\n\n"]
    assert column(spark, values, text.line_count) == [0, 2, 2, 1, 2, 2]
    assert column(spark, values, text.lines) == [[], ["a", "b"], ["a", "b"], [""], ["a", "b"], ["", ""]]


def test_squash_and_clip(spark):
    values = [" a \t b\n\nc ", "x y", "", "é" * 200, "é" * 201]
    assert column(spark, values, text.squash)[:3] == ["a b c", "x y", ""]
    assert column(spark, values, text.clip)[3:] == ["é" * 200, "é" * 200 + "…"]
    assert [text.py_clip(v) for v in values[3:]] == ["é" * 200, "é" * 200 + "…"]


def test_looks_numeric(spark):
    good = ["1", "-1.5", ".5", "5.", "1e9", "+2E-3", "inf", "NaN", " 7 ", "Infinity"]
    bad = ["", "1d", "1f", "0x1", "a", "1,2", "--1", ".", "e5", "1e"]
    assert column(spark, good + bad, text.looks_numeric) == [True] * len(good) + [False] * len(bad)
    assert [text.py_is_float(v.strip()) for v in good + bad] == [True] * len(good) + [False] * len(bad)


def test_sensitive_keys(spark):
    values = SENSITIVE + HARMLESS
    want = [True] * len(SENSITIVE) + [False] * len(HARMLESS)
    assert column(spark, values, redact.is_sensitive_key) == want
    assert [redact.py_sensitive_key(v) for v in values] == want


def test_sensitive_key_twin(spark):
    rng = random.Random(3)
    parts = ["pass", "key", "Token", "AUTH", "x", "É", "é", "1", "_", "-", ".", "Secret", "ß", "user", "ID"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    assert column(spark, values, redact.is_sensitive_key) == [redact.py_sensitive_key(v) for v in values]


def test_secret_values(spark):
    values = SECRETS + PLAINS
    want = [True] * len(SECRETS) + [False] * len(PLAINS)
    assert column(spark, values, redact.value_looks_secret) == want
    assert [redact.py_secret_value(v) for v in values] == want


def test_must_redact(spark):
    rows = [("password", "hunter2", True), ("password", "12345", False), ("auth_enabled", "true", False), ("name", "bob", False), ("url", "db://u:p@h", True), ("secret", '""', False), (None, "x", False), (None, "pwd=x", True)]
    df = spark.createDataFrame(rows, "k string, v string, want boolean")
    assert all(r.got == r.want for r in df.select("want", redact.must_redact(F.col("k"), F.col("v")).alias("got")).collect())
    assert all(redact.py_must_redact(k, v) == w for k, v, w in rows)


NAMES = {
    "a.rs": "Rust", "b.GO": "Go", "x.pyi": "Python", "q.mjs": "JavaScript", "q.cts": "TypeScript", "q.tsx": "TSX", "A.java": "Java", "a.h": "C", "a.hxx": "C++",
    "r.rb": "Ruby", "z.zsh": "Shell", "p.csproj": "XML", "i.htm": "HTML", "s.css": "CSS", "R.md": "Markdown", "c.jsonc": "JSON", "c.yml": "YAML", "C.toml": "TOML",
    ".env": "dotenv", ".env.local": "dotenv", "prod.env": "dotenv", "a.conf": "INI", "t.tsv": "CSV", "n.txt": "log/text", "Makefile": "Makefile", "GNUmakefile": "Makefile", "x.mk": "Makefile",
    "Dockerfile": "Dockerfile", "Dockerfile.prod": "Dockerfile", "containerfile": "Dockerfile",
    ".envrc": None, ".gitignore": None, "a.svg": None, "noext": None, "a.": None, ".rs": None, "a.zig": None, "a.tar.gz": None,
}


def test_formats(spark):
    assert column(spark, list(NAMES), formats.format_of) == list(NAMES.values())
    assert {n: formats.py_format_of(n) for n in NAMES} == NAMES


@pytest.mark.parametrize("name,ext", [("a.rs", "rs"), (".bashrc", ""), ("a.b.c", "c"), ("x", ""), ("Makefile", "make"), (".env.x", "env")])
def test_extension(spark, name, ext):
    assert one(spark, name, formats.extension) == ext


def test_no_column_code_uses_row_functions():
    import inspect

    source = "".join(inspect.getsource(m) for m in (text, redact, formats))
    assert not re.search(r"\budf\b", source)
