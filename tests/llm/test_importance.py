import math
import re
from collections import Counter
from zlib import crc32

import pytest
from helpers import AWKWARD, DOCS, clashing, docs, rows

from skelmap.llm import importance


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(table, target, longest=1, buckets=10_000, percent=10, min_words=20):
    code = lambda f: crc32(f.encode()) % buckets
    s = Counter(code(f) for _, t in table for f in runs(t, longest))
    t = Counter(code(f) for x in target for f in runs(x, longest))
    n, m = s.total(), t.total()
    scored = []
    for k, (i, text) in enumerate(table):
        found = runs(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in map(code, found))
        scored.append([i, len(found), weight, weight + importance.expected_noise(i), None, len(words(text)), k])
    fit = sorted((r for r in scored if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in scored), key=repr)


TARGET = ["alpha beta gamma delta", None, "", "Alpha éa 9 \x00beta", "the quick fox"]


def table_of(n=400):
    vocabulary = ["alpha", "Beta", "gamma", "the", "quick", "fox", "été", "x1", "of"]
    made = [(i, " ".join(vocabulary[(i * j + j) % (i % 9 + 1)] for j in range(i % 60))) for i in range(n)]
    return made + [(n + i, "alpha beta " * 15) for i in range(n // 2)]  # a third of the rows is one text


@pytest.mark.parametrize("longest,buckets,percent,min_words", [(1, 10_000, 10, 20), (3, 97, 35, 1), (2, 100_000, 100, 0)])
def test_against_brute_force(spark, longest, buckets, percent, min_words):
    table = table_of()
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(df, target, longest=longest, buckets=buckets, percent=percent, min_words=min_words)
    assert rows(got) == brute(table, TARGET, longest, buckets, percent, min_words)


def test_awkward_rows(spark):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, copies int")
    got = importance.resample(clashing(docs(spark)), target, min_words=2, percent=60)
    want = brute([r[:2] for r in AWKWARD], TARGET, min_words=2, percent=60)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and rows(got) == want
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 1 + sum(r[4] is not None for r in want)))


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(none, one).collect() == []
    assert rows(importance.resample(one, none, min_words=1, percent=100)) == brute([(1, "a b c")], [], min_words=1, percent=100)


def test_repeated_rows_are_ranked_each(spark):
    table = [(None, "a " * 30)] * 40 + [(7, "a " * 30)] * 40
    got = importance.resample(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([], DOCS), percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 41)) and len(got) == 80 and len({r.weight for r in got}) == 1
