import random

import numpy as np
import pytest
from helpers import DOCS, clashing, docs, rows
from pyspark.sql import functions as F

from skelmap.llm import ann_forest, chat_preference, license_scan


def brute_nearest(table, k=20):
    ok = [(i, np.array(v, np.float64)) for i, v in table if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            scored = sorted(((-float((x * y).sum()), i) for i, y in ok if i != q and len(x) == len(y)))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(spark, table, kind="float"):
    return spark.createDataFrame(table, f"vec_id long, embedding array<{kind}>")


def found(df):
    got: dict[int, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in hits}) / max(1, len(hits)) for q, hits in want.items()])


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall(spark, spread):
    """Clusters and noise, unequal norms, several rounds and chunks."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((30, 24))
    x = (centres[rng.integers(0, 30, 2500)] + spread * rng.standard_normal((2500, 24))) * rng.uniform(0.7, 1.3, (2500, 1))
    table = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    got, want = found(ann_forest.nearest(vectors(spark, table), F.col("id") % 20 == 0, bucket_rows=150, chunk_rows=100)), brute_nearest(table)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = {(q, i): s for q, hits in want.items() for i, s in hits}
    assert all(exact[q, i] == pytest.approx(s, rel=1e-12, abs=1e-12) for q, hits in got.items() for i, s in hits if (q, i) in exact)


def test_recall_on_the_test_table(spark):
    """Random vectors, by prefixes of several bits."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in df.collect()]
    for options in ({}, {"bucket_rows": 100}):
        got, want = found(ann_forest.nearest(df.repartition(5), F.col("id") % 20 == 0, **options)), brute_nearest(table)
        assert set(got) == set(want) and recall(got, want) >= 0.9


def test_a_query_ascends_only_as_far_as_it_must():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 32))
    x = (centres[np.arange(8000) % 200] + 0.05 * rng.standard_normal((8000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    strings = ann_forest.labels(x, np.zeros(len(x)))[:, 0]
    tree = ann_forest.Tree(np.arange(len(x)), strings, x, ann_forest.TREES, 0)
    lengths = [length for length, _, _ in tree.search(np.arange(50), strings[:50], x[:50], np.ones(50), 20, ann_forest.MISS)]
    assert min(lengths) >= 3


def test_rows_of_one_id_and_several_vectors(spark):
    """They are candidates of their own, also for one another."""
    df = vectors(spark, [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [2.0, 1.0]), (3, [1.0, 3.0])])
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann_forest.nearest(df, F.col("id") % 20 == 0).collect())
    first, second = [(3, 2.0), (3, 1.0), (20, 0.0)], [(3, 3.0), (3, 1.0), (20, 0.0)]
    assert got == sorted((20, n, i, s) for hits in (first, second) for n, (i, s) in enumerate(hits, 1))


def test_rows_are_sent_once_a_tree(spark):
    """However many queries there are."""
    rng = np.random.default_rng(5)
    df = vectors(spark, [(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((900, 8)))])
    rows, kind = ann_forest._checked(df, "vec_id", "embedding")
    rows = ann_forest._labelled(rows.withColumn("top", F.lit(9.0)), kind, 4, True)
    sent = {}
    for asks in (rows, rows.where("id % 20 = 0")):
        sql = ann_forest._round(rows, asks, kind, 4, 3, 5, 0.1, 10_000, True)
        assert sql.select("query_id", "tree").distinct().count() == 4 * asks.count()
        sent[asks.count()] = sql._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode")
    assert len(set(sent.values())) == 1


def test_nearest_awkward(spark):
    table = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [2.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (60, [float("inf"), 1.0]), (80, None), (9, [-3.0, 0.0])]
    for kind in ("float", "double"):
        df = vectors(spark, table, kind)
        want = {0: [(8, 2.0), (1, 1.0), (20, 1.0), (2, 0.0), (9, -3.0)], 20: [(8, 2.0), (0, 1.0), (1, 1.0), (2, 0.0), (9, -3.0)]}
        assert found(ann_forest.nearest(df, F.col("id") % 20 == 0)) == want
        assert found(ann_forest.nearest(clashing(df), F.col("id") % 20 == 0)) == want
        assert found(ann_forest.nearest(df.limit(0), F.col("id") % 20 == 0)) == {}


def test_many_equal_vectors(spark):
    table = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + [(1000 + i, [float(i % 7), 1.0, 0.0]) for i in range(100)]
    got, want = found(ann_forest.nearest(vectors(spark, table), F.col("id") % 20 == 0, bucket_rows=50, chunk_rows=60)), brute_nearest(table)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]]) and (q >= 300 or [i for i, _ in got[q]] == [i for i, _ in want[q]])


# --- licences ------------------------------------------------------------------------------------------------------------


def brute_scan(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", t) if x]
    starts, labels, best = [], set(), 0.0
    base = set()
    for tpl in license_scan.templates():
        at = [s for s in range(-len(tpl.words), len(w)) if all(0 <= s + i < len(w) and w[s + i] == tpl.words[i] for i in tpl.key)]
        if at:
            labels.add(tpl.label)
            best = max(best, *(sum(0 <= s + i < len(w) and w[s + i] == x for i, x in enumerate(tpl.words)) / len(tpl.words) for s in at))
            if tpl.base:
                base.add(tpl.label)
                starts += at
    labels = {x for x in labels if x not in ("gpl", "lgpl", "agpl", "mpl") or not any(y.startswith(x + "-") for y in labels)}
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best)


def test_scan_awkward(spark):
    df = docs(spark)
    want = sorted([(r.doc_id, *brute_scan(r.text)) for r in df.collect()], key=repr)
    assert rows(license_scan.scan(df)) == want
    assert rows(license_scan.scan(clashing(df))) == want
    assert rows(license_scan.scan(df.limit(0))) == []


def test_scan_planted(spark):
    rng = random.Random(6)
    pieces = [t for _, t, _ in license_scan.NOTICES] + list(license_scan.BASE.values()) + ["mit license", "license", "cc by", "by nc", "gnu general public", "under the mit", "version 2"]
    filler = "mit under the license words é ﬁ 日本 x1 2 cc by".split()
    texts = ["Released under the MIT License. under-the-MIT/LICENSE under the mit license under the mit license", "İ UNDER THE MİT LICENSE", "under the Kmit license"]
    for _ in range(250):
        words = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(pieces).split()
            if rng.random() < 0.3:
                del p[rng.randrange(len(p))]
            words += p + [rng.choice(filler) for _ in range(rng.randrange(4))]
        texts.append(rng.choice([" ", ", ", "-", "\n", "...\t"]).join(w.upper() if rng.random() < 0.3 else w for w in words))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    assert rows(license_scan.scan(df)) == sorted([(i, *brute_scan(t)) for i, t in enumerate(texts)], key=repr)


def test_scan_of_a_megabyte_of_hits(spark):
    """The work grows with the words, and a far start is found."""
    import time

    long = "cc by nc " * 120_000
    df = spark.createDataFrame([(1, long, None, None, None), (2, "x " * 400_000 + "under the mit license", None, None, None)], DOCS)
    started = time.time()
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert time.time() - started < 60
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (120_000, 0, 359_997, "cc-by-nc")
    assert (got[2].n_base, got[2].first_word, got[2].base_labels) == (1, 400_000, "mit")


def test_whole_licences_and_what_is_left_of_them(spark):
    texts = [t for _, t, _ in license_scan.NOTICES] + [t[: len(t) // 2] for _, t, _ in license_scan.NOTICES] + ["x " + t.replace(" the ", " The\n* ").upper() for _, t, _ in license_scan.NOTICES]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = rows(license_scan.scan(df))
    assert got == sorted([(i, *brute_scan(t)) for i, t in enumerate(texts)], key=repr)
    by = {r[0]: r for r in got}
    assert all(label in by[i][6].split(",") and by[i][7] == 1 for i, (label, _, _) in enumerate(license_scan.NOTICES))


def test_versions_are_those_that_a_text_names(spark):
    gnu = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; {} of the License, or (at your option) any later version."
    planted = {
        "GNU Lesser General Public License version 2.1": "lgpl-2.1",
        "under the GNU Lesser General Public License v3.0": "lgpl-3",
        "the GNU Lesser General Public License, see COPYING": "lgpl",
        gnu.format("Lesser General Public License", "either version 2.1"): "lgpl-2.1",
        gnu.format("General Public License", "version 2"): "gpl-2",
        gnu.format("General Public License", "either version 3") + " See the GNU General Public License for more details.": "gpl-3",
        gnu.format("Affero General Public License", "either version 3"): "agpl-3",
        "GNU Affero General Public License, version 1": "agpl-1",
        "licensed under the GNU General Public License.": "gpl",
        "GNU General Public License v2 or GNU General Public License v3": "gpl-2,gpl-3",
        "Mozilla Public License Version 1.1": "mpl-1.1",
        "Mozilla Public License 2.0": "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
        "the Mozilla Public License": "mpl",
        "the Mozilla Public License and the GNU General Public License version 2": "gpl-2,mpl",
        "Redistribution and use in source and binary forms are forbidden": "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
        "the Lesser General Public version 3": "",
        "general public license version 2": "",
    }
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(planted)], DOCS)
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert {t: got[i] for i, t in enumerate(planted)} == planted


def test_the_plan_does_not_grow_with_the_templates(spark):
    more = [(f"l{i}", f"one of word{i} the licences thing{i} here", f"word{i} the licences thing{i}") for i in range(300)]
    df = spark.createDataFrame([(1, "word7 the licences thing7", None, None, None)], DOCS)
    nodes = []
    for notices in (license_scan.NOTICES, more):
        plan = license_scan.scan(df, notices=notices)
        nodes.append(plan._jdf.queryExecution().analyzed().treeString().count("lambdafunction"))
    assert nodes[0] == nodes[1] and plan.first().labels == "l7"


def test_scan_runs_no_python(spark):
    plan = license_scan.scan(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- conversations -------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def spans(turns):
    at, out = 0, []
    for r, t in turns:
        start = at + len("<|im_start|>") + len(r) + 1
        end = start + len(t) + len("<|im_end|>")
        at = end + 1
        if r == "assistant":
            out.append((start, end))
    return out


def brute_preference(chosen, rejected):
    n = 0
    while n < len(chosen) and n < len(rejected) and chosen[n] == rejected[n]:
        n += 1
    return (n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:]), spans(chosen[n:]), spans(rejected[n:]))


def test_preferences(spark):
    rng = random.Random(3)
    pool = [("user", "hi"), ("assistant", "yes \U0001f600"), ("assistant", "no"), ("system", ""), ("user", "line\ntwo")]
    table = []
    for i in range(120):
        head = [rng.choice(pool) for _ in range(rng.randrange(4))]
        table.append((i, head + [rng.choice(pool) for _ in range(rng.randrange(4))], head + [rng.choice(pool) for _ in range(rng.randrange(4))]))
    table.append((500, None, [("user", "x")]))
    df = spark.createDataFrame(table, "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r[0]: (*r[1:5], [tuple(s) for s in r[5]], [tuple(s) for s in r[6]]) for r in chat_preference.format_preferences(df).collect()}
    assert got == {i: brute_preference(c or [], r or []) for i, c, r in table}
    for _, _, chosen, _, at, _ in got.values():
        assert all(chosen[a:b].endswith("<|im_end|>") for a, b in at)


def test_pairs_awkward(spark):
    table = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "user", None), (1, 2, None, "b"), (1, None, "system", "s"), (2, 0, "user", "alone"), (None, 0, "user", "lost"), (-1, 0, "user", "neg"), (-2, 0, "user", "neg2"), (-2, 1, "assistant", "z")]
    df = spark.createDataFrame(table, TURNS)
    got = {r.conv_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in chat_preference.conversation_pairs(df).collect()}
    zero, one = [("user", "q"), ("assistant", "a"), ("assistant", "a")], [("system", "s"), ("user", ""), ("unknown", "b")]
    assert got == {0: (zero, zero[:1] + one[1:]), 1: (one, one[:1] + zero[1:]), 2: ([("user", "alone")], [("user", "alone")]), -1: ([("user", "neg")], [("user", "neg"), ("assistant", "z")]), -2: ([("user", "neg2"), ("assistant", "z")], [("user", "neg2")])}
    pairs = chat_preference.conversation_pairs(clashing(df))
    assert len(rows(chat_preference.format_preferences(pairs))) == 5
    assert rows(chat_preference.format_preferences(chat_preference.conversation_pairs(df.limit(0)))) == []
