import os
import random

import pytest
from pyspark.sql import functions as F

from skelmap.operators import walk
from skelmap.plans import api
from skelmap.sources import tree

NAMES = ["a", "a-b", "a.py", ".env", ".git", ".github", "build", "b.rs", "Makefile", "z.png", "é.md", "n.JSON"]


def random_tree(root, rng, depth=0):
    for name in rng.sample(NAMES, rng.randrange(1, 6)):
        path = os.path.join(root, name)
        if depth < 3 and rng.random() < 0.5:
            os.makedirs(path)
            random_tree(path, rng, depth + 1)
            with open(os.path.join(path, "leaf.go"), "w") as f:
                f.write("package p\n")
        else:
            with open(path, "w") as f:
                f.write("x = 1\n")


@pytest.fixture
def trees(tmp_path):
    for seed in range(5):
        os.makedirs(tmp_path / f"t{seed}")
        random_tree(str(tmp_path / f"t{seed}"), random.Random(seed))
    return tmp_path


def inventory(spark, trees):
    rows = [(t, i, os.path.relpath(os.path.join(d, f), trees / t).split("/")) for t in sorted(os.listdir(trees)) for i, (d, f) in enumerate((d, f) for d, _, fs in os.walk(trees / t) for f in fs)]
    return spark.createDataFrame(rows, "tree string, id long, rel array<string>").repartition(3), {(t, i): rel for t, i, rel in rows}


def test_a_table_is_walked_as_a_file_system_is(spark, trees):
    files, _ = inventory(spark, trees)
    for limit in (1, 3, 7, 1000):
        got = walk.walked(files, "tree", "id", limit).collect()
        for t in sorted(os.listdir(trees)):
            found, stopped = tree.walk(str(trees / t), limit)
            mine = [r for r in got if r.tree == t]
            assert [list(r.rel) for r in sorted(mine, key=lambda r: r.nth) if r.found] == [r[1] for r in found], (t, limit)
            assert {r.stopped for r in mine} == {stopped}, (t, limit)


def test_headings_are_those_of_index(spark, trees):
    files, _ = inventory(spark, trees)
    for r in walk.headings(walk.walked(files, "tree", "id", 20), "tree", 20).collect():
        listed = api.files_table(spark, str(trees / r.tree), maxEntries=20)
        if r.n_files:
            assert api._scale(listed, r.tree, 20 if r.stopped else 0) == r.heading


def test_miss_messages_are_those_of_index(spark, trees):
    files, rels = inventory(spark, trees)
    root = str(trees / "t1")
    for i in range(60):  # more names than are listed
        open(os.path.join(root, f"many{i:02}.py"), "w").close()
    files, rels = inventory(spark, trees)
    asked = [(i, rel[: len(rel) - 1 - i % 2] + ["no", "x.py"]) for (t, i), rel in rels.items() if t == "t1"]
    got = {r.key: r.message for r in walk.miss_messages(spark.createDataFrame(asked, "key long, rel array<string>"), files.where("tree = 't1'"), "key").collect()}
    for key, rel in asked:
        assert got[key] == api.miss_message(os.path.join(root, *rel), [root], root)


def test_paths_lead_where_they_lead(spark):
    rng = random.Random(2)
    paths = ["/" + "/".join(rng.choice(["..", ".", "", "a", "b", "w"]) for _ in range(rng.randrange(6))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    parts = walk.normalised(F.split("path", "/"))
    root = F.array(F.lit("w"), F.lit("a"))
    for r in rows.select("path", parts.alias("parts"), walk.inside(parts, root).alias("inside"), walk.shown(parts, root).alias("shown")).collect():
        want = os.path.normpath("/" + r.path.strip("/"))
        assert "/" + "/".join(r.parts) == want
        assert r.inside == (want == "/w/a" or want.startswith("/w/a/")) and r.shown == api.workspace_display(want, "/w/a")


def test_empty_and_odd_paths(spark):
    files = spark.createDataFrame([("t", 1, []), ("t", 2, ["a.py"]), ("t", 3, ["a.py"]), ("t", None, ["b", "c.py"]), ("u", 4, None)], "tree string, id long, rel array<string>")
    got = walk.walked(files, "tree", "id").collect()
    assert sorted((r.tree, r.nth, r.id, "/".join(r.rel), r.found) for r in got if r.id) == [("t", 1, 2, "a.py", True), ("t", 2, 3, "a.py", True)]
    assert [("/".join(r.rel), r.is_dir) for r in sorted(got, key=lambda r: r.nth) if r.id is None] == [("b", True), ("b/c.py", False)]
    assert walk.walked(files.where("false"), "tree", "id").count() == 0
