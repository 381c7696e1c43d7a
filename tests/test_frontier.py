import os
import random

import pytest

from skelmap.plans import api
from skelmap.sources import frontier, tree

NAMES = ["a", "b.py", "c.md", ".git", ".github", ".env", ".env.local", "node_modules", "target", "Makefile", "x.png", "é.rs", "z", "dist", ".hidden", "d.json", "m"]


def grow(path, rng, depth):
    """A random tree: folders and files under any name, links among them."""
    for name in rng.sample(NAMES, rng.randrange(5, 12)):
        full = os.path.join(path, name)
        kind = rng.random()
        if kind < 0.4 and depth:
            os.mkdir(full)
            grow(full, rng, depth - 1)
        elif kind < 0.55:
            os.symlink(rng.choice([path, "nowhere", full]), full)
        else:
            with open(full, "w") as f:
                f.write("x" * rng.randrange(200))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tree"))
    grow(path, random.Random(4), 3)
    os.mkdir(os.path.join(path, "empty"))
    return path


def walked(spark, root, budget, **options):
    w = frontier.walk_tree(spark, root, budget, **options)
    rows = sorted((r.rel, r.path, r.base, r.size, r.is_dir) for r in w.files.collect())
    return [(p, rel, base, size, d) for rel, p, base, size, d in rows], w


def test_whole_trees_are_those_of_the_walk(spark, root):
    for options in ({}, {"supported_only": False}):
        got, w = walked(spark, root, None, **options)
        want, stopped = tree.walk(root, 1 << 40, **options)
        assert got == sorted(want, key=lambda r: r[1]) and len(got) > 15 and not (w.stopped or stopped)


def test_budgets_are_those_of_the_walk(spark, root):
    total = next(n for n in range(1, 10_000) if not tree.walk(root, n)[1])
    for budget in (0, 1, 7, total // 2, total - 1, total):
        got, w = walked(spark, root, budget)
        want, stopped = tree.walk(root, budget)
        assert (got, w.stopped) == (sorted(want, key=lambda r: r[1]), stopped), budget


def test_folders_beyond_the_budget_are_never_opened(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i:02}").mkdir()
        (tmp_path / f"d{i:02}" / "a.py").write_text("x = 1\n")
    got, w = walked(spark, str(tmp_path), 6)
    assert [r[1] for r in got] == [r[1] for r in tree.walk(str(tmp_path), 6)[0]] == [["d00", "a.py"], ["d01", "a.py"], ["d02", "a.py"]]
    assert w.stopped and w.opened <= 7  # the root and the first six


def test_a_folder_that_is_not_there_or_is_empty(spark, tmp_path):
    for path in (tmp_path, tmp_path / "none"):
        for budget in (None, 5):
            got, w = walked(spark, str(path), budget)
            assert got == [] and not w.stopped


def test_names_that_are_not_utf8(spark, tmp_path):
    with open(os.path.join(os.fsencode(tmp_path), b"\xff.py"), "w") as f:
        f.write("x")
    assert [r[2] for r in walked(spark, str(tmp_path), None)[0]] == ["�.py"]


def test_bodies_are_packed_by_bytes(spark):
    """A skewed table: tasks differ in bytes by less than a pack and one file."""
    rng = random.Random(3)
    sizes = [rng.choice([0, 10, 300, 2000]) if i < 3000 else 2_000_000 for i in range(3100)] + [None, 1 << 40]
    files = spark.createDataFrame([(f"/t/{i}", s) for i, s in enumerate(sizes)], "path string, size bigint").repartition(3)
    out = frontier.packed(files, 4_000_000)
    cost = lambda s: max(frontier.OPEN_BYTES, s if s is not None and s <= tree.MAX_FILE_BYTES else 0)
    tasks = out.rdd.mapPartitions(lambda rows: [[(r.path, r.size) for r in rows]]).collect()
    sums = sorted(sum(cost(s) for _, s in t) for t in tasks)
    assert sorted(p for t in tasks for p, _ in t) == sorted(f"/t/{i}" for i in range(len(sizes)))
    assert sums[-1] <= 6_000_000 and sums[-1] <= 2 * sums[len(sums) // 2]
    assert frontier.packed(files.limit(0)).collect() == []


def test_outlines_of_a_large_tree_are_those_of_the_walk(spark, root):
    got = sorted(map(tuple, api.outline_large_tree(spark, root).collect()), key=repr)
    assert got == sorted(map(tuple, api.outline_tree(spark, root).collect()), key=repr) and len(got) > 15
