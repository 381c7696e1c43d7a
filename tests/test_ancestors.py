"""Nearest ancestors by one merge of ranges, against prefixes tried one by one."""

import random

from skelmap.operators import directory, walk

ASKED, DIRS = "id long, rel array<string>", "rel array<string>"


def model(path, dirs):
    if path is None:
        return None, None
    for n in range(max(len(path) - 1, 0), -1, -1):
        if tuple(path[:n]) in dirs:
            return "/".join(path[:n]), path[n] if n < len(path) else None
    return None, None


def rows(df):
    return sorted(((r.id, r.rel, r.ancestor, r.missing) for r in df.collect()), key=repr)


def random_path(rng, names="abc", depth=6):
    return [rng.choice(names) for _ in range(rng.randrange(depth + 1))]


def test_random_paths_over_many_ranges(spark):
    rng = random.Random(11)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts_now, share, closed in ((1, 0.3, False), (7, 0.05, False), (40, 0.3, False), (40, 0.02, True), (16, 0.0, False)):
            spark.conf.set("spark.sql.shuffle.partitions", parts_now)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            asked = [(i, random_path(rng)) for i in range(400)]
            dirs = {tuple(p[:n]) for _, p in asked for n in range(len(p) + 1) if rng.random() < share}
            if closed:
                dirs = {d[:n] for d in dirs for n in range(len(d) + 1)}
            have = spark.createDataFrame([(list(d),) for d in dirs for _ in range(rng.randrange(1, 3))], DIRS)
            got = rows(directory.nearest_ancestors(spark.createDataFrame(asked, ASKED), have))
            assert got == sorted(((i, p, *model(p, dirs)) for i, p in asked), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_folder_over_many_ranges(spark):
    """The only folder of all paths stands in one range, its paths in all."""
    asked = [(i, ["a", f"f{i:04}", "x"]) for i in range(3000)] + [(7, ["a", "same"])] * 1000
    have = spark.createDataFrame([(["a"],), (["a", "f1000"],)], DIRS)
    got = rows(directory.nearest_ancestors(spark.createDataFrame(asked, ASKED).repartition(5), have))
    dirs = {("a",), ("a", "f1000")}
    assert got == sorted(((i, p, *model(p, dirs)) for i, p in asked), key=repr)


def test_nulls_repeats_and_empty_tables(spark):
    asked = [(1, None), (None, ["a", "b"]), (1, ["a"]), (1, ["a"]), (2, []), (3, ["a", "", "b"]), (4, ["x"] * 3000)]
    df = spark.createDataFrame(asked, ASKED)
    dirs = {(), ("a",), ("a", ""), tuple(["x"] * 2000)}
    have = spark.createDataFrame([(list(d),) for d in dirs] + [(None,)], DIRS)
    assert rows(directory.nearest_ancestors(df, have)) == sorted(((i, p, *model(p, dirs)) for i, p in asked), key=repr)
    assert rows(directory.nearest_ancestors(df, have.limit(0))) == sorted(((i, p, None, None) for i, p in asked), key=repr)
    assert rows(directory.nearest_ancestors(df.limit(0), have)) == []


def test_folders(spark):
    rng = random.Random(5)
    files = [random_path(rng, "ab", 7) for _ in range(300)] + [None, [], ["a"]]
    df = spark.createDataFrame([(p,) for p in files], DIRS)
    want = sorted({tuple(p[:n]) for p in files if p is not None for n in range(max(len(p), 1))})
    assert sorted(tuple(r.rel) for r in directory.folders(df).collect()) == want
    assert directory.folders(df.limit(0)).collect() == []


def test_names_in_messages(spark):
    files = spark.createDataFrame([(["a", "b", "c.py"],), (["a", "b", "d.py"],), (["a", "b"],), (["z"],)], DIRS)
    asked = spark.createDataFrame([(1, ["a", "q"]), (2, ["nope"]), (3, ["a", "b", "x", "y"])], ASKED)
    got = {r.id: r.message for r in walk.miss_messages(asked, files, "id").collect()}
    assert got[1].endswith("`q` is not in a/, which contains: b  b/")
    assert got[2].endswith("`nope` is not in the workspace root, which contains: a/  z")
    assert got[3].endswith("`x` is not in a/b/, which contains: c.py  d.py")
