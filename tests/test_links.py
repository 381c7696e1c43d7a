import os
import random

from skelmap.operators import links

NAMES = ["a", "b", "c", "d"]


def grow(path, rng, depth):
    for name in NAMES:
        full = os.path.join(path, name)
        kind = rng.random()
        if kind < 0.4 and depth:
            os.mkdir(full)
            grow(full, rng, depth - 1)
        elif kind < 0.8:
            up = "/".join([".."] * rng.randrange(3))
            to = "/".join(rng.choice([*NAMES, ".", ".."]) for _ in range(rng.randrange(1, 4)))
            os.symlink(rng.choice([to, f"{up}/{to}".lstrip("/"), os.path.join(path, to)]), full)


def places(root):
    for folder, dirs, files in os.walk(root):
        for n in dirs + files:
            if os.path.islink(full := os.path.join(folder, n)):
                yield full.split("/")[1:], os.readlink(full)


LINKS = 12


def brute(parts, at):
    """Component by component: where a path leads, or None for a loop."""
    done, rest, hops = [], list(parts), 0
    while rest:
        x = rest.pop(0)
        if x == "..":
            done = done[:-1]
        elif x not in ("", "."):
            target = at.get((*done, x))
            if target is None:
                done = [*done, x]
                continue
            hops += 1
            if hops > LINKS:
                return None
            done, rest = [] if target.startswith("/") else done, target.split("/") + rest
    return done


def test_paths_lead_where_the_system_says(spark, tmp_path):
    """Random trees with links to anywhere, loops among them, and paths with steps back."""
    root, rng = os.path.realpath(tmp_path), random.Random(21)
    grow(root, rng, 3)
    table = [(i, [*root.split("/")[1:], *(rng.choice([*NAMES, *NAMES, "..", ".", ""]) for _ in range(rng.randrange(7)))]) for i in range(600)]
    at = list(places(root))
    known = {tuple(p): t for p, t in at}
    got = links.resolved(spark.createDataFrame(table, "id long, parts array<string>"), spark.createDataFrame(at, "at array<string>, target string"), max_links=LINKS).collect()
    assert len(got) == 600 and len(at) > 10
    seen = {"loop": 0, "other": 0}
    for r in got:
        want, path = brute(r.parts, known), "/" + "/".join(r.parts)
        assert (r.real, r.looped) == (want, want is None)
        if want is None:
            seen["loop"] += 1
        else:
            seen["other"] += r.real != [p for p in r.parts if p not in ("", ".")]
            assert "/" + "/".join(r.real) == os.path.realpath(path), path
    assert seen["loop"] > 10 and seen["other"] > 50


def test_awkward_rows(spark):
    table = [(1, None), (1, []), (1, [".."]), (2, ["x", "y"]), (2, ["x", "y"]), (3, ["l", "..", "z"])]
    at = [(["l"], "/p/q/"), (["l"], "/z"), (["x"], "x"), (["p", "q"], "../r")]
    paths = spark.createDataFrame(table, "hops int, parts array<string>").selectExpr("hops", "parts", "'clash' AS rest")
    got = links.resolved(paths, spark.createDataFrame(at, "at array<string>, target string"), max_links=5)
    assert got.columns == ["hops", "parts", "rest", "real", "looped"]
    want = [(1, None, None, False), (1, [], [], False), (1, [".."], [], False), (2, ["x", "y"], None, True), (2, ["x", "y"], None, True), (3, ["l", "..", "z"], ["z"], False)]
    assert sorted(map(repr, ((r.hops, r.parts, r.real, r.looped) for r in got.collect()))) == sorted(map(repr, want))
    none = spark.createDataFrame([], "at array<string>, target string")
    assert [r.real for r in links.resolved(paths.where("hops = 2"), none).collect()] == [["x", "y"]] * 2
    assert links.resolved(paths.limit(0), none).collect() == []
