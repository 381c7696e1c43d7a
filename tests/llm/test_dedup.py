import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from helpers import DOCS, clashing, docs, rows
from pyspark.sql import functions as F

from skelmap.llm import common, exact_dedup, simhash, substring_dedup
from skelmap.llm.common import components, cut


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live = exact_dedup.CuckooIndex(2), {}
    rng = random.Random(1)
    for i in range(5000):
        d = hashlib.sha256(str(rng.randrange(3000)).encode()).digest()
        if d in live:
            assert index.get(d, 1) == live[d] and index.get(d, 2) is None
            if rng.random() < 0.5:
                assert index.delete(d, 1) and not index.delete(d, 1)
                del live[d]
        else:
            assert index.get(d, 1) is None
            index.insert(d, 1, i)
            live[d] = i
    assert index.n == len(live) and index.resizes > 3
    assert {k: p for k, _, p in index.items()} == live


def brute_exact(table):
    groups = defaultdict(list)
    for r in table:
        groups[r[1] or ""].append(r[0])
    out = []
    for r in table:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_awkward(spark):
    df = docs(spark)
    want = brute_exact([tuple(r) for r in df.collect()])
    assert rows(exact_dedup.exact_dedup(df).drop("n_keep")) == want
    assert rows(exact_dedup.exact_dedup(clashing(df)).drop("n_keep")) == want
    assert rows(exact_dedup.exact_dedup(df.limit(0))) == []
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({(r.text or ""): 1 for r in df.collect()})


def test_equal_texts_are_told_by_their_contents(spark, monkeypatch):
    """Digests that two texts share are not used: another salt is."""
    df = docs(spark)
    want = brute_exact([tuple(r) for r in df.collect()])
    own, tried = exact_dedup._digest, []

    def forced(text, salt=0):
        tried.append(salt)
        return F.unhex(F.sha2((F.length(text) % 3).cast("string"), 256)) if salt == 1 else own(text, salt)

    # salt 0 is asked for as the real digest of the output too, so the first that the groups try is made to be 1
    monkeypatch.setattr(exact_dedup, "_digest", forced)
    monkeypatch.setattr(exact_dedup, "numbers", lambda: iter(range(1, 9)))
    assert rows(exact_dedup.exact_dedup(df).drop("n_keep")) == want
    assert {1, 2} <= set(tried)


def test_index_updates(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)], "doc_id long, text string")
    d = exact_dedup.digests(df)
    index = exact_dedup.build_index(d)
    after = exact_dedup.update_index(index, deleted=d.where("doc_id % 3 = 1"), added=exact_dedup.digests(spark.createDataFrame([(20, "t0"), (21, "new")], df.schema)))
    got = sorted((r.keep_id, r.n) for r in exact_dedup.groups_of(after).collect())
    assert got == [(8, 3), (20, 4), (21, 1)]
    # the kept row goes, and the next one is named
    less = exact_dedup.update_index(after, deleted=d.where("doc_id = 8"))
    assert sorted((r.keep_id, r.n) for r in exact_dedup.groups_of(less).collect()) == [(5, 2), (20, 4), (21, 1)]


def test_index_takes_changes_in_any_order(spark):
    """Random additions and deletions in several batches and partitions against a dictionary; deletions may come first."""
    rng = random.Random(4)
    live, batches = Counter(), []
    for _ in range(4):
        batch = []
        for _ in range(300):
            key = (rng.choice([None, *range(12)]), f"t{rng.randrange(8)}")
            sign = rng.choice((1, 1, -1))
            live[key] += sign
            batch.append((*key, sign))
        batches.append(batch)
    index = None
    for batch in batches:
        df = spark.createDataFrame(batch, "doc_id long, text string, sign int").repartition(3)
        changes = exact_dedup.digests(df.where("sign > 0")), exact_dedup.digests(df.where("sign < 0"))
        index = exact_dedup.update_index(index, *changes) if index else exact_dedup.build_index(changes[0].withColumn("n", F.lit(1)).unionByName(changes[1].withColumn("n", F.lit(-1))))
    want = {}
    for text in {t for _, t in live}:
        ids = {i: n for (i, t), n in live.items() if t == text and n > 0}
        if ids:
            keep = max(ids, key=lambda i: (i is not None, i or 0))
            want[hashlib.sha256(text.encode()).digest()] = (keep, sum(ids.values()), ids[keep])
    got = {bytes(r.digest): (r.keep_id, r.n, r.n_keep) for r in exact_dedup.groups_of(index).collect()}
    assert got == want


def brute_simhash(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """Component of each place by comparing all with all."""
    v = np.array(fps, np.uint64)
    up = list(range(len(v)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 3):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(v))]


def test_simhash_awkward(spark):
    df = docs(spark)
    table = [tuple(r) for r in df.collect()]
    fps = [brute_simhash(r[1]) for r in table]
    group = brute_groups(fps)
    least = {g: min((r[0] for r, x in zip(table, group) if x == g and r[0] is not None), default=None) for g in group}
    want = sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(table, fps, group)), key=repr)
    assert rows(simhash.near_groups(df)) == want
    assert rows(simhash.near_groups(clashing(df))) == want
    assert rows(simhash.near_groups(df.limit(0))) == []
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect())[5] == 0


def test_simhash_links_of_close_fingerprints(spark):
    """Planted chains, a dense ball and noise, against all pairs."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {0, 1, 3, 7, 15, (1 << 64) - 1}
    for _ in range(400):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(40, 60), rng.randrange(5))) for _ in range(600)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash._replicas(df).select("anchor", "fp").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(simhash._compare, "a long, b long")
    root = {r.node % (1 << 64): r.root for r in components(links).collect()}
    group = brute_groups(fps)
    mine = defaultdict(set)
    for f, g in zip(fps, group):
        mine[g].add(root.get(f, f))
    assert all(len(x) == 1 for x in mine.values())
    assert len({next(iter(x)) for x in mine.values()}) == len(mine)


def test_dense_run_is_linked_whole():
    rng = np.random.default_rng(3)
    v = np.unique(rng.integers(0, 1 << 14, 12_000, dtype=np.uint64) | np.uint64(7 << 40))
    assert len(v) > 4 * simhash.BLOCK
    assert len(simhash._link_run(v)) == len(v) - 1


def brute_repeats(texts, window):
    words = [[w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_awkward(spark):
    df = docs(spark)
    table = [tuple(r) for r in df.collect()]
    want = sorted([(r[0], *x) for r, x in zip(table, brute_repeats([r[1] for r in table], 35))], key=repr)
    assert rows(substring_dedup.remove_repeats(df)) == want
    assert rows(substring_dedup.remove_repeats(clashing(df))) == want
    assert rows(substring_dedup.remove_repeats(df.limit(0))) == []


def test_substring_planted(spark):
    """Shared passages, overlapping repeats, runs and near misses of one word, over several tasks and group sizes."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (34, 35, 36, 50, 80, 200)]
    texts = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "odd"
            words += p[rng.randrange(3) :] if rng.random() < 0.5 else p
        if i % 10 == 0:
            words += ["run"] * rng.randrange(30, 90)
        if i % 15 == 0:
            words += ["la", "lu"] * 40
        texts.append(" ".join(words) + rng.choice(["", "\n", " \t"]))
    for window, levels, group in ((35, 7, 3 << 20), (35, 9, 2000), (12, 4, 2000)):
        want = sorted([(i, *x) for i, x in enumerate(brute_repeats(texts, window))], key=repr)
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(5)
        old, substring_dedup.GROUP_BYTES = substring_dedup.GROUP_BYTES, group
        try:
            assert rows(substring_dedup.remove_repeats(df, window=window, levels=levels, buckets=7)) == want
        finally:
            substring_dedup.GROUP_BYTES = old


def check_repeats(spark, texts, window=35, **options):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    want = sorted([(i, *x) for i, x in enumerate(brute_repeats(texts, window))], key=repr)
    assert rows(substring_dedup.remove_repeats(df, window=window, **options)) == want


def test_words_that_polynomials_confuse_are_told_apart(spark):
    """Thue-Morse words collide in every polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([f"w{i}" for i in range(17)] + [w] + [f"v{i}" for i in range(17)]) for w in (word, other)]
    assert {x[1] for x in brute_repeats(texts, 35)} == {0}
    check_repeats(spark, texts)
    check_repeats(spark, [*texts, texts[0]])


def half_repeated(seed):
    """Texts that share passages and differ in a word here and there."""
    rng = random.Random(seed)
    passages = [[f"p{p}x{rng.randrange(50)}" for _ in range(60)] for p in range(4)]
    texts = []
    for i in range(40):
        words = [f"own{i}y{rng.randrange(9)}" for _ in range(rng.randrange(20))] + list(rng.choice(passages))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = f"odd{i}"
        texts.append(" ".join(words))
    return texts


def test_windows_are_compared_by_their_words(spark, monkeypatch):
    """Whatever the hashes of windows say: here all are alike."""
    monkeypatch.setattr(substring_dedup, "_window_hashes", lambda words, names, start, size: np.zeros(len(start), np.uint64))
    check_repeats(spark, half_repeated(1))


def test_rows_whose_keys_collide_are_told_apart(spark, monkeypatch):
    """Keys that two texts share are not used: another salt is."""
    own, tried = substring_dedup._row_key, []

    def forced(i, text, salt):
        tried.append(salt)
        if salt < 2:
            return [F.lit(7).cast("long").alias("ka"), (F.length(text) % (salt + 1)).cast("int").alias("kb")]
        return own(i, text, salt)

    monkeypatch.setattr(substring_dedup, "_row_key", forced)
    check_repeats(spark, half_repeated(2))
    assert tried == [0, 1, 2]


def test_one_passage_in_every_text(spark):
    """A hot passage, in more texts than a group holds, and a hot text."""
    passage = " ".join(f"h{i}" for i in range(45))
    texts = [f"s{i} " * (i % 7) + passage + f" e{i}" * (i % 5) for i in range(150)] + [passage] * 50
    old, substring_dedup.GROUP_BYTES = substring_dedup.GROUP_BYTES, 2000
    try:
        check_repeats(spark, texts, buckets=5)
    finally:
        substring_dedup.GROUP_BYTES = old


@pytest.mark.parametrize("at_a_time", [10_000, 3])
def test_many_rows_of_one_id_and_text(spark, monkeypatch, at_a_time):
    """Copies with one id or none collapse before they are sent; their windows still count for other texts, and each row is returned."""
    monkeypatch.setattr(substring_dedup, "COPIES_AT_A_TIME", at_a_time)
    line = " ".join(f"w{i}" for i in range(60))
    table = [(1, line)] * 25 + [(None, "n " + line[:200])] * 10 + [(2, "own words " + " ".join(f"w{i}" for i in range(10, 50)) + " end"), (3, "short"), (3, "short"), (4, "a " * 40), (5, None), (5, None), (1, "another text of id 1")]
    want = [(i, *removed) for (i, _), removed in zip(table, brute_repeats([t or "" for _, t in table], 35))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    assert rows(got) == sorted(want, key=repr)


def test_kept_text(spark):
    line = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, "a " + line + " b"), (2, line + " c"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(df, emit_text=True).collect()}
    assert got == {1: "a b", 2: "c", 3: "short"}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long").select("a", F.col("b"))).count() == 0


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def near_table(seed=11):
    """Texts with copies that differ in some words; unlike ones share common words only."""
    rng = random.Random(seed)
    table, kin = [], {}
    for g in range(40):
        base = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(rng.randrange(60, 250))]
        for c in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(0 if c == 0 else rng.randrange(1, max(2, len(w) // 90))):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
            kin[len(table)] = g
            table.append((len(table), " ".join(w), None, None, None))
    return table, kin


def test_similar_groups(spark):
    table, kin = near_table()
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(table, DOCS)).collect()}
    sets = [shingles(r[1]) for r in table]
    for i in range(len(table)):
        for j in range(i):
            jaccard = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if jaccard >= 0.88:
                assert got[i] == got[j], jaccard
            if kin[i] != kin[j]:
                assert got[i] != got[j]


def test_sketch_is_the_simhash_and_estimates_the_similarity():
    table, _ = near_table(3)
    m = simhash._multipliers()
    with np.errstate(over="ignore"):
        made = [simhash.sketch(t, 5, m) for _, t, *_ in table] + [simhash.sketch(t, 5, m) for t in (None, "", "one", "a b c d e", "x " * 9000)]
    for (fp, _, _), t in zip(made, [r[1] for r in table] + [None, "", "one", "a b c d e", "x " * 9000]):
        assert fp == simhash.simhash(t, 5)
    errors = []
    for i in range(len(table) - 1):
        a, b = shingles(table[i][1]), shingles(table[i + 1][1])
        share = np.mean(np.frombuffer(made[i][1], np.uint8) == np.frombuffer(made[i + 1][1], np.uint8))
        errors.append(abs((share - 1 / 256) / (1 - 1 / 256) - len(a & b) / len(a | b)))
    assert max(errors) < 0.13 and np.mean(errors) < 0.03


def test_large_group_of_near_copies(spark):
    """Copies of one text, each with a word of its own: linked whole."""
    base = [f"w{i}" for i in range(300)]
    rng = random.Random(1)
    table = []
    for i in range(400):
        w = list(base)
        if i:
            w[rng.randrange(300)] = f"own{i}"
        table.append((i, " ".join(w), None, None, None))
    kept = simhash.drop_near_copies(spark.createDataFrame(table, DOCS))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (3, b + " end"), (5, a), (None, a)], "doc_id long, text string")
    assert sorted(map(repr, (tuple(r) for r in simhash.drop_near_copies(df).collect()))) == sorted(map(repr, [(5, a), (3, b + " end"), (None, a)]))


def edge_table(seed=4):
    """Pairs of texts whose similarity is 0.74 to 0.9, most of them near 0.8."""
    rng = random.Random(seed)
    table = []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(rng.randrange(100, 240))]
        cut = round(len(base) * rng.uniform(0.74, 0.9 if g % 3 else 0.84))
        for w in (base, base[:cut] if g % 2 else base[:cut] + [f"new{g}x{i}" for i in range(rng.randrange(4))]):
            table.append((len(table), " ".join(w), None, None, None))
    return table


def brute_classes(table, k=5):
    """Classes by the links of a similarity of 0.8, all with all."""
    sets = [shingles(r[1], k) for r in table]
    up = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_links_are_those_of_the_exact_similarity(spark):
    """From 0.8 on and no less, on both sides of the threshold."""
    table = edge_table()
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(table, DOCS)).collect()}
    want = brute_classes(table)
    assert got == {r[0]: want[i] for i, r in enumerate(table)}
    assert 40 < sum(want[i] == want[i - 1] for i in range(1, len(table), 2)) < 110


def test_texts_of_one_fingerprint_keep_their_own_links(spark):
    """A repeated passage decides the fingerprint; the rest, which differs, decides what else is similar."""
    passage = "a b c d e " * 200
    table = []
    for g in range(12):
        tail = [f"t{g}w{i}" for i in range(60)]
        # the passage outweighs the tail in one text; the other has the same words once, so another fingerprint
        table.append((len(table), passage + " ".join(tail), None, None, None))
        table.append((len(table), "a b c d e a b c d e " + " ".join(tail) + f" end{g}", None, None, None))
    fps = [brute_simhash(r[1], 5) for r in table]
    assert len(set(fps[::2])) == 1 and len(set(fps[1::2])) == 12
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(table, DOCS)).collect()}
    want = brute_classes(table)
    assert want == [i // 2 * 2 for i in range(24)] and got == dict(enumerate(want))  # one fingerprint links no texts that aren't alike


def template_table(n, shared=250, own=45, seed=0):
    """Texts of one template: all pairs have a similarity of about 0.73."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(shared)]
    return [(i, " ".join(common + [f"o{i}x{j}x{rng.random()}" for j in range(own)]), None, None, None) for i in range(n)]


def test_texts_of_a_template_below_the_similarity_all_stay(spark, monkeypatch):
    """Their fingerprints are often within 3 bits and they share bands, in tiles and without."""
    table = template_table(150)
    assert 0.7 < len(shingles(table[0][1]) & shingles(table[1][1])) / len(shingles(table[0][1]) | shingles(table[1][1])) < 0.76
    fps = [simhash.simhash(r[1], 5) for r in table]
    assert any(bin(x ^ y).count("1") <= 3 for i, x in enumerate(fps) for y in fps[:i])
    for tile in (simhash.TILE, 40):
        monkeypatch.setattr(simhash, "TILE", tile)
        assert simhash.drop_near_copies(spark.createDataFrame(table, DOCS)).count() == 150


def test_pairs_within_a_template_are_found_in_tiles(spark, monkeypatch):
    """Near copies among many texts of one template, over several tiles, against all pairs."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng, table = random.Random(8), template_table(60, own=60)
    for i in range(60, 140):
        w = table[rng.randrange(60)][1].split()
        for k in rng.sample(range(len(w)), rng.randrange(1, 10)):
            w[k] = f"new{i}x{k}"
        table.append((i, " ".join(w), None, None, None))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(table, DOCS)).collect()}
    assert got == dict(enumerate(brute_classes(table)))


def test_recall_of_planted_pairs(spark):
    """Pairs of a similarity of 0.8 to 0.9, each with words of its own."""
    rng, table = random.Random(12), []
    for g in range(200):
        base = [f"g{g}w{i}" for i in range(rng.randrange(120, 300))]
        cut = round(len(base) * rng.uniform(0.81, 0.9))
        table += [(len(table), " ".join(base), None, None, None), (len(table) + 1, " ".join(base[:cut]), None, None, None)]
    sets = [shingles(r[1]) for r in table]
    alike = [i for i in range(0, len(table), 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(table, DOCS)).collect()}
    assert len(alike) > 150 and sum(got[i + 1] == i for i in alike) >= 0.98 * len(alike)


def test_similarities_of_a_tile(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 0, 1, 5, 30, 30, 90, 200)]
    source, target = np.array([0, 3, 4, 7]), np.array([1, 2, 4, 5, 6])
    want = [[simhash.jaccard(sets[i], sets[j]) for j in target] for i in source]
    assert np.allclose(simhash.similarities(sets, source, target), want)
    assert simhash.similarities([], np.empty(0, int), np.empty(0, int)).shape == (0, 0)


def test_small_tables_are_few_files_whatever_the_partitions(spark, monkeypatch):
    """Each file is a task and, on a local disk, processes that the executor's JVM starts: 211 partitions wrote 20 tables of up to 211 files each."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(200)]
    table = docs(spark, [(2 * i + k, " ".join(t + ["more"] * k), None, None, 0) for i, t in enumerate(texts) for k in (0, 1)])
    want = rows(simhash.similar_groups(table))
    files = []

    def counted(*args, **kwargs):
        out = cut(*args, **kwargs)
        files.append((args[1], len(list(Path(out.cut_path.removeprefix("file:")).glob("part-*")))))
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    monkeypatch.setattr(common, "cut", counted)
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = rows(simhash.similar_groups(table))
        small = [f for f in files if f[0] not in ("simhash-sketches", "simhash-open")]
        points = spark.range(50).repartition(24, "id").withColumn("node", F.monotonically_increasing_id())
        parted = common.cut(points, "parted", rows=50, a_file=10)
        assert sorted(r.id for r in parted.collect()) == list(range(50)) and parted.select("node").distinct().count() == 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and files[-1] == ("parted", 6)
    assert len(small) > 12 and {n for _, n in small} == {1}
    assert {r[0] // 2 * 2 for r in want} == {r[2] for r in want}  # each pair is linked
