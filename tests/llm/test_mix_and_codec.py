import hashlib
import random
import struct
from collections import Counter
from fractions import Fraction

import pytest
from helpers import DOCS, clashing, docs, rows

from skelmap.llm import mixing, sentencepiece_codec
from skelmap.llm.queries import model_file

WEIGHTS = [{"a": 1}, {"a": 1, "b": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 5, "c": 5, "d": 1, "e": 1}, {"a": 97, "b": 2, "c": 1}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_pattern_keeps_each_source_within_a_block(weights):
    total = sum(weights.values())
    slots = mixing.pattern(weights)
    assert Counter(slots) == weights
    done = Counter()
    for t, s in enumerate(slots):
        k = done[s]
        assert k * total // weights[s] <= t < -(-(k + 1) * total // weights[s])
        done[s] += 1
        for x, w in weights.items():
            assert abs(done[x] - Fraction((t + 1) * w, total)) < 1


def test_random_patterns():
    rng = random.Random(1)
    for _ in range(200):
        w = {f"s{i}": rng.randrange(1, 40) for i in range(rng.randrange(1, 9))}
        done, total = Counter(), sum(w.values())
        for t, s in enumerate(mixing.pattern(w), 1):
            done[s] += 1
            assert all(abs(done[x] * total - t * k) < total for x, k in w.items())


def test_every_block_gets_one_slot():
    rng = random.Random(2)
    for _ in range(100):
        blocks = {f"s{i}": rng.randrange(0, 200) for i in range(rng.randrange(1, 7))}
        weights = {s: rng.randrange(1, 9) for s in blocks}
        used = []
        for r in mixing.schedule(blocks, weights):
            n = 0
            for p in r["phases"]:
                assert p["b0"] == n
                for b in range(p["b0"], p["b1"]):
                    q, j = divmod(b - p["b0"], p["w"])
                    used.append(p["start"] + q * p["d"] + p["places"][j])
                n = p["b1"]
            assert n == blocks[r["source"]]
        assert sorted(used) == list(range(sum(blocks.values())))


def brute_slots(blocks, weights):
    """The schedule slot by slot, with every source looked at for every slot and fractions for times."""
    left, done, t0, out = dict(blocks), Counter(), 0, []
    left = {s: n for s, n in left.items() if n}
    while left:
        g = __import__("math").gcd(*(weights[s] for s in left))
        w = {s: weights[s] // g for s in left}
        times = min(n // w[s] for s, n in left.items())
        if not times:
            w, times = {s: min(w[s], n) for s, n in left.items()}, 1
        total = sum(w.values())
        k = Counter()
        for t in range(times * total):
            due = []
            for s in w:
                release, deadline, later = (Fraction((k[s] + j) * total, w[s]) for j in (0, 1, 2))
                if k[s] < times * w[s] and int(release) <= t:
                    # beyond the hyperperiod's end the next deadline doesn't matter: all blocks before it are done by then
                    due.append((-(-deadline.numerator // deadline.denominator), -(-later.numerator // later.denominator), s))
            s = min(due)[2]
            out.append((s, done[s] + k[s], t0 + t))
            k[s] += 1
        done += k
        t0 += times * total
        left = {s: n - k[s] for s, n in left.items() if n > k[s]}
    return out


def test_schedules_against_brute_force():
    """By patterns and slot by slot."""
    rng = random.Random(6)
    for _ in range(60):
        blocks = {f"s{i}": rng.randrange(0, 40) for i in range(rng.randrange(1, 6))}
        weights = {s: rng.randrange(1, 7) for s in blocks}
        want = sorted(brute_slots(blocks, weights))
        assert sorted((s, b, t) for s, b, _, t, _, _ in mixing.slots(blocks, weights)) == want
        got = []
        for r in mixing.schedule(blocks, weights):
            for p in r["phases"]:
                got += [(r["source"], b, p["start"] + (b - p["b0"]) // p["w"] * p["d"] + p["places"][(b - p["b0"]) % p["w"]]) for b in range(p["b0"], p["b1"])]
        assert sorted(got) == want
        assert all(release <= t < deadline for *_, t, release, deadline in mixing.slots(blocks, weights))


def xxh_long(i, seed):
    import xxhash

    return seed if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), seed)


def test_mixture_against_brute_force(spark, sf):
    """op9's rows on the test table: rows in the order of their hashes, blocks by the slot-by-slot schedule."""
    from skelmap.llm import queries

    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()]
    sources = {}
    for i, s in docs:
        h = xxh_long(i, 42)
        h = h - (1 << 64) if h >> 63 else h
        sources.setdefault(s or "(null)", []).append((h, i, s))
    blocks = {s: -(-len(rows) // 8) for s, rows in sources.items()}
    at = {(s, b): t for s, b, t in brute_slots(blocks, {s: queries.MIX_WEIGHTS.get(s, 1) for s in blocks})}
    want = sorted((i, s, n // 8, at[key, n // 8], n % 8) for key, rows in sources.items() for n, (_, i, s) in enumerate(sorted(rows)))
    got = sorted((r.doc_id, r.source, r.mix_block, r.mix_slot, r.mix_at) for r in queries.op9_mixing(spark, sf).collect())
    assert got == want


def test_sources_beyond_the_bounds(spark, monkeypatch):
    """The same mixture, from a table instead of a broadcast."""
    rng = random.Random(9)
    df = spark.createDataFrame([(i, f"t{i}", None, f"s{rng.randrange(40) % rng.randrange(1, 40)}", i) for i in range(900)], DOCS)
    want = sorted(map(repr, mixing.mix(df, {"s0": 3}, block_docs=4).collect()))
    for name, n in (("MAX_SOURCES", 5), ("MAX_SLOTS", 30)):
        with monkeypatch.context() as m:
            m.setattr(mixing, name, n)
            m.setattr(mixing, "WRITE_SLOTS", 100)
            assert sorted(map(repr, mixing.mix(df, {"s0": 3}, block_docs=4).collect())) == want


def test_rows_without_ids_are_spread(spark):
    """Null and equal ids: rows are told apart by their other columns, and dealt over the hash buckets."""
    df = spark.createDataFrame([(None if i % 2 else 7, f"t{i}", None, "a", i) for i in range(400)], DOCS)
    old, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 40
    try:
        first, second = (sorted(map(repr, mixing.mix(d, block_docs=3).collect())) for d in (df, df.repartition(5, "n_chars")))
    finally:
        mixing.BUCKET_ROWS = old
    assert first == second and len(first) == 400


def table(n=700):
    rng = random.Random(3)
    return [(i, f"t{i}", None, rng.choice(["big"] * 6 + ["mid", "mid", "small", None]), i) for i in range(n)]


def test_mix(spark):
    df = spark.createDataFrame(table(), DOCS)
    old, mixing.BUCKET_ROWS = mixing.BUCKET_ROWS, 50
    try:
        got = mixing.mix(df, {"big": 3, "mid": 2}, block_docs=4).collect()
    finally:
        mixing.BUCKET_ROWS = old
    assert Counter(r.doc_id for r in got) == Counter(range(700))
    block = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        assert block.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    sizes = Counter(r.mix_slot for r in got)
    assert sorted(block) == list(range(len(block))) and max(sizes.values()) == 4
    assert len([s for s in sizes if sizes[s] < 4]) <= 4  # the last block of each source
    assert all(sorted(r.mix_at for r in got if r.mix_slot == s) == list(range(n)) for s, n in sizes.items())
    # while all sources last, counts of blocks keep to the weights
    want = {"big": 3, "mid": 2, "small": 1, None: 1}
    first = [r for r in got if r.mix_phase == 0]
    done = Counter()
    for t, s in enumerate(sorted({r.mix_slot for r in first}), 1):
        done[block[s][0]] += 1
        assert all(abs(done[x] - t * w / 7) < 1 for x, w in want.items())


def test_mix_awkward(spark):
    df = docs(spark)
    out = mixing.mix(df, {"a": 2}, block_docs=1)
    assert out.count() == df.count() and sorted(r.mix_slot for r in out.collect()) == list(range(df.count()))
    again = mixing.mix(clashing(df), {"a": 2}, block_docs=1)
    assert sorted((r.mix_slot, repr(r.doc_id)) for r in again.collect()) == sorted((r.mix_slot, repr(r.doc_id)) for r in out.collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.interleave(df.limit(0)).columns == df.columns
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0})


def test_interleave_orders_rows(spark):
    df = spark.createDataFrame(table(200), DOCS)
    slot = {r.doc_id: (r.mix_slot, r.mix_at) for r in mixing.mix(df, {"big": 2}).collect()}
    got = [r.doc_id for r in mixing.interleave(df, {"big": 2}).collect()]
    assert got == sorted(slot, key=slot.get)


def test_mix_runs_no_python(spark):
    plan = mixing.mix(docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))


# --- sentencepiece -------------------------------------------------------------------------------------------------------

HARD = ["", " ", "  a", "a  b ", "▁x ▁", "<s>hi</s><unk>", "<0x0A>", "a\x00b", "日本語 \U0001f600é́", "\n\n", "a\r\nb\tc", " " * 40 + "z", "x" * 300, "　 a", "don't (stop)!", "²., ².x", "a.b,c;d:e", "﻿x", "𝕏", "St. No.", "1,234.56", "á ा ि", "", "hello\n world", " \n "]


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(model_file())


def check(codec, text):
    want = codec.library.encode(text, add_bos=True, add_eos=True)
    ids, back = codec.code(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, repr(text)
    assert back == codec.library.decode(want) == codec.decode(ids), repr(text)


@pytest.mark.parametrize("text", HARD)
def test_codec_is_the_library(codec, text):
    check(codec, text)


def test_codec_on_random_texts(codec):
    rng = random.Random(4)
    pieces = [p.replace("▁", " ") for p in list(codec.ids)[:20_000]]
    marks = list(" \n\t.,;:!?()[]{}'\"-²*“”«»▁") + ["  ", "é", "日", "\U0001f600", "́", "\r"]
    for _ in range(1500):
        check(codec, "".join(rng.choice(pieces if rng.random() < 0.6 else marks) for _ in range(rng.randrange(1, 25))))
    codec.check([], [])


def test_check_finds_a_difference(codec):
    codec.cache.fresh.append(("▁hello", b"\x05\x00\x00\x00"))
    with pytest.raises(ValueError):
        codec.check([], [])


def test_cache_may_be_cleared(codec):
    old, sentencepiece_codec.MAX_CACHED = sentencepiece_codec.MAX_CACHED, 3
    try:
        for t in ["one two three four five", "six seven eight nine", "one\ntwo  three"]:
            check(codec, t)
    finally:
        sentencepiece_codec.MAX_CACHED = old


def test_codec_awkward(spark, codec):
    df = docs(spark)
    want = []
    for r in df.collect():
        ids = codec.library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()))
    want.sort(key=repr)
    assert rows(sentencepiece_codec.code_texts(df, model_file())) == want
    assert rows(sentencepiece_codec.code_texts(clashing(df), model_file())) == want
    assert rows(sentencepiece_codec.code_texts(df.limit(0), model_file())) == []
    for r in sentencepiece_codec.code_texts(df, model_file(), emit_ids=True).collect():
        assert hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest() == r.ids_sha256 and len(r.ids) == r.n_tokens


def test_decoded_text_comes_from_the_ids():
    """With another table of pieces the same ids give another text."""
    codec = sentencepiece_codec.Codec(model_file())
    text = "the quick brown fox"
    ids, back = codec.code(text)
    assert back == codec.decode(ids) == text
    codec.pieces = [p.upper() for p in codec.pieces]
    assert codec.code(text) == (ids, text.upper())
