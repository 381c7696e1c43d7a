import random
import re
from collections import Counter

import pytest
from helpers import AWKWARD, DOCS, clashing, docs, rows

from skelmap.llm import collocations


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(table, min_count, max_words, top, percent):
    f, n = Counter(), Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= min_count}
    longest = Counter()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longest[lang, p[i : i + k]] = max(longest[lang, p[i : i + k]], a)
    out = []
    for (lang, p), a in candidates.items():
        if longest[lang, p] and 100 * longest[lang, p] >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    found = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        found += [(lang, k, *r[1:]) for k, r in enumerate(mine[:top], 1)]
    return sorted(found, key=repr)


def made(n, seed):
    r = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "é", "a-b", "日本", "x"]
    fixed = ["new york city hall", "of the new york", "é é é é é é", "one two three four five six"]
    out = []
    for _ in range(n):
        parts = [r.choice(words) if r.random() < 0.7 else r.choice(fixed) for _ in range(r.randrange(25))]
        text = "".join(p + r.choice([" ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", "?!"]) for p in parts)
        out.append((r.choice(["en", "en", "de", None, "und"]), text))
    return out


@pytest.mark.parametrize("min_count,max_words,top,percent,chunk", [(3, 5, 2000, 100, 1 << 20), (2, 4, 7, 60, 40), (1, 3, 50, 100, 1), (5, 2, 2000, 100, 200), (4, 7, None, 100, 90)])
def test_against_brute_force(spark, monkeypatch, min_count, max_words, top, percent, chunk):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "TEXT_BYTES", chunk)
    table = made(150, min_count)
    df = spark.createDataFrame(table, "lang string, text string").repartition(3)
    got = collocations.collocations(df, min_count=min_count, max_words=max_words, top=top, subsumed_percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows(got) == brute(table, min_count, max_words, top, percent)


def test_awkward_rows(spark):
    table = AWKWARD + [(i, "Same words here. same\twords, here", None, "a", 1) for i in range(20)]
    got = rows(collocations.collocations(clashing(docs(spark, table)), min_count=2))
    assert got == brute([(r[2], r[1]) for r in table], 2, 5, 2000, 100)
    assert any(r[2] == "word word" or "word word word word word" == r[2] for r in got)
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(f"{10**16}", 10**16, 10**16, 10**16, 9 * 10**16), ("odd", 10**15 + 1, 10**15 + 3, 10**15 + 7, 10**16 + 9)]
    df = spark.createDataFrame([(p, a, [l, a], [r, a], n) for p, a, l, r, n in big], "p string, f long, lefts array<long>, rights array<long>, n long")
    got = {r.p: r.cut.score for r in df.select("p", collocations._cuts(2).alias("cut")).collect()}
    assert got == {p: 1000 * a * n // (l * r) for p, a, l, r, n in big}


def test_long_texts_are_parted_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "TEXT_BYTES", 10)
    text = "one two three four. five,six;\n seven eight nine ten eleven!"
    parts = list(collocations.piece_words(text))
    assert len(parts) > 2 and sum(parts, []) == b"one two three four . five . six . . seven eight nine ten eleven .".split()
