"""Licence scans by a positional index of rare template words, in DataFrame operations only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places count as base; label and words.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Licences known by a name and a version: label, name, versions. Fixed values, in words of lower case.
FAMILIES = [
    ("gpl", "gnu general public license", ["1", "2", "3"]),
    ("lgpl", "gnu lesser general public license", ["2 1", "3"]),
    ("agpl", "gnu affero general public license", ["1", "3"]),
    ("mpl", "mozilla public license", ["1 0", "1 1", "2 0"]),
]
#: How a version follows a name.
FORMS = ["version {}", "v{}", "v {}", "as published by the free software foundation version {}", "as published by the free software foundation either version {}"]


def family_notices(families: list[tuple[str, str, list[str]]] = FAMILIES) -> list[tuple[str, str, str]]:
    """Each name, alone and with each version in each form; the label of a version leaves out a last 0. A version of two numbers may follow the name by itself."""
    out = []
    for label, name, versions in families:
        out.append((label, name, name))
        for v in versions:
            texts = [f"{name} {form.format(v)}" for form in FORMS] + ([f"{name} {v}"] if " " in v else [])
            major, _, minor = v.partition(" ")
            out += [(f"{label}-{major}" + (f".{minor}" if minor not in ("", "0") else ""), t, t) for t in texts]
    return out


#: Licence notices and texts: label, the text, and in it the key phrase that must stand whole. Fixed values, in words of lower case.
NOTICES = [
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "copies or substantial portions of the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "for any purpose with or without fee is hereby granted",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "specific language governing permissions and limitations under the license",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mozilla public license v 2 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms with or without modification are permitted",
    ),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software",
    ),
    *family_notices(),
]
RARE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, ...]  # places of the key phrase's words
    rare: tuple[int, ...]  # places of the words with the highest IDF
    rarest: int
    base: bool


def templates(base: dict[str, str] = BASE, notices: list[tuple[str, str, str]] = NOTICES, rare: int = RARE) -> list[Template]:
    """The index: for each template the places of its rarest words, by IDF over all templates, ties to the front."""
    texts = [(label, p.split(), p.split(), True) for label, p in base.items()] + [(label, w.split(), k.split(), False) for label, w, k in notices]
    df: dict[str, int] = {}
    for _, w, _, _ in texts:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for label, w, k, is_base in texts:
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        idf = sorted(range(at, at + len(k)), key=lambda i: (-math.log((1 + len(texts)) / (1 + df[w[i]])), i))
        out.append(Template(label, tuple(w), tuple(range(at, at + len(k))), tuple(sorted(idf[:rare])), idf[0], is_base))
    return out


def normalised(text: Column) -> Column:
    """' w1 w2 ... ': lower-cased words between single spaces; ' ' if there are none."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # lower() also maps letters beyond A-Z; the only ones that would turn into ASCII are the Kelvin sign and the dotted capital I
    low = F.when(t.rlike("[Kİ]"), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))
    words = F.btrim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _fence(df: DataFrame, keep: list[str], name: str, value: Column) -> DataFrame:
    """df with value worked out once a row: a generator keeps Catalyst from putting it into each later use."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


TEMPLATE = "struct<label:string,words:array<string>,key:array<string>,key_at:int,rare:int,base:boolean>"


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", base: dict[str, str] = BASE, notices: list[tuple[str, str, str]] = NOTICES, families: list[tuple[str, str, list[str]]] = FAMILIES) -> DataFrame:
    """Licence phrases and labels of every whole text.

    The index posts the rarest words of each template's key phrase, by IDF, with their places. A document's posted words are looked up
    in it, and each names the start at which the template would have to stand; a start that all posted words of a template name is a
    candidate, and counts if the words of the key phrase stand there. Columns: doc_id, n_words, n_base (places of base phrases), first_word,
    last_word (their smallest and largest start, null without one), base_labels, labels (distinct, sorted, comma-joined,
    empty without one), score (largest share of a found template's words that stand in place, 0 without one).
    A family's label (gpl) is left out where one of its versions (gpl-2) is found too, so it tells that no known version is named.
    A null text counts as empty. Rows keep their number, repeated ones too; ids may be null. An empty table gives no rows. Other
    columns are not read. The plan doesn't grow with the templates, and a text's work grows with its words and what is found, however long it is.
    """
    index = templates(base, notices)
    posted: dict[str, list[dict]] = {}
    for k, t in enumerate(index):
        for i in t.rare:
            posted.setdefault(t.words[i], []).append({"t": k, "at": i})
    table = [{"label": t.label, "words": t.words, "key": t.words[t.key[0] : t.key[-1] + 1], "key_at": t.key[0], "rare": len(t.rare), "base": t.base} for t in index]
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  # the optimizer makes it a constant
    postings, found_by = literal(posted, "map<string,array<struct<t:int,at:int>>>"), literal(table, f"array<{TEMPLATE}>")
    rarest = sorted({t.words[t.rarest] for t in index})  # a document without any of these has no template

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    rows = _fence(rows, ["doc_id"], "norm", normalised(F.col("_t")))
    n_words = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1
    words = F.when(F.col("norm").rlike(f" (?:{'|'.join(rarest)}) "), F.split(F.btrim("norm", F.lit(" ")), " ")).otherwise(F.array().cast("array<string>"))
    rows = _fence(rows, ["doc_id", n_words.cast("long").alias("n_words")], "words", words)

    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h.w.isin(sorted(posted)))
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(postings, h.w), lambda p: F.struct(p.t.alias("t"), (h.i - p.at).alias("s")))))
    rows = _fence(rows, ["doc_id", "n_words", "words"], "votes", F.array_sort(votes))
    # equal votes stand together: a start has them all if the vote as many places on is the same
    vote = lambda i: F.get("votes", i)
    firsts = F.filter(F.transform("votes", lambda v, i: F.struct(v.t.alias("t"), v.s.alias("s"), i.alias("i"))), lambda v: vote(v.i - 1).eqNullSafe(F.struct(v.t.alias("t"), v.s.alias("s"))) == F.lit(False))
    whole = F.filter(firsts, lambda v: vote(v.i + F.get(found_by, v.t).rare - 1).eqNullSafe(F.struct(v.t.alias("t"), v.s.alias("s"))))
    stands = lambda v: (v.s + F.get(found_by, v.t).key_at >= 0) & (F.slice("words", F.greatest(v.s + F.get(found_by, v.t).key_at, F.lit(0)) + 1, F.size(F.get(found_by, v.t).key)) == F.get(found_by, v.t).key)
    rows = _fence(rows, ["doc_id", "n_words", "words"], "found", F.filter(whole, stands))

    def cover(v: Column) -> Column:
        own = F.get(found_by, v.t).words
        return F.size(F.filter(F.transform(own, lambda w, i: w == F.get("words", v.s + i)), lambda same: F.coalesce(same, F.lit(False)))) / F.size(own).cast("double")

    def names(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda v: F.get(found_by, v.t).label))), ",")

    plain = F.array(*[F.lit(label) for label, _, _ in families]).cast("array<string>")
    all_names = F.array_distinct(F.transform("found", lambda v: F.get(found_by, v.t).label))
    versioned = lambda name: F.array_contains(plain, name) & F.exists("names", lambda other: other.startswith(F.concat(name, F.lit("-"))))
    labels = F.array_join(F.array_sort(F.filter("names", lambda name: ~versioned(name))), ",")
    rows = _fence(rows, ["doc_id", "n_words", "words", "found"], "names", all_names)

    bases = F.filter("found", lambda v: F.get(found_by, v.t).base)
    at = F.transform(bases, lambda v: v.s)
    score = F.coalesce(F.array_max(F.transform("found", cover)), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size(bases).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), names(bases).alias("base_labels"), labels.alias("labels"), score.alias("score"))
