import hashlib

import pytest
import tiktoken
from helpers import DOCS, clashing, docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from skelmap.llm import byte_bpe, queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBpe(RANKS, PATTERN)


def row_of(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_query_against_the_library(spark, sf, library):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows(queries.op13_byte_bpe(spark, sf)) == sorted((row_of(library, *r) for r in table), key=repr)


def test_awkward_rows(spark, library):
    table = clashing(docs(spark))
    want = sorted((row_of(library, r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=repr)
    assert rows(byte_bpe.code_texts(table, RANKS, PATTERN)) == want
    assert byte_bpe.code_texts(spark.createDataFrame([], DOCS), RANKS, PATTERN).collect() == []


def test_ids_offsets_and_back(spark, library):
    table = docs(spark).withColumn("key", F.lit("clash"))
    out = byte_bpe.code_texts(table, RANKS, PATTERN, emit_ids=True, emit_offsets=True, carry=("key", "n_chars"))
    texts = {(r.doc_id, r.text or "") for r in table.collect()}
    back = byte_bpe.decode_texts(out, RANKS, PATTERN).collect()
    assert {(r.doc_id, r.text) for r in back} == texts and len(back) == table.count()
    for r in back:
        assert r.key == "clash" and r.ids == library.encode_ordinary(r.text)
        assert len(r.ids) == len(r.starts) == len(r.ends) and [b > a for a, b in zip(r.starts, r.ends)] == [True] * len(r.ids)
        assert [*r.starts[:1], *r.ends[-1:]] == ([0, len(r.text)] if r.text else [])
    with pytest.raises(ValueError, match="text already"):
        byte_bpe.decode_texts(table.withColumn("ids", F.array(F.lit(1))), RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'saeéß-_=.0123456789  😀ขहि")), max_size=60))
def test_any_text(codec, library, text):
    ids = list(memoryview(codec.encode([text])[0]).cast("I"))
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text and "".join(codec.decode_each(ids)) == text
    if ids:
        starts, ends = codec.offsets(text, ids)
        want = []  # the library's own spans, piece by piece
        for m in codec.split.finditer(text):
            want += [(m.start() + a, m.start() + b) for a, b in codec.library.encode(m.group()).offsets]
        assert list(zip(starts.tolist(), ends.tolist())) == want


def test_runs_and_ties(codec, library):
    """Runs of one character, where a token has several splits."""
    texts = [c * n for c in (" ", "a", "-", "=", "\n", "e", "0", "é", "ab", " a", "😀") for n in range(1, 200)]
    assert [list(memoryview(x).cast("I")) for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_split_characters(codec):
    ids = [i for b in "a😀".encode() for i in codec.bytes_of if codec.bytes_of[i] == bytes([b])]
    assert codec.decode(ids) == "a😀" and codec.decode_each(ids) == ["a", "", "", "", "😀"]
    assert [x.tolist() for x in codec.offsets("a😀", ids)] == [[0, 1, 1, 1, 1], [1, 2, 2, 2, 2]]
    assert codec.decode(ids[:3]) == "a�" and codec.decode_each(ids[:3]) == ["a", "", "�"]
    assert codec.decode_bytes(ids[:3]) == "a😀".encode()[:3]
    assert codec.decode_each([]) == []
    with pytest.raises(KeyError):
        codec.decode([len(codec.bytes_of)])


def test_long_texts_and_a_full_cache(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SPLIT_CHARS", 50)
    monkeypatch.setattr(byte_bpe, "SPLIT_PIECES", 7)
    monkeypatch.setattr(byte_bpe, "MAX_CACHED", 3)
    monkeypatch.setattr(byte_bpe, "HASHED_IDS", 5)
    texts = ["one two three " * 40, "", "x" * 300, "né 12 !? " * 9]
    coded = codec.encode(texts)
    assert [list(memoryview(x).cast("I")) for x in coded] == [library.encode_ordinary(t) for t in texts]
    assert [byte_bpe._digests(codec, memoryview(x).cast("I")) for x in coded] == [row_of(library, 0, t)[2:] for t in texts]
