"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bounds of a worker's memory: pieces whose ids it remembers, the characters of such a piece, the characters that are split at a time, the ids that are hashed at a time.
MAX_CACHED = 400_000
MAX_CACHED_CHARS = 48
SPLIT_CHARS = 1 << 20
SPLIT_PIECES = 1 << 17
HASHED_IDS = 1 << 18


def byte_characters() -> list[str]:
    """The character that stands for each byte in the library's vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class ByteBpe:
    """Encoder and decoder of one file of ranks and the pattern that splits texts.

    The library wants merges: a token's are all its splits into two tokens, in the order of ranks. A piece that is a token is taken whole.
    """

    def __init__(self, ranks_file: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(ranks_file)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no rank")
        shown = byte_characters()

        def spell(token: bytes) -> str:
            return "".join(map(shown.__getitem__, token))

        tokens = sorted(ranks, key=ranks.__getitem__)
        merges = [(spell(t[:i]), spell(t[i:])) for t in tokens for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern)
        back = {c: b for b, c in enumerate(shown)}
        vocabulary = self.library.get_vocab()
        self.bytes_of = {i: bytes(map(back.__getitem__, s)) for s, i in vocabulary.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        self.cache: dict[str, bytes] = {}

    def _learn(self, pieces: Iterable[str]) -> list[str]:
        """Have the library encode the pieces that the cache lacks. Returns those that are too long to stay."""
        new = list(set(pieces) - self.cache.keys())
        for piece, found in zip(new, self.library.encode_batch(new, add_special_tokens=False)):
            self.cache[piece] = array("I", found.ids).tobytes()
        return [p for p in new if len(p) > MAX_CACHED_CHARS]

    def _blocks(self, texts: Sequence[str]) -> Iterator[list[list[str]]]:
        """Pieces of each text, for runs of texts of SPLIT_CHARS; of a longer text, a block at a time, the others' being empty."""
        if sum(map(len, texts)) <= SPLIT_CHARS:
            yield [self.split.findall(t) for t in texts]
            return
        for k, text in enumerate(texts):
            matches = self.split.finditer(text)
            while block := [m.group() for m in islice(matches, SPLIT_PIECES)]:
                yield [block if i == k else [] for i in range(len(texts))]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for block in self._blocks(texts):
            if len(self.cache) > MAX_CACHED:
                self.cache.clear()
            long = self._learn(chain.from_iterable(block))
            for ids, pieces in zip(out, block):
                ids.append(b"".join(map(self.cache.__getitem__, pieces)))
            for p in long:
                del self.cache[p]
        return [b"".join(ids) for ids in out]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """What the ids stand for; an id that the vocabulary hasn't raises a KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids. Bytes that make no character become U+FFFD, as do characters that the ids break off."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_each(self, ids: Iterable[int]) -> list[str]:
        """What each id adds to the text: a character split over several comes with the last of them. What is left broken at the end comes with the last id."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.bytes_of[i]) for i in ids]
        if rest := reader.decode(b"", True):
            out[-1] += rest
        return out

    def offsets(self, text: str, ids: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each id in the text; ids that share a split character all have it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        start = np.concatenate([[0], end[:-1]]).astype(np.int64)[: len(ids)]
        return character[start], character[end - 1] + 1


def _digests(codec: ByteBpe, ids: memoryview) -> tuple[str, str]:
    """SHA-256 of the ids in decimal, joined by commas, and of the bytes that they decode to."""
    names, decoded = hashlib.sha256(), hashlib.sha256()
    for at in range(0, len(ids), HASHED_IDS):
        part = ids[at : at + HASHED_IDS]
        names.update(("," if at else "").encode() + ",".join(map(codec.names.__getitem__, part)).encode())
        decoded.update(codec.decode_bytes(part))
    return names.hexdigest(), decoded.hexdigest()


def code_texts(
    docs: DataFrame, ranks_file: str, pattern: str, text_col: str = "text", id_col: str = "doc_id",
    emit_ids: bool = False, emit_offsets: bool = False, carry: Sequence[str] = (),
) -> DataFrame:
    """Encode every whole text, each match of the pattern by itself and without special tokens, and decode the ids.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the decoded bytes); with emit_ids,
    ids array<int>; with emit_offsets, starts and ends array<int>, each id's characters in the text. ranks_file is opened by every
    executor by this path. A null text counts as empty, which has no ids. Ids of rows may be null or repeated; rows keep
    their number. An empty table gives no rows. Columns named in `carry` are returned as they are; others are not read. Very long texts
    are split and hashed block by block.
    """
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), *carry)
    extra = ["ids"] * emit_ids + ["starts", "ends"] * emit_offsets
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} array<int>" for c in extra)
    schema += "".join(f", `{c}` {kind}" for c, kind in row.dtypes[2:])

    def numbers(found: Iterable[np.ndarray]) -> pa.Array:
        return pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or ByteBpe(ranks_file, pattern)
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                coded = [memoryview(raw).cast("I") for raw in codec.encode(texts)]
                sums = [_digests(codec, ids) for ids in coded]
                out = [part.column(0), pa.array(map(len, coded), pa.int64()), *(pa.array([s[k] for s in sums], pa.string()) for k in (0, 1))]
                if emit_ids:
                    out.append(numbers(np.frombuffer(ids, np.uint32) for ids in coded))
                if emit_offsets:
                    spans = [codec.offsets(t, ids) for t, ids in zip(texts, coded)]
                    out += [numbers(s[k] for s in spans) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(out + part.columns[2:], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *extra, *carry])

    return row.mapInArrow(run, schema)


def decode_texts(coded: DataFrame, ranks_file: str, pattern: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """The rows of coded with the text that their ids stand for in column `name`; null ids give null."""
    if name in coded.columns:
        raise ValueError(f"there is a column {name} already")
    at = coded.columns.index(ids_col)
    schema = StructType([*coded.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or ByteBpe(ranks_file, pattern)
            texts = [None if ids is None else codec.decode(ids) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    return coded.mapInArrow(run, schema)
