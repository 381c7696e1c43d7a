"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies by a score-ordered agenda."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MAX_CACHED = 700_000
MAX_CACHED_CHARS = 48


class Cache(dict):
    """Chunk to its little-endian ids; long chunks are worked out again each time."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.fresh: list[tuple[str, bytes]] = []

    def __missing__(self, chunk: str) -> bytes:
        ids = self.codec.piece_ids(chunk)
        found = array("I", ids).tobytes()
        self.fresh.append((chunk, found))
        if len(chunk) <= MAX_CACHED_CHARS:
            self[chunk] = found
        return found


class Words(dict):
    """Word, with the space before it, to the ids of its chunks."""

    def __init__(self, codec: Codec):
        super().__init__({"": b""})
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        found = b"".join(map(self.codec.cache.__getitem__, self.codec.split.findall(word)))
        if len(word) <= MAX_CACHED_CHARS:
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of one model file; the model gives pieces, scores and kinds, the merging is done here."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes_ids = [-1] * 256
        self.pieces: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_ids[int(p[3:5], 16)] = i
                self.pieces.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.pieces.append(b"")
            elif sp.is_unknown(i):
                self.pieces.append(" ⁇ ".encode())
            else:
                if sp.is_unused(i):
                    raise ValueError("unused pieces are not supported")
                self.ids[p] = i
                self.pieces.append(p.replace(SPACE, " ").encode())
        scores = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        order = {x: r for r, x in enumerate(scores)}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        alone, self.split = self._splitter()
        self.whole = "\n" not in alone
        self.cache, self.words = Cache(self), Words(self)
        self.ends = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")

    def _splitter(self) -> tuple[str, re.Pattern]:
        """Line breaks and the like that are in no piece, and a pattern that cuts a text where no piece goes across.

        A cut is safe between two characters that stand side by side in no piece. If no piece has a space after another
        character, each run of spaces begins a chunk. Marks that no piece has in front of other characters end one; after a
        character that some piece has in front of a mark the chunk goes on to the next space.
        """
        sides = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        if any(a != SPACE and b == SPACE for a, b in sides):
            return "", re.compile(r"(?s).+")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        marks = {c for p in self.ids for c in p if not c.isalnum() and c != SPACE} - set(alone)
        while True:
            front = [b for a, b in sides if b in marks and a not in marks and a != SPACE]
            joined = {a for a, b in sides if a in marks and b not in marks and b != SPACE} | {b for b in front if front.count(b) > 2}
            if not joined:
                break
            marks -= joined
        tied = {a for a, b in sides if b in marks and a not in marks and a != SPACE}
        each = lambda chars: "".join(map(re.escape, sorted(chars)))
        word = f"{SPACE}*[^{SPACE}{alone}{each(marks)}]+"
        word += f"(?:(?<=[{each(tied)}])[{each(marks)}][^{SPACE}{alone}]*)?" if tied and marks else ""
        return alone, re.compile("|".join([word, *([f"{SPACE}*[{each(marks)}]+"] if marks else []), f"{SPACE}+", *([f"[{alone}]"] if alone else [])]))

    def merge(self, chunk: str) -> list[str]:
        """Symbols of chunk after all merges: of the adjacent pairs that form a piece, the best score first, leftmost on ties.

        An agenda entry is rank << 32 | place of the left symbol; it is stale, and skipped, if the pair there has another rank by now.
        """
        sym, rank = list(chunk), self.rank.get
        n = len(sym)
        if n == 1:
            return sym
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r << 32 | i for i, r in enumerate(map(rank, map(add, sym, sym[1:]))) if r is not None]
        heapify(agenda)
        while agenda:
            e = heappop(agenda)
            i = e & 0xFFFFFFFF
            j = right[i]
            if j >= n or sym[i] is None or rank(p := sym[i] + sym[j]) != e >> 32:
                continue
            sym[i], sym[j] = p, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank(p + sym[k])) is not None:
                    heappush(agenda, r << 32 | i)
            k = left[i]
            if k >= 0 and (r := rank(sym[k] + p)) is not None:
                heappush(agenda, r << 32 | k)
        return [s for s in sym if s is not None]

    def piece_ids(self, chunk: str) -> list[int]:
        get, out = self.ids.get, []
        for s in self.merge(chunk):
            if (i := get(s)) is not None:
                out.append(i)
            else:
                raw = [self.bytes_ids[b] for b in s.encode("utf-8")]
                out.extend(raw if min(raw) >= 0 else [self.unk])
        return out

    def chunks(self, text: str) -> list[str]:
        return self.split.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end ids, as little-endian unsigned 32-bit integers."""
        return self.code(text)[0]

    def code(self, text: str | None) -> tuple[bytes, str]:
        """encode(text), and decode() of those ids."""
        for held in (self.cache, self.words):
            if len(held) > MAX_CACHED:
                held.clear()
                held.update({} if held is self.cache else {"": b""})
        text = text or ""
        if self.whole or not text or text[0] == " " or "  " in text or SPACE in text:
            ids = b"".join(map(self.cache.__getitem__, self.chunks(text)))
        else:  # no runs of spaces: words are what stands between single spaces and line breaks
            words = (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")
            ids = b"".join(map(self.words.__getitem__, words))
        ids = self.ends[0] + ids + self.ends[1]
        return ids, self.decode(ids)

    def check(self, texts: list[str], ids: list[bytes]) -> None:
        """Hold what was worked out since the last check against the library; a difference raises an error.

        Where merges stay within chunks, these are the chunks that the cache hadn't: a line break in front keeps the library's
        dummy space off them. Otherwise they are the texts.
        """
        fresh, self.cache.fresh = self.cache.fresh, []
        if self.whole:
            pairs, skip = zip(self.library.encode(texts, add_bos=True, add_eos=True), ids), 0
        else:
            pairs, skip = zip(self.library.encode(["\n" + c.replace(SPACE, " ") for c, _ in fresh]), [i for _, i in fresh]), 2
        for want, got in pairs:
            if array("I", want[skip:]).tobytes() != got:
                raise ValueError("the agenda and the sentencepiece library differ")

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids; the space that encoding puts in front goes."""
        raw = b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def code_texts(docs: DataFrame, model_file: str, text_col: str = "text", id_col: str = "doc_id", verify: bool = True, emit_ids: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with emit_ids, ids array<int>.

    model_file: a BPE model with identity normalisation and a leading dummy space; every executor opens it by this path. With
    verify, each Arrow batch's texts (word chunks that the worker hasn't met, where no piece crosses chunks) are also encoded by the
    sentencepiece library; a difference raises an error.
    A null text counts as empty and encodes to the begin and end ids. Rows keep their order and number; ids may be null or
    repeated. An empty table gives no rows. Columns named in `carry` are returned as they are; others are not read.
    """
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t"), *carry)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * emit_ids
    schema += "".join(f", `{c}` {kind}" for c, kind in row.dtypes[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = None
        for b in batches:
            codec = codec or Codec(model_file)
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                both = [codec.code(t) for t in texts]
                if verify:
                    codec.check(texts, [ids for ids, _ in both])
                sha = [hashlib.sha256(ids).hexdigest() for ids, _ in both]
                back = [hashlib.sha256(t.encode()).hexdigest() for _, t in both]
                out = [part.column(0), pa.array([len(ids) // 4 for ids, _ in both], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if emit_ids:
                    out.append(pa.array([np.frombuffer(ids, np.uint32).astype(np.int32) for ids, _ in both], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out + part.columns[2:], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * emit_ids + list(carry))

    return row.mapInArrow(run, schema)
