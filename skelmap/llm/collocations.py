"""Phrase collocations by hierarchical pair naming: a phrase of k words is named by the pair of its phrases of k - 1 words."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_of, cut, discard, partitions_of

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: A phrase goes if a longer one that has its words is at least this share of its occurrences.
SUBSUMED_PERCENT = 100
UNKNOWN_LANG = "und"
#: Words of a chunk, the unit in which phrases are counted before they are sent; a text is parted between pieces of this many bytes.
CHUNK_WORDS = 1 << 20
TEXT_BYTES = 4 << 20
#: A chunk is named by its partition and its number there.
CHUNK_BITS = 31

#: A-Z become a-z, the marks and line breaks that end pieces a full stop, tabs spaces.
_PIECE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


class Numbers(dict):
    """Word to its number in the chunk; what parts pieces is -1."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__({b".": -1})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append((self.lang, word))
        return n


def piece_words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, with b"." where one piece ends and the next begins; a long text comes in parts."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_PIECE_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b".", at + TEXT_BYTES)
        part = raw[at : end if end >= 0 else len(raw)]
        yield part.replace(b".", b" . ").split()
        at += len(part)


def _pack(a: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes together, then all second ones, and so on: high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _squeezed(seq: np.ndarray) -> np.ndarray:
    """seq with each run of gaps made one; those at the ends go."""
    keep = seq >= 0
    keep[1:] |= keep[:-1].copy()
    seq = seq[keep]
    return seq[:-1] if len(seq) and seq[-1] < 0 else seq


def _chunks(docs: DataFrame, text_col: str, lang_col: str, buckets: int) -> DataFrame:
    """All words in order, as numbers, CHUNK_WORDS or a few more in a row: chunk, seq, langs and sizes (the languages' words), and messages.

    The messages tell each bucket the words that fall to it: a language, its words and their counts. Numbers go by the order of messages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, made = TaskContext.get().partitionId(), 0
        names: list[tuple[str, bytes]] = []
        numbers: dict[str, Numbers] = {}
        seqs: list[np.ndarray] = []
        size = 0

        def done() -> pa.RecordBatch:
            seq = _squeezed(np.concatenate(seqs))
            counts = np.bincount(seq[seq >= 0], minlength=len(names))
            bucket = [crc32(w, crc32(lang.encode("utf-8", "surrogatepass"))) % buckets for lang, w in names]
            order = sorted(range(len(names)), key=lambda i: (bucket[i], names[i]))
            number = np.full(len(names) + 1, -1, np.int32)  # the last is that of gaps
            number[order] = np.arange(len(names), dtype=np.int32)
            counts = counts[order]
            messages, sizes = [], dict.fromkeys(numbers, 0)
            at = 0
            while at < len(order):
                here, lang = bucket[order[at]], names[order[at]][0]
                end = at
                while end < len(order) and bucket[order[end]] == here and names[order[end]][0] == lang:
                    end += 1
                messages.append((here, lang, b" ".join(names[i][1] for i in order[at:end]), _pack(counts[at:end])))
                sizes[lang] += int(counts[at:end].sum())
                at = end
            message = pa.struct([("bucket", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("counts", pa.binary())])
            rows = [[partition << CHUNK_BITS | made], [_pack(number[seq])], [list(sizes)], [list(sizes.values())], [[dict(zip(("bucket", "lang", "words", "counts"), m)) for m in messages]]]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(message)]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["chunk", "seq", "langs", "sizes", "messages"])

        gap = np.array([-1], np.int32)
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang = lang.as_py()
                if lang not in numbers:
                    numbers[lang] = Numbers(lang, names)
                for words in piece_words(text.as_py()):
                    seqs += [np.fromiter(map(numbers[lang].__getitem__, words), np.int32, len(words)), gap]
                    size += len(words)
                    if size >= CHUNK_WORDS and names:
                        yield done()
                        made += 1
                        names, numbers, seqs, size = [], {}, [], 0
                        numbers[lang] = Numbers(lang, names)
        if names:
            yield done()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_col).cast("string").alias("_t"))
    return rows.mapInArrow(run, "chunk long, seq binary, langs array<string>, sizes array<bigint>, messages array<struct<bucket:int, lang:string, words:binary, counts:binary>>")


def _pairs(seq: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of adjacent names: their buckets, left and right ids and counts, by bucket, and where pairs begin and which each of these is."""
    begins = (seq[:-1] >= 0) & (seq[1:] >= 0)
    code = seq[:-1][begins].astype(np.int64) << 32 | seq[1:][begins]
    codes, which, counts = np.unique(code, return_inverse=True, return_counts=True)
    left, right = ids[codes >> 32], ids[codes & 0xFFFFFFFF]
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (right.astype(np.uint64) + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    bucket = ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((right, left, bucket))
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order), dtype=np.int32)
    return bucket[order].astype(np.int32), left[order], right[order], counts[order], begins, back[which]


def _pair_messages(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, part and the pairs of the chunk that fall to the bucket: lefts, rights and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, seq, ids in zip(*(b.column(i) for i in range(3))):
                bucket, left, right, count, _, _ = _pairs(_unpack(seq.as_py(), np.int32), _unpack(ids.as_py(), np.int64), buckets)
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)] if len(bucket) else []
                spans = list(zip(edges, edges[1:]))
                columns = [pa.array(bucket[edges[:-1]]), pa.array([chunk.as_py()] * len(spans), pa.int64()), pa.array(range(len(spans)), pa.int32())]
                columns += [pa.array([_pack(x[i:j]) for i, j in spans], pa.binary()) for x in (left, right, count)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "part", "lefts", "rights", "counts"])

    return chunks.select("chunk", "seq", "ids").mapInArrow(run, "bucket int, chunk long, part int, lefts binary, rights binary, counts binary")


#: What a bucket finds: rows (chunk, part, ids), which answer a message, each item's name or -1, and rows of the frequent phrases.
FOUND = "chunk long, part int, ids binary, id long, left long, right long, lang string, word string, f long"


def _answers(rows: list[tuple[int, int]], ids: list[np.ndarray]) -> pa.RecordBatch:
    empty = [pa.nulls(len(rows), k) for k in [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]]
    columns = [pa.array([c for c, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.int32()), pa.array(map(_pack, ids), pa.binary()), *empty]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def _phrases(n: int, **columns) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "part": pa.int32(), "ids": pa.binary(), "id": pa.int64(), "left": pa.int64(), "right": pa.int64(), "lang": pa.string(), "word": pa.string(), "f": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The messages to each bucket, in the order of chunks and parts. Rows come sorted by bucket."""
    at, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != at:
                if held:
                    yield at, sorted(held)
                at, held = row[0], []
            held.append(row[1:])
    if held:
        yield at, sorted(held)


def _count_words(messages: DataFrame, min_count: int) -> DataFrame:
    """FOUND for words: the frequent ones of each bucket are named by it and their place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            counts: dict[str, dict[bytes, int]] = {}
            for _, _, lang, words, n in rows:
                f = counts.setdefault(lang, {})
                for w, c in zip(words.split(b" "), _unpack(n, np.int64).tolist()):
                    f[w] = f.get(w, 0) + c
            found = [(lang, w, n) for lang in sorted(counts) for w, n in sorted(counts[lang].items()) if n >= min_count]
            names = {lang: {} for lang in counts}
            for i, (lang, w, _) in enumerate(found):
                names[lang][w] = bucket << 32 | i
            yield _answers([r[:2] for r in rows], [np.array([names[lang].get(w, -1) for w in words.split(b" ")], np.int64) for _, _, lang, words, _ in rows])
            columns = {"id": [bucket << 32 | i for i in range(len(found))], "lang": [x for x, _, _ in found], "word": [w.decode("utf-8", "surrogatepass") for _, w, _ in found], "f": [n for _, _, n in found]}
            yield _phrases(len(found), **columns)

    return messages.mapInArrow(run, FOUND)


def _count_pairs(messages: DataFrame, min_count: int) -> DataFrame:
    """FOUND for pairs of names. A pair comes once a chunk, so what a bucket holds grows with the pairs, not with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            parts = [[_unpack(r[k], np.int64) for r in rows] for k in (2, 3, 4)]
            left, right, count = map(np.concatenate, parts)
            order = np.lexsort((right, left))
            x, y = left[order], right[order]
            first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            start = np.flatnonzero(first)
            f = np.add.reduceat(count[order], start)
            often = f >= min_count
            name = np.where(often, (np.cumsum(often) - 1) | np.int64(bucket) << 32, -1)
            ids = np.empty(len(order), np.int64)
            ids[order] = name[np.cumsum(first) - 1]
            yield _answers([r[:2] for r in rows], np.split(ids, np.cumsum([len(p) for p in parts[0]])[:-1]))
            yield _phrases(int(often.sum()), id=name[often], left=x[start][often], right=y[start][often], f=f[often])

    return messages.mapInArrow(run, FOUND)


def _renamed(chunks: DataFrame, found: DataFrame, partitions: int, buckets: int, pairs: bool) -> DataFrame:
    """The chunks with names in place of words or of pairs of names: chunk, seq and ids, the names of seq's numbers.

    What is in no frequent phrase is a gap; numbers go by frequency in the chunk. A chunk meets the answers to it in one task, which
    holds one chunk at a time.
    """

    def renamed(seq: np.ndarray, old: np.ndarray | None, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if pairs:
            _, _, _, _, begins, which = _pairs(seq, old, buckets)
            seq = np.full(len(begins), -1, np.int32)
            seq[begins] = which
        often = np.append(answer >= 0, False)  # the last is that of gaps
        count = np.bincount(seq[often[seq]], minlength=len(answer))
        order = np.argsort(-count, kind="stable")[: int(often.sum())]
        number = np.full(len(often), -1, np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        return _squeezed(number[seq]), answer[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, old, answers = None, None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            answer = np.concatenate(answers) if answers else np.empty(0, np.int64)
            if (answer >= 0).any():
                new, ids = renamed(seq, old, answer)
                out = [pa.array([at], pa.int64()), pa.array([_pack(new)], pa.binary()), pa.array([_pack(ids)], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["chunk", "seq", "ids"])

        for b in batches:
            for chunk, part, ids, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if part < 0:  # a chunk's first row is its own
                    yield from done()
                    at, answers = chunk, []
                    seq, old = _unpack(raw.as_py(), np.int32), _unpack(ids.as_py(), np.int64) if pairs else None
                else:
                    answers.append(_unpack(ids.as_py(), np.int64))
        yield from done()

    none = F.lit(None).cast("binary")
    rows = chunks.select("chunk", F.lit(-1).alias("part"), "ids" if pairs else none.alias("ids"), "seq").unionByName(found.where("chunk IS NOT NULL").select("chunk", "part", "ids", none.alias("seq")))
    return rows.repartition(partitions, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(run, "chunk long, seq binary, ids binary")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1 to max_words words, a table for each length, and each language's number of words (lang, n).

    Columns: id, left and right (ids of the phrase without its last and its first word), lang, phrase, last (word), f, and
    lefts and rights (f of its first and of its last 1, 2, ... words).

    Names are global. Each chunk sends its distinct words, then its distinct pairs of names, with their counts to the buckets they fall to; a
    bucket adds up, names what is frequent and answers, and the chunk is written anew in these names. A phrase is frequent only if
    both its parts are, so only these are paired.
    """
    partitions, buckets = partitions_of(docs), buckets_of(docs)
    chunks = cut(_chunks(docs, text_col, lang_col, buckets), "phrases-words", "none")
    totals = chunks.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy("x.langs").agg(F.sum("x.sizes").alias("n"))
    totals = cut(totals.withColumnRenamed("langs", "lang"), "phrases-langs", "none")
    messages = chunks.select("chunk", F.posexplode("messages").alias("part", "m")).select("m.bucket", "chunk", "part", "m.lang", "m.words", "m.counts")
    found = cut(_count_words(messages.repartition(partitions, "bucket").sortWithinPartitions("bucket"), min_count), "phrases-1", "none")
    f, none = F.array("f"), F.lit(None).cast("long")
    one = found.where("id IS NOT NULL").select("id", none.alias("left"), none.alias("right"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", f.alias("lefts"), f.alias("rights"))
    tables = [cut(one, "phrases-table-1")]
    for k in range(2, max_words + 1):
        before = chunks, found
        chunks = cut(_renamed(chunks, found, partitions, buckets, pairs=k > 2), f"phrases-chunks-{k}", "none")
        discard(*before)
        found = cut(_count_pairs(_pair_messages(chunks, buckets).repartition(partitions, "bucket").sortWithinPartitions("bucket"), min_count), f"phrases-{k}", "none")
        parts = tables[-1].select("id", "lang", "phrase", "last", "lefts", "rights")
        left = parts.select(F.col("id").alias("left"), "lang", "phrase", "lefts")
        right = parts.select(F.col("id").alias("right"), "last", "rights")
        new = found.where("id IS NOT NULL").select("id", "left", "right", "f").join(left, "left").join(right, "right")
        new = new.select("id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("lefts", F.array("f")).alias("lefts"), F.concat("rights", F.array("f")).alias("rights"))
        tables.append(cut(new, f"phrases-table-{k}"))
    discard(chunks, found)
    return tables, totals


def _cuts(k: int):
    """The lowest-scoring cut of a phrase of k words, ties to the smallest first part: score, at, l and r. Products are decimals of 38 digits."""
    number = "CAST({} AS DECIMAL(17,0))".format

    def each(at: int):
        l, r = f"lefts[{at - 1}]", f"rights[{k - at - 1}]"
        score = F.expr(f"({number('f')} * {number('n')} * CAST(1000 AS DECIMAL(4,0))) DIV ({number(l)} * {number(r)})")
        return F.struct(score.alias("score"), F.lit(at).alias("at"), F.expr(l).alias("l"), F.expr(r).alias("r"))

    return F.array_min(F.array(*map(each, range(1, k))))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    top: int | None = TOP, subsumed_percent: int = SUBSUMED_PERCENT,
) -> DataFrame:
    """Phrases of 2 to max_words words that stand together more often than their parts would by chance, each language's best `top`.

    Columns: lang, rank, phrase, a (its occurrences), l and r (those of the parts of its lowest-scoring cut), n (the language's words), score
    (floor(1000 * a * n / (l * r)), exactly). A phrase that lies in a longer one goes if that has subsumed_percent of its
    occurrences or more; as no phrase is more frequent than what it holds, phrases longer by one word tell.

    Words stand between spaces and tabs, pieces between marks and line breaks; phrases don't go beyond a piece. A null text has no words,
    a null language is UNKNOWN_LANG. Repeated rows all count. Very long texts are taken part by part, between pieces. An empty table
    gives no rows. Other columns are not read, so their names can't clash. With top=None all phrases are returned.
    """
    tables, totals = phrases(docs, text_col, lang_col, min_count, max_words)
    found = []
    for k in range(2, max_words + 1):
        rows = tables[k - 1]
        if k < max_words:
            longer = tables[k].select(F.col("left").alias("_id"), F.col("f").alias("_f")).unionByName(tables[k].select(F.col("right").alias("_id"), F.col("f").alias("_f")))
            longest = longer.groupBy("_id").agg(F.max("_f").alias("_f"))
            rows = rows.join(longest, F.col("id") == F.col("_id"), "left").where(F.col("_f").isNull() | (F.col("_f") * 100 < F.col("f") * subsumed_percent))
        found.append(rows.join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "n", _cuts(k).alias("cut")))
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    every = every.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = every.withColumn("rank", rank.cast("long"))
    if top is not None:
        ranked = every.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
