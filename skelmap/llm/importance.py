"""Target-distribution importance resampling on hashed word runs, worked out once for each text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
#: A text that over one row in so many has is hot; there are fewer hot texts than this.
HOT_SHARE = 1000

#: A-Z become a-z; of the other bytes those of digits, of a-z and of characters beyond ASCII stay, the rest part words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def features(text: str | None, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of 1 to `longest` consecutive words, repeats included."""
    words = words_of(text)
    found = [np.fromiter(map(crc32, words), np.uint32, len(words))]
    for n in range(2, min(longest, len(words)) + 1):
        runs = map(b" ".join, zip(*(words[i:] for i in range(n))))
        found.append(np.fromiter(map(crc32, runs), np.uint32, len(words) - n + 1))
    return np.concatenate(found) % np.uint32(buckets)


def _distinct(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """One row a text, grouped by the whole text: digest (SHA-256), copies, n_words, n_features and its features as bytes."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(0).to_pylist()
                found = [features(t, longest, buckets) for t in texts]
                words = [len(f) for f in found] if longest == 1 else [len(words_of(t)) for t in texts]
                digests = [sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                columns = [pa.array(digests, pa.binary()), part.column(1), pa.array(words, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([f.astype(kind).tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "copies", "n_words", "n_features", "features"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.groupBy("text").agg(F.count("*").alias("copies")).mapInArrow(run, "digest binary, copies long, n_words long, n_features long, features binary")


def _counts(distinct: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, each text counted as often as it has copies: `buckets` numbers, added up in the tasks first."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for copies, raw in zip(b.column(0).to_pylist(), b.column(1)):
                total += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=buckets) * copies
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in distinct.select("copies", "features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket tells for the target: floor(1000 * log of the ratio of smoothed shares)."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weights(distinct: DataFrame, gain: np.ndarray) -> DataFrame:
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(gain[np.frombuffer(raw.as_buffer(), kind)].sum()) for raw in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weight, pa.int64())], names=["digest", "copies", "n_words", "n_features", "weight"])

    return distinct.mapInArrow(run, "digest binary, copies long, n_words long, n_features long, weight long")


def _noise(own, seed: str):
    """Gumbel noise of a document, times 1000, from its id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Importance of every row: doc_id, n_words, n_features, weight. With them, the number of rows.

    Identical texts are one row of their group from the first shuffle on: their features are taken once, count as often as there are copies,
    and the weight goes back to the copies by the text's SHA-256. The few texts that a thousandth of all rows or more share go back by a broadcast of fewer
    than HOT_SHARE rows, whose copies are then dealt out by their ids. The gains, one for each bucket, are the only model.
    """
    aim = _distinct(target, target_col, longest, buckets)
    distinct = cut(_distinct(docs, text_col, longest, buckets), "importance-texts")
    gain = gains(_counts(distinct, buckets), _counts(aim, buckets))
    weights = cut(_weights(distinct, gain), "importance-weights", "none")
    discard(distinct)
    total = weights.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    hot = weights.where(F.col("copies") * HOT_SHARE > total).select(F.col("digest").alias("_hot"), F.struct("n_words", "n_features", "weight").alias("_a"))
    cold = weights.where(F.col("copies") * HOT_SHARE <= total).select(F.col("digest").alias("_cold"), F.struct("n_words", "n_features", "weight").alias("_b"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("_d")).join(F.broadcast(hot), F.col("_d") == F.col("_hot"), "left")
    rows = rows.withColumn("_key", F.when(F.col("_a").isNull(), F.col("_d")).otherwise(F.unhex(F.hex(F.xxhash64("doc_id")))))  # 8 bytes meet no digest
    met = rows.join(cold, F.col("_key") == F.col("_cold"), "left").select("doc_id", F.coalesce("_a", "_b").alias("_w"))
    out = cut(met.select("doc_id", "_w.n_words", "_w.n_features", "_w.weight"), "importance-rows", "none")
    discard(weights)
    return out, total


def resample(
    docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text",
    longest: int = 1, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Draw percent of the documents of min_words words or more, without replacement, with chances by likeness to the target's texts.

    One row for each row of docs: doc_id, n_features, weight, score (weight and Gumbel noise of the id) and rank, 1 for the
    highest score, ties to the smaller doc_id, null for a row that isn't drawn. A null or blank text has no features and weight 0. A
    null id has the noise of an empty one and comes last of a tie; rows of one id and text score alike, and each is ranked by
    itself. An empty target or table is smoothed like any other; of no rows none are drawn. Very long texts are taken whole. Other
    columns are not read, so their names can't clash.

    Ranks come from ranges of the order that are written once: a row's rank is its place in the range, plus the rows of the ranges before.
    """
    rows, _ = weigh(docs, target, text_col, id_col, target_col, longest, buckets)
    scored = rows.select("doc_id", "n_features", "weight", (F.col("weight") + _noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("_fit"), F.monotonically_increasing_id().alias("_row"))
    scored = cut(scored, "importance-scored", "none")
    discard(rows)
    wanted = scored.where("_fit").count() * percent // 100
    order = [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    placed = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "importance-placed", "none")
    discard(scored)
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = F.broadcast(ranges.select("_range", "_first", before.alias("_before")))  # one row for each partition of the exchange
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    met = placed.join(ranges, F.shiftright("_at", 33) == F.col("_range"), "left")
    return met.select("doc_id", "n_features", "weight", "score", F.when(place <= wanted, place).cast("long").alias("rank"))


def expected_noise(doc_id: int | None, seed: str = SEED) -> int:
    """The noise of one id, in plain Python."""
    from hashlib import sha256

    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
