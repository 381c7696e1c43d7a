"""Nearest neighbours by inner product with a hash-prefix forest (LSH forest) that is dealt out by prefix."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, partitions_of

TREES = 12
BITS = 32
#: Rows that share a prefix in the first round, at the mean; rows that one worker holds; bits that each round gives up.
BUCKET_ROWS = 4096
CHUNK_ROWS = 16_384
STEP = 3
#: Ascent ends when a neighbour as near as the k-th found is missed by all trees with at most this probability.
MISS = 0.04
SEED = 7


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, trees]).standard_normal((dim, trees * BITS)).astype(np.float32)


def labels(x: np.ndarray, lift: np.ndarray, trees: int = TREES) -> np.ndarray:
    """Hash strings, rows x trees: BITS signs of random projections of (x, lift), the first in the highest bit."""
    planes = _planes(x.shape[1] + 1, trees)
    signs = (x.astype(np.float32) @ planes[:-1] + lift.astype(np.float32)[:, None] * planes[-1] > 0).reshape(len(x), trees, BITS)
    return np.ascontiguousarray(np.packbits(signs, axis=2).reshape(len(x), trees, 4).view(">u4")[:, :, 0].astype(np.uint32))


def _missed(cos: float, length: int, trees: int) -> float:
    """Chance that a row at this angle shares no prefix of this length with the query in any tree."""
    return (1 - (1 - math.acos(min(max(cos, -1), 1)) / math.pi) ** length) ** trees


class Tree:
    """The rows of one prefix of one tree, in the order of their hash strings."""

    def __init__(self, ids: np.ndarray, strings: np.ndarray, x: np.ndarray, trees: int, shortest: int):
        order = np.argsort(strings, kind="stable")
        self.ids, self.strings, self.x = ids[order], strings[order].astype(np.uint64), x[order]
        self.near = self.x.astype(np.float32)  # for the first look at candidates
        self.trees, self.shortest = trees, shortest

    def search(self, ids: np.ndarray, strings: np.ndarray, x: np.ndarray, scale: np.ndarray, k: int, miss: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the length at which its ascent ended, and places and exact scores of the k best rows found.

        A query descends to the longest prefix that it shares with k rows, and ascends bit by bit, to `shortest` at most, until a row as
        near as its k-th best would hardly be missed by all trees, if they ascended as far.
        """
        lengths = np.arange(self.shortest, BITS + 1, dtype=np.uint64)
        shift = (BITS - lengths)[:, None]
        head = strings.astype(np.uint64)[None, :] >> shift << shift
        low = np.searchsorted(self.strings, head)
        high = np.searchsorted(self.strings, head + (np.uint64(1) << shift))
        for i in range(len(ids)):
            q, q32 = x[i].astype(np.float64), x[i].astype(np.float32)
            size = high[:, i] - low[:, i]
            at = int(np.flatnonzero(size > k)[-1]) if size[0] > k else 0
            a, b = int(low[at, i]), int(high[at, i])
            rough = self.near[a:b] @ q32
            while at:
                # one row more than k, as the query's own is among them
                if _missed(float(np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]) / scale[i], self.shortest + at, self.trees) <= miss:
                    break
                at -= 1
                c, d = int(low[at, i]), int(high[at, i])
                rough = np.concatenate([self.near[c:a] @ q32, rough, self.near[b:d] @ q32])
                a, b = c, d
            found = np.arange(a, b)
            if len(found) > k + 1:  # the first look rounds; what comes near the k-th score is scored again in double precision
                edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - 1e-4 * scale[i]
                found = found[rough >= edge]
            own = found[self.ids[found] == ids[i]]
            found = np.setdiff1d(found, own[(self.x[own] == x[i]).all(axis=1)], assume_unique=True)
            score = (self.x[found].astype(np.float64) * q).sum(axis=1)
            yield self.shortest + at, found, score


def _checked(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """id and the vector's bytes of rows that take part: no null, zero, empty or non-finite vectors, and no null ids."""
    kind = "<f8" if dict(vectors.dtypes)[vector_col] == "array<double>" else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, blobs, norms = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    blobs.append(x.tobytes())
                    norms.append(float(np.sqrt((x.astype(np.float64) ** 2).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(norms, pa.float64()), pa.array([len(x) for x in blobs], pa.int32())], names=["id", "v", "norm", "size"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, v binary, norm double, size int"), kind


def _labelled(rows: DataFrame, kind: str, trees: int, lifted: bool) -> DataFrame:
    """Rows (id, v, norm, size, top) with their hash strings: id, v, size, top, strings. Rows, not queries, are lifted to the norm top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(3).to_numpy()
            norm, top = b.column(2).to_numpy(), b.column(4).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = b.take(pa.array(at))
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(len(at), -1)
                lift = np.sqrt(np.maximum(top[at] ** 2 - norm[at] ** 2, 0)) if lifted else np.zeros(len(at))
                strings = labels(x, lift, trees).view(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), part.column(4), pa.array(list(strings), pa.list_(pa.int32()))], names=["id", "v", "size", "top", "strings"])

    return rows.select("id", "v", "norm", "size", "top").mapInArrow(run, "id long, v binary, size int, top double, strings array<int>")


HITS = "query_id long, query_key binary, scale double, tree int, length int, vec_id long, vec_key binary, score double"


def _round(rows: DataFrame, asks: DataFrame, kind: str, trees: int, shortest: int, k: int, miss: float, chunk_rows: int, first: bool) -> DataFrame:
    """HITS' columns: what each query finds in each tree among the rows that share its first `shortest` bits.

    Rows and queries go to (tree, prefix), once a tree; with no bit to share, to one tree. A prefix of over chunk_rows rows is split
    by a hash of the ids into chunks, each of which all its queries visit. A worker holds one chunk, and queries pass by it.
    """

    def planted(df: DataFrame) -> DataFrame:
        some = F.slice("strings", 1, 1) if not shortest else F.col("strings")
        each = df.select(*[c for c in df.columns if c != "strings"], F.posexplode(some).alias("tree", "string"))
        prefix = F.call_function("shiftrightunsigned", F.col("string"), F.lit(BITS - shortest)) if shortest else F.lit(0)
        return each.withColumn("prefix", prefix)

    where = ["size", "tree", "prefix"]
    rows, asks = planted(rows), planted(asks)
    if not first and shortest:  # later rounds ask for few prefixes
        rows = rows.join(asks.select(*where).distinct(), where, "left_semi")
    hot = rows.groupBy(*where).agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows).select(*where, F.expr(f"cast(ceil(n / {chunk_rows}) as int)").alias("chunks"))
    chunks = F.coalesce("chunks", F.lit(1))
    data = rows.join(hot, where, "left").withColumns({"chunk": F.pmod(F.xxhash64("id"), chunks).cast("int"), "q": F.lit(False), "query_key": F.lit(None).cast("binary")})
    meet = asks.join(hot, where, "left").withColumns({"chunk": F.explode(F.sequence(F.lit(0), chunks - 1)), "q": F.lit(True), "query_key": F.unhex(F.md5("v"))})
    cols = ["size", "tree", "prefix", "chunk", "q", "id", "string", "v", "top", "query_key"]
    both = data.select(*cols).unionByName(meet.select(*cols)).repartition(partitions_of(rows), "size", "tree", "prefix", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *edge], [*edge, len(keys)]):
                if i == j:
                    continue
                if now != tuple(keys[i, :4]):
                    now, held, tree = tuple(keys[i, :4]), [], None
                part = b.slice(i, j - i)
                ids = part.column(5).to_numpy()
                strings = part.column(6).to_numpy().view(np.uint32)
                x = np.frombuffer(b"".join(part.column(7).to_pylist()), kind).reshape(len(ids), -1)
                if not keys[i, 4]:
                    held.append((ids, strings, x))
                    continue
                if tree is None:  # a query may come to a prefix that no row has
                    held = held or [(ids[:0], strings[:0], x[:0])]
                    tree = Tree(*(np.concatenate(c) for c in zip(*held)), trees if shortest else 1, shortest)
                scale = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * part.column(8).to_numpy()
                query_keys = part.column(9).to_pylist()
                out: list[list] = [[] for _ in range(8)]
                for q, (length, found, score) in enumerate(tree.search(ids, strings, x, scale, k, miss)):
                    best = np.lexsort((tree.ids[found], -score))[:k] if len(found) else None
                    vec_ids = tree.ids[found[best]].tolist() if best is not None else [None]
                    vec_keys = [hashlib.md5(tree.x[p].tobytes()).digest() for p in found[best]] if best is not None else [None]
                    scores = score[best].tolist() if best is not None else [None]
                    n = len(vec_ids)
                    for c, v in zip(out, ([ids[q]] * n, [query_keys[q]] * n, [scale[q]] * n, [now[1]] * n, [length] * n, vec_ids, vec_keys, scores)):
                        c.extend(v)
                kinds = [pa.int64(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["query_id", "query_key", "scale", "tree", "length", "vec_id", "vec_key", "score"])

    return both.sortWithinPartitions("size", "tree", "prefix", "chunk", "q").mapInArrow(run, HITS)


QUERY = ["query_id", "query_key"]


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query among all hits, each row once."""
    each = hits.where("vec_id IS NOT NULL").groupBy(*QUERY, "vec_id", "vec_key").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.col("score").desc(), "vec_id", "vec_key"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def _settled(hits: DataFrame, best: DataFrame, k: int, miss: float) -> DataFrame:
    """Queries of which a row as near as the k-th best would be missed by all trees, each at its own length, with a chance of `miss` or less."""
    kth = best.where(F.col("rank") == k).select(*QUERY, F.col("score").alias("kth"))
    ended = hits.groupBy(*QUERY, "tree").agg(F.max("length").alias("length"), F.max("scale").alias("scale"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("kth") / F.col("scale")))
    shares = F.pow(1 - F.acos(cos) / math.pi, F.col("length"))
    odds = F.log(F.greatest(1 - shares, F.lit(1e-300)))
    return ended.join(kth, QUERY).groupBy(*QUERY).agg(F.sum(odds).alias("odds")).where(F.col("odds") <= math.log(miss)).select(*QUERY)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, miss: float = MISS, bucket_rows: int = BUCKET_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The k nearest rows by inner product of each row for which the condition is_query (on column id) holds.

    Columns: query_id, rank (from 1), vec_id, score (inner product in double precision). Candidates are all rows but the
    query's own; ties go to the smaller vec_id. Rows of one id and one vector are one row; those of one id and several vectors are rows of their own,
    as candidates and as queries (each then has ranks from 1). In rounds, rows and the queries that aren't settled meet by tree and prefix: first
    at prefixes that bucket_rows rows share at the mean, then at ones of STEP bits less, and if need be at none, where all rows are seen.
    Each round sends a row once a tree, however many queries there are. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows with a null id; vectors of different lengths don't meet. With fewer than k candidates all are returned. An empty table gives
    no rows. Other columns are not read.
    """
    rows, kind = _checked(vectors, id_col, vector_col)
    stats = cut(rows.groupBy("size").agg(F.count("*").alias("n"), F.max("norm").alias("top")), "ann-stats")
    total = stats.agg(F.max("n")).first()[0] or 1
    rows = rows.join(stats.select("size", "top"), "size")  # a row for each length of vectors
    data, asks = _labelled(rows, kind, trees, True), _labelled(rows.where(is_query), kind, trees, False)
    shortest = min(BITS, max(0, int(math.log2(total / bucket_rows)))) if total > bucket_rows else 0
    hits, first = None, True
    while True:
        found = cut(_round(data, asks, kind, trees, shortest, k, miss, chunk_rows, first), "ann-hits")
        hits = found if hits is None else hits.unionByName(found)
        best = _best(hits, k)
        if not shortest:
            break
        open_ = asks.withColumns({"query_id": F.col("id"), "query_key": F.unhex(F.md5("v"))}).join(_settled(found, best, k, miss), QUERY, "left_anti")
        asks = cut(open_.select("id", "v", "size", "top", "strings"), "ann-open")
        if asks.isEmpty():
            discard(asks)
            break
        shortest, first = max(0, shortest - STEP), False
    return best.select("query_id", "rank", "vec_id", "score")
