"""Exact dedup by a cuckoo-filter index over live text digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import count as numbers

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_of, cut, partitions_of, row_ident

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over a store of live keys.

    The filter is two arrays: a fingerprint and the number of a stored key for each slot, four slots a bucket. A lookup reads two
    buckets; a fingerprint hit is verified against the stored digest and content, so the index has no false positives.
    insert() moves entries out of a full pair of buckets; after MAX_KICKS moves the filter doubles and is filled again from
    the stored keys. delete() empties the slot and frees the key. No two live keys may share a digest.
    """

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        if buckets & self.mask:
            raise ValueError("buckets must be a power of two")
        self.n = self.resizes = 0
        self.keys: list = []  # (digest, content, payload), or None where a key was deleted
        self.free: list[int] = []
        self._clear()

    def _clear(self) -> None:
        self.prints = array("H", bytes(2 * SLOTS * (self.mask + 1)))  # 0: empty
        self.refs = array("I", bytes(4 * SLOTS * (self.mask + 1)))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[8:10], "little") or 1
        i = int.from_bytes(digest[:8], "little") & self.mask
        return fp, i, i ^ (fp * 0x5BD1E995 & self.mask)

    def _find(self, digest: bytes, content) -> int:
        fp, i, j = self._places(digest)
        for b in (i, j) if i != j else (i,):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == fp and (k := self.keys[self.refs[s]])[0] == digest and k[1] == content:
                    return s
        return -1

    def get(self, digest: bytes, content):
        """The payload of a live key, or None."""
        s = self._find(digest, content)
        return None if s < 0 else self.keys[self.refs[s]][2]

    def insert(self, digest: bytes, content, payload) -> None:
        """Add a key that isn't in the index."""
        ref = self.free.pop() if self.free else len(self.keys)
        self.keys[ref : ref + 1] = [(digest, content, payload)]
        self.n += 1
        if not self._place(ref):
            self._grow()

    def _put(self, bucket: int, fp: int, ref: int) -> bool:
        for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.prints[s]:
                self.prints[s], self.refs[s] = fp, ref
                return True
        return False

    def _place(self, ref: int) -> bool:
        digest = self.keys[ref][0]
        fp, i, j = self._places(digest)
        if self._put(i, fp, ref) or self._put(j, fp, ref):
            return True
        b, turn = j, digest[10]
        for _ in range(MAX_KICKS):
            turn = (turn * 5 + 1) & 0xFF
            s = b * SLOTS + (turn >> 3) % SLOTS
            fp, self.prints[s] = self.prints[s], fp
            ref, self.refs[s] = self.refs[s], ref
            b ^= fp * 0x5BD1E995 & self.mask
            if self._put(b, fp, ref):
                return True
        return False

    def _grow(self) -> None:
        live = [r for r, k in enumerate(self.keys) if k is not None]
        while True:
            self.mask = self.mask * 2 + 1
            self.resizes += 1
            self._clear()
            if all(map(self._place, live)):
                return

    def delete(self, digest: bytes, content) -> bool:
        """Take a live key out; False if it isn't there."""
        s = self._find(digest, content)
        if s < 0:
            return False
        self.free.append(self.refs[s])
        self.keys[self.refs[s]] = None
        self.prints[s] = 0
        self.n -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object, object]]:
        return (k for k in self.keys if k is not None)


#: Before the shuffle, map tasks collapse copies among so many digests or bytes of content at a time.
FLUSH, FLUSH_BYTES = 100_000, 16 << 20
GROUPS = "digest binary, keep_id long, n long, n_keep long, clash boolean"
SIGNED = "digest binary, n_bytes long, doc_id long, n long"


def _digest(text: Column, salt: int = 0) -> Column:
    """SHA-256 of a text; another hash for each other salt."""
    return F.unhex(F.sha2(F.concat(F.lit(f"{salt}:"), text) if salt else text, 256))


def _text(text_col: str, normalise=None) -> Column:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return normalise(text) if normalise else text


# --- groups of equal texts -----------------------------------------------------------------------------------------------


def _merge(index: CuckooIndex, digest: bytes, content: bytes, keep, n: int, n_keep: int, clash: bool) -> None:
    """Count rows of a content. If a digest comes with two contents, the first stays and the payload says so."""
    s = index._find(digest, content)
    if s >= 0:
        held = index.keys[index.refs[s]][2]
    else:
        held = index.get(digest, _ANY)
        if held is None:
            index.insert(digest, content, [keep, n, n_keep, clash])
            return
        clash = True
    held[1] += n
    held[3] |= clash
    if keep == held[0]:
        held[2] += n_keep
    elif keep is not None and (held[0] is None or keep > held[0]):
        held[0], held[2] = keep, n_keep


class _Any:
    def __eq__(self, other) -> bool:
        return True


_ANY = _Any()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


def _text_groups(docs: DataFrame, text_col: str, id_col: str, normalise, salt: int) -> DataFrame:
    """GROUPS' columns of the digests that more than one row has, each row's content held against the first of its digest."""
    text = _text(text_col, normalise)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text, salt).alias("digest"), text.alias("text"))
    buckets, partitions = buckets_of(docs), partitions_of(docs)
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = CuckooIndex(), 0

        def done() -> pa.RecordBatch:
            each = [(int.from_bytes(d[16:24], "little") % buckets, d, c, *p) for d, c, p in index.items()]
            return _batch(each, ["bucket", "digest", "content", "keep_id", "n", "n_keep", "clash"], kinds)

        for b in batches:
            for i, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                before = index.n
                _merge(index, d, t, i, 1, 1, False)
                held += len(t) if index.n > before else 0
                if index.n >= FLUSH or held >= FLUSH_BYTES:
                    yield done()
                    index, held = CuckooIndex(), 0
        if index.n:
            yield done()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the index of one bucket lives at a time."""
        index, at = CuckooIndex(), None

        def done() -> pa.RecordBatch:
            return _batch([(d, *p) for d, _, p in index.items() if p[1] > 1], ["digest", "keep_id", "n", "n_keep", "clash"], [kinds[2], *kinds[3:]])

        for b in batches:
            for bucket, *row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if bucket != at:
                    if index.n:
                        yield done()
                    index, at = CuckooIndex(), bucket
                _merge(index, *row)
        if index.n:
            yield done()

    one = rows.mapInArrow(collapse, "bucket long, digest binary, content binary, keep_id long, n long, n_keep long, clash boolean")
    return one.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(shards, GROUPS)


def _groups(docs: DataFrame, text_col: str, id_col: str, normalise) -> tuple[DataFrame, int]:
    """The groups of equal texts of two rows or more, and the salt of their digests, by which no two texts share one."""
    for salt in numbers():
        groups = cut(_text_groups(docs, text_col, id_col, normalise, salt), "exact-groups")
        if groups.where("clash").isEmpty():
            return groups.drop("clash"), salt


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise=None) -> DataFrame:
    """Groups of equal texts, one row for each row of docs.

    Columns: doc_id, keep_id (largest id of the group), group_size, kept (doc_id is keep_id), text_sha256,
    n_keep (rows that carry keep_id: over 1 where rows are repeated whole). A null text counts as empty. A null id is
    below every other; a group of null ids only has a null keep_id and kept is true. Repeated rows all count and all are
    returned. An empty table gives no rows. Other columns of docs are not read, so their names can't clash. Very long texts are
    taken whole. Texts are equal if their contents are: digests only bring them together.
    """
    groups, salt = _groups(docs, text_col, id_col, normalise)
    text = _text(text_col, normalise)
    sha = F.lower(F.hex(_digest(text)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text, salt).alias("digest"), *[sha.alias("text_sha256")] * bool(salt))
    out = rows.join(groups.withColumnRenamed("digest", "_d"), F.col("digest") == F.col("_d"), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    sha = F.col("text_sha256") if salt else F.lower(F.hex("digest"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), sha.alias("text_sha256"), F.coalesce("n_keep", F.lit(1)).cast("long").alias("n_keep"))


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their own columns: one for each text, that with the largest id.

    Which rows go is worked out on digests and ids; the texts then meet these once, by digest and id, so that a hot
    text's copies are spread. Of rows with one text and one id, one stays.
    """
    own = docs.columns
    groups, salt = _groups(docs, text_col, id_col, None)
    digest, i = _digest(_text(text_col), salt), F.col(id_col).cast("long")
    pairs = docs.select(digest.alias("digest"), i.alias("doc_id")).join(groups, "digest").where("NOT (doc_id <=> keep_id)")
    gone = pairs.select(row_ident(F.col("digest"), F.col("doc_id")).alias("_sm_gone")).distinct()
    rows = docs.withColumn("_sm_row", row_ident(digest, i))
    kept = rows.join(gone, F.col("_sm_row") == F.col("_sm_gone"), "left_anti")
    nth = F.row_number().over(Window.partitionBy("_sm_row").orderBy(F.lit(1)))
    return kept.withColumn("_sm_nth", nth).where("_sm_nth = 1").select(*own)


# --- an index that is kept -----------------------------------------------------------------------------------------------


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", normalise=None) -> DataFrame:
    """doc_id, digest (SHA-256 of the text, null as empty) and n_bytes of every row."""
    text = _text(text_col, normalise)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def _signed(rows: DataFrame, sign: int = 1) -> DataFrame:
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    return rows.select("digest", "n_bytes", "doc_id", (n * sign).cast("long").alias("n"))


def _net(rows: DataFrame) -> DataFrame:
    """Live rows by digest, length and id, through one cuckoo index a bucket: counts are added up, and what comes to nothing goes."""
    from hashlib import blake2b

    names, kinds = ["digest", "n_bytes", "doc_id", "n"], [pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = CuckooIndex(), None
        for b in batches:
            for bucket, d, size, i, n in zip(*(b.column(k).to_pylist() for k in range(5))):
                if bucket != at:
                    if index.n:
                        yield _batch([(*c, *p) for _, c, p in index.items()], names, kinds)
                    index, at = CuckooIndex(), bucket
                name = blake2b(b"%b %d %a" % (d, size, i), digest_size=16).digest()
                held = index.get(name, (d, size, i))
                if held is None:
                    index.insert(name, (d, size, i), [n])
                else:
                    held[0] += n
                    if not held[0]:
                        index.delete(name, (d, size, i))
        if index.n:
            yield _batch([(*c, *p) for _, c, p in index.items()], names, kinds)

    summed = rows.groupBy("digest", "n_bytes", "doc_id").agg(F.sum("n").alias("n"))  # combines before the shuffle
    buckets = buckets_of(rows)
    keyed = summed.select(F.pmod(F.xxhash64("digest", "n_bytes", "doc_id"), F.lit(buckets)).alias("bucket"), *names)
    return keyed.repartition(partitions_of(rows), "bucket").sortWithinPartitions("bucket").mapInArrow(run, SIGNED)


def build_index(rows: DataFrame) -> DataFrame:
    """The index as a table, one row for each digest and id: SIGNED's columns.

    rows: digests(), or these with a column n of 1 (added) or -1 (deleted), in any order: counts add up. A row that was deleted more
    often than added stays with a negative count, until it is added again. groups_of() reads the live digests from it.
    """
    return _net(_signed(rows))


def update_index(index: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The index after rows of digests() were added and others deleted, whatever came first."""
    rows = _signed(index)
    for change, sign in ((added, 1), (deleted, -1)):
        if change is not None:
            rows = rows.unionByName(_signed(change, sign))
    return _net(rows)


def groups_of(index: DataFrame) -> DataFrame:
    """The live digests: digest, n_bytes, keep_id (largest live id), n (rows) and n_keep (rows with keep_id)."""
    live = index.where("n > 0").groupBy("digest", "n_bytes").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("n"))
    return live.select("digest", "n_bytes", F.col("top.doc_id").alias("keep_id"), "n", F.col("top.n").alias("n_keep"))
