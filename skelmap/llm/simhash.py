"""SimHash near-dedup by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, discard, row_ident

SEED = 42
MAX_BITS = 3
#: Runs of one anchor up to this long are compared by shifts, longer ones in blocks.
SHORT = 48
BLOCK = 1024


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles: a bit is set if it is in over half of the shingles' XXH64."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest, join = xxhash.xxh64_digest, b" ".join
    counts = np.zeros(64, np.int64)
    for at in range(0, len(w) - words + 1, 1 << 18):
        part = w[at : at + (1 << 18) + words - 1]
        h = b"".join([digest(join(t), SEED) for t in zip(*(part[i:] for i in range(words)))])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(w) - words + 1
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """doc_id and fp, the SimHash as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, "doc_id long, fp long")


# --- anchors -------------------------------------------------------------------------------------------------------------
#
# Two fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their 32-bit halves. Each half is
# covered by the code (Hamming code of length 31) x (1 free bit): covering radius 1, 2^27 anchors. x's home anchor is within 1
# of x; if y's half differs in at most 1 bit, that anchor is within 2 of y. So fingerprints that are replicated to every
# anchor within radius + threshold = 2 meet at one at least. A half has 17 such anchors, or 2 if it is a code word.


def _syndrome(v: Column) -> Column:
    """XOR of the numbers (1 to 31) of the set bits 0 to 30."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        out = out.bitwiseOR(F.shiftleft(F.bit_count(v.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), j))
    return out


def _bit(number: Column) -> Column:
    """1 << (number - 1); nothing for number 0."""
    return F.when(number == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (number - 1).cast("int")))


def _anchors(half: Column) -> Column:
    """The anchors within 2 of a 32-bit half, as an array of longs."""
    v, free = half.bitwiseAND(F.lit(0x7FFFFFFF)), half.bitwiseAND(F.lit(0x80000000))
    s = _syndrome(v).cast("int")
    home = v.bitwiseXOR(_bit(s))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (i.bitwiseXOR(s) > i))
    twos = F.transform(pairs, lambda i: v.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(s))).bitwiseXOR(free))
    near = F.array(home.bitwiseXOR(free), home.bitwiseXOR(free).bitwiseXOR(F.lit(0x80000000)))
    # pairs holds i < i^s, of which {s, 0} isn't a pair: i = s gives i^s = 0, which is below i and so filtered out
    return F.when(s == 0, near).otherwise(F.concat(near, twos))


def _replicas(distinct: DataFrame) -> DataFrame:
    """fp at each of its anchors: anchor (half in bit 32) and fp."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))
    keys = F.concat(_anchors(low), F.transform(_anchors(high), lambda a: a.bitwiseOR(F.lit(1 << 32))))
    return distinct.select("fp", F.explode(keys).alias("anchor"))


class Forest:
    """Union-find over positions 0..n-1 that remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def roots(self) -> np.ndarray:
        up = self.up
        while (nxt := up[up] != up).any():
            up[nxt] = up[up[nxt]]
        return up


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Are fingerprints within MAX_BITS of one another? Shapes as numpy broadcasts them."""
    return np.bitwise_count(x ^ y) <= MAX_BITS


def _flips(v: np.ndarray, f: Forest) -> None:
    """Join fingerprints that differ in one or two bits, without comparing all with all: most of a dense group."""
    order = np.argsort(v)
    s = v[order]
    one = [np.uint64(1 << i) for i in range(64)]
    for flip in one + [a ^ b for k, a in enumerate(one) for b in one[:k]]:
        x = s ^ flip
        at = np.minimum(np.searchsorted(s, x), len(s) - 1)
        for i in np.flatnonzero((s[at] == x) & (f.roots()[order] != f.roots()[order[at]])):
            f.join(order[i], order[at[i]])


def _link_run(v: np.ndarray, close=_close, ahead=_flips, dense: int = 4 * BLOCK, block: int = BLOCK) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of one group.

    All are compared with all, block by block. A group of over `dense` is joined ahead as far as that goes cheaply; then only what
    is outside its largest part is compared with all.
    """
    n = len(v)
    f = Forest(n)
    rest = np.arange(n)
    if n > dense:
        ahead(v, f)
        roots = f.roots()
        rest = np.flatnonzero(roots != np.bincount(roots, minlength=n).argmax())
    for p in range(0, len(rest), block):
        rows = rest[p : p + block]
        for q in range(0, n, block):
            i, j = np.nonzero(close(v[rows][:, None], v[None, q : q + block]))
            i, j = rows[i], j + q
            new = f.roots()[i] != f.roots()[j]
            for a, b in zip(i[new], j[new]):
                f.join(a, b)
    return f.links


def _link_groups(batches: Iterator[pa.RecordBatch], load, close, link_run) -> Iterator[pa.RecordBatch]:
    """Links that together join all rows of one group that are close. Rows come sorted by group, in column 0.

    load: batch to ids and what is compared. Short groups are compared by shifts, many at once, long ones by link_run.
    """
    held: list[np.ndarray] = []

    def done(a: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        size = np.diff(np.concatenate([start, [len(a)]]))
        small = np.repeat(size <= SHORT, size)
        for shift in range(1, int(size[size <= SHORT].max(initial=0))):
            at = np.flatnonzero((a[shift:] == a[:-shift]) & small[shift:])
            at = at[close(v[at], v[at + shift])]
            xs.append(ids[at])
            ys.append(ids[at + shift])
        for k in np.flatnonzero(size > SHORT):
            here = slice(start[k], start[k] + size[k])
            links = np.array(link_run(v[here]), np.int64).reshape(-1, 2)
            xs.append(ids[here][links[:, 0]])
            ys.append(ids[here][links[:, 1]])
        x, y = np.concatenate(xs), np.concatenate(ys)
        both = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(0).to_numpy(zero_copy_only=False), *load(b)]
        held = [np.concatenate(c) for c in zip(held, new)] if held else new
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield done(*(c[:last] for c in held))
            held = [c[last:].copy() for c in held]
    if held:
        yield done(*held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the fingerprints of each anchor."""

    def load(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = b.column(1).to_numpy(zero_copy_only=False)
        return ids, ids.view(np.uint64)

    return _link_groups(batches, load, _close, _link_run)


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """Near-duplicate classes, one row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most 3 bits are linked; component_id is the smallest doc_id that links lead to.
    A null, empty or blank text has fingerprint zero, which links like any other. Rows with one fingerprint count as
    one point, so copies cost a count; repeated rows are all returned. A null id is returned with its class but names none,
    unless a class has null ids only: then component_id is null. Very long texts are taken whole, piece by piece. An empty table gives no
    rows. Other columns are not read.
    """
    fps = cut(fingerprints(docs, text_col, id_col, words), "simhash", "none")
    points = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    return _classes(fps, points, _anchor_links(points))


def _anchor_links(points: DataFrame) -> DataFrame:
    """Links of fingerprints within MAX_BITS, enough to join all that are linked."""
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the anchors are many times the points
    spaced = points.select("fp").repartition(spread, F.xxhash64("fp"))
    return _replicas(spaced).select("anchor", "fp").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long")


def _classes(fps: DataFrame, points: DataFrame, links: DataFrame, node: str = "fp", n_points: int | None = None, n_links: int | None = None) -> DataFrame:
    """doc_id, fingerprint and component_id of rows (doc_id, fp and node), by the links of their nodes. n_points, n_links: their numbers at most, where known."""
    linked = cut(components(links, n_links), "simhash-cc", "none", n_links)  # reads the links, and what they are read from, for the last time
    named = points.join(linked.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    named = cut(named, "simhash-named", "none", n_points)
    names = named.join(linked.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"))
    classes = named.join(names, "root", "left").select(F.col(node).alias("_node"), F.coalesce("least", "rep").alias("component_id"))
    out = fps.join(classes, F.col(node) == F.col("_node"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *[c for c in fps.columns if c == "digest"])


# --- similarity of 0.8 ----------------------------------------------------------------------------------------------------
#
# Texts with a Jaccard similarity of 0.8 differ in about 10 bits of 64, far beyond what anchors can cover, and texts within 3 bits may be less alike. So
# where a similarity is asked for, min-hashes name candidates beside those of the anchors, and the sets of shingles judge them all.

HASHES = 256
BANDS, BAND = 16, 5
#: Standard error of the similarity that HASHES min-hashes tell, near 0.8; pairs that tell up to LOOSE of it less than asked for are judged.
ERROR = 0.025
LOOSE = 5
#: Rows of a band that are compared with one another in one task; a larger band is laid out in tiles of so many by so many.
TILE = 512
#: Texts, or pairs of them, whose shingles one task takes at least, if there are so many.
FILE_TEXTS = 2000
#: Shingles that are counted at a time for the similarities of a tile.
COLUMNS = 4096


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def sketch(text: str | None, words: int, multipliers: np.ndarray) -> tuple[int, bytes, np.ndarray]:
    """SimHash, a byte of each min-hash, and the keys of the bands of min-hashes, of the word shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_digest, b" ".join
    counts, least, n = np.zeros(64, np.int64), np.full(HASHES, np.iinfo(np.uint64).max, np.uint64), 0
    last = max(len(w) - words + 1, min(len(w), 1))
    for at in range(0, last, 1 << 12):
        part = w[at : min(at + (1 << 12), last) + words - 1]
        shingles = zip(*(part[i:] for i in range(words))) if len(w) >= words else [w]
        raw = np.frombuffer(b"".join([digest(join(t), SEED) for t in shingles]), np.uint8).reshape(-1, 8)
        n += len(raw)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
        h = np.unique(raw.view(">u8")[:, 0].astype(np.uint64))
        for k in range(0, len(h), 512):
            np.minimum(least, (h[k : k + 512, None] * multipliers).min(axis=0), out=least)
    fp = int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big") if n else 0
    mixed = least ^ (least >> np.uint64(29))
    keys = [xxhash.xxh64_intdigest(bytes([b]) + least[b * BAND : (b + 1) * BAND].tobytes()) for b in range(BANDS)]
    return fp, (mixed & np.uint64(255)).astype(np.uint8).tobytes(), np.array(keys, np.uint64).view(np.int64)


def sketches(docs: DataFrame, text_col: str, id_col: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers()
        for b in batches:
            with np.errstate(over="ignore"):
                rows = [sketch(t.as_py(), words, multipliers) for t in b.column(1)]
            fp = np.array([r[0] for r in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "digest", "fp", "sig", "bands"])

    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t"), _digest(text_col).alias("digest"))
    return row.mapInArrow(run, "doc_id long, digest binary, fp long, sig binary, bands array<bigint>")


def _digest(text_col: str) -> Column:
    """What stands for a text: its SHA-256."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the distinct word shingles of sketch(), sorted."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w] if w else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(t), SEED) for t in shingles), np.uint64))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets of shingle_set(); two empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _sets(docs: DataFrame, points: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """node and its set of shingles, for the nodes of `wanted` (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_set(t.as_py(), words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    texts = docs.select(_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("_t"))
    named = texts.join(points.select("digest", "node").join(wanted, "node", "left_semi"), "digest")
    return named.groupBy("node").agg(F.first("_t").alias("_t")).mapInArrow(run, "node long, set binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key. Rows come sorted by key, in column 0."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() + [len(keys)]
        for i, j in zip(at, at[1:]):
            if held and held[0].column(0)[0].as_py() != keys[i]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _open_pairs(root: np.ndarray, sig: np.ndarray, source: np.ndarray, target: np.ndarray, close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block by block, the places of all pairs of a source and a target that are close and have different roots. Some come in both orders."""
    _, number = np.unique(root, return_inverse=True)
    sources, targets = np.flatnonzero(source), np.flatnonzero(target)
    for p in range(0, len(sources), 128):
        rows = sources[p : p + 128]
        for q in range(0, len(targets), 128):
            others = targets[q : q + 128]
            i, j = np.nonzero((number[rows][:, None] != number[None, others]) & close(sig[rows][:, None], sig[None, others]))
            yield rows[i], others[j]


def similarities(sets: list[np.ndarray], source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Jaccard similarities of the sources' sets with the targets', by matrix products over the shingles that several sets have."""
    size = np.array([len(s) for s in sets], np.int64)
    shingle, which, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    many = count[which] > 1
    row, column = row[many], shared[which[many]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(source), len(target)))
    for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
        here = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        present = np.zeros((len(sets), COLUMNS), np.float32)
        present[row[here], column[here] - at] = 1
        both += present[source] @ present[target].T
    every = size[source][:, None] + size[target][None, :] - both
    return np.where(every > 0, both / np.maximum(every, 1), 1.0)


def _tiles(classes: DataFrame) -> DataFrame:
    """The rows of bands whose points are of several classes, laid out in tiles: key, tile, node, root, sig, source, target.

    The points of a band's largest class are met by the others, which are the sources; all its points are targets. Sources and targets
    are dealt to blocks of about TILE, and each block of the ones meets each of the others in a tile of its own. So a band whose points are nearly
    all of one class stays linear, and one of many classes is spread over tasks that each hold two blocks.
    """
    sizes = classes.groupBy("key", "root").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).where("n > top.n")
    blocks = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    bands = bands.select(F.col("key").alias("_key"), F.col("top.root").alias("_top"), blocks(F.col("n")).alias("_across"), blocks(F.col("n") - F.col("top.n")).alias("_down"))
    rows = classes.join(bands, F.col("key") == F.col("_key")).withColumn("_is", F.col("root") != F.col("_top"))
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda down, across: F.struct(down.alias("down"), across.alias("across"))
    as_target = F.transform(span(F.col("_down")), lambda d: tile(d, block(F.col("_across"))))
    as_source = F.transform(span(F.col("_across")), lambda a: tile(block(F.col("_down")), a))
    tiles = F.when(F.col("_is"), F.array_union(as_target, as_source)).otherwise(as_target)
    source = F.col("_is") & (F.col("tile.down") == block(F.col("_down")))
    target = F.col("tile.across") == block(F.col("_across"))
    return rows.withColumn("tile", F.explode(tiles)).select(F.xxhash64("key", "tile").alias("tile"), "key", "node", "root", "sig", source.alias("source"), target.alias("target"))


def _similar(points: DataFrame, docs: DataFrame, more: DataFrame, text_col: str, words: int, similarity: float, n_points: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) of the n_points points (node, sig, bands) whose sets of shingles have a similarity of `similarity` or more.

    Candidates share a band, or are pairs of `more`. Points of a band that no other has drop out before their min-hashes are sent. Min-hashes only choose
    what is judged. First each group of a band sends links, linear in its size, of pairs whose min-hashes tell `similarity`; those that the sets confirm
    make classes. Then the pairs of a group that lie in different classes and tell LOOSE standard errors less, or more, are all
    compared by their sets, tile by tile, which only the points of such pairs send. All links are links of two sets. With the links come the tables that they are read from.
    """
    # bytes agree by chance once in 256
    enough, loose = (HASHES * (s * (1 - 1 / 256) + 1 / 256) for s in (similarity, similarity - LOOSE * ERROR))

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x == y).sum(axis=-1, dtype=np.int16) >= enough

    def perhaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x == y).sum(axis=-1, dtype=np.int16) >= loose

    def ahead(v: np.ndarray, f: Forest) -> None:
        """Join each with the first, and with the one before it."""
        for i in np.flatnonzero(close(v, v[:1])):
            f.join(0, int(i))
        for i in np.flatnonzero(close(v[1:], v[:-1])):
            f.join(int(i), int(i) + 1)

    def link_run(v: np.ndarray) -> list[tuple[int, int]]:
        if len(v) <= 4 * SHORT:
            return _link_run(v, close, ahead, block=128)
        f = Forest(len(v))
        ahead(v, f)
        return f.links

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            return b.column(1).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, HASHES)

        return _link_groups(batches, load, close, link_run)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in c.to_pylist()] for c in b.columns[2:])
            yield b.select([0, 1]).filter(pa.array([jaccard(*xy) >= similarity for xy in zip(x, y)], pa.bool_()))

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches):
            root, source, target = (t.column(c).to_numpy() for c in ("root", "source", "target"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            mark = np.zeros(len(root), bool)
            for i, j in _open_pairs(root, sig, source, target, perhaps):
                mark[i] = mark[j] = True
            if mark.any():
                yield from t.filter(pa.array(mark)).select(["tile", "node", "root", "source", "target"]).to_batches(max_chunksize=4096)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches):
            node, root = (t.column(c).to_numpy() for c in ("node", "root"))
            source, target = (np.flatnonzero(t.column(c).to_numpy()) for c in ("source", "target"))
            sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
            f = Forest(len(node))
            first: dict[int, int] = {}
            for i, r in enumerate(root.tolist()):
                f.join(first.setdefault(r, i), i)
            f.links.clear()  # those of one root are joined already
            for x, y in zip(*np.nonzero(similarities(sets, source, target) >= similarity)):
                f.join(int(source[x]), int(target[y]))
            links = node[np.array(f.links, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(links.max(axis=1, initial=-(2**63))), pa.array(links.min(axis=1, initial=2**63 - 1))], names=["a", "b"])

    rows = points.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = cut(rows.join(shared, "key", "left_semi").join(points.select("node", "sig"), "node").select("key", "node", "sig"), "simhash-met", "none", n_points * BANDS)
    likely = met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(forest, "a long, b long")
    likely = cut(likely.unionByName(more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), "simhash-likely", "none", met.count() + n_points)
    n_likely = likely.count()
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = cut(_sets(docs, points, ends, text_col, words), "simhash-sets", "none", n_points, FILE_TEXTS)
    pairs = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    sure = cut(pairs.select("a", "b", "x", "y").mapInArrow(confirmed, "a long, b long"), "simhash-sure", "none", n_likely, FILE_TEXTS)

    discard(likely, sets)
    joined = cut(components(sure, n_likely), "simhash-roots", "none", n_likely)
    classes = met.join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "sig")
    open_rows = _tiles(classes).select("tile", "node", "root", "sig", "source", "target")
    left = cut(open_rows.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(still_open, "tile long, node long, root long, source boolean, target boolean"), "simhash-open", "none")
    discard(met, joined)
    rest = left.join(_sets(docs, points, left.select("node").distinct(), text_col, words), "node").select("tile", "node", "root", "source", "target", "set")
    found = rest.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(judged, "a long, b long")
    return sure.unionByName(found), [sure, left]


def similar_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Classes of texts whose shingle sets have a Jaccard similarity of `similarity` or more, as near_groups() gives its own.

    Candidates are fingerprints that meet at an anchor within MAX_BITS, texts with one fingerprint, and texts that share a band of min-hashes; every link is judged by
    the two sets. A pair of a similarity of 0.8 whose fingerprints aren't near is not found with a chance of 0.0017, as it shares no band,
    and a greater similarity with a lesser one (0.85: 0.0001); that its min-hashes tell LOOSE standard errors too little has a chance of
    0.000001. Rows with one text are one point. Cases are as in near_groups(); digest is the SHA-256 of a row's text.
    """
    rows = cut(sketches(docs, text_col, id_col, words), "simhash-sketches")
    points = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min(F.struct("sig", "bands")).alias("s"))
    points = cut(points.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "fp", "s.sig", "s.bands"), "simhash-points", rows=rows.count())  # written, so the numbers stay
    n_points = points.count()
    heads = cut(points.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "simhash-heads", "none", n_points)
    tied = points.join(heads.where("n > 1").select("fp", "head"), "fp").select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b")
    near = _anchor_links(heads).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    links, read = _similar(points, docs, tied.unionByName(near), text_col, words, similarity, n_points)
    named = cut(points.select("digest", "node", "rep"), "simhash-nodes", "none", n_points)
    n_links = sum(t.count() for t in read)  # a tile of `read` sends fewer links than it has rows
    out = _classes(rows.select("doc_id", "digest", "fp").join(named.select("digest", "node"), "digest"), named.select("node", "rep"), links, "node", n_points, n_links)
    discard(points, heads, *read)
    return out


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, one of each class of similar_groups(): that with the smallest id, with its own columns.

    Which rows stay is worked out on digests and ids, and the texts meet these once. Rows of one id and one text are one document: one
    of them stays. Rows with a null id all stay, as nothing tells them apart. An empty table gives no rows.
    """
    keep = similar_groups(docs, text_col, id_col, words, similarity).where("doc_id = component_id")
    keep = keep.select(row_ident(F.col("digest"), F.col("doc_id")).alias("_sm_keep")).distinct()
    own = F.col(id_col).cast("long")
    rows = docs.withColumn("_sm_row", row_ident(_digest(text_col), own)).join(keep, F.col("_sm_row") == F.col("_sm_keep"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_sm_row").orderBy(F.lit(1)))
    return rows.withColumn("_sm_nth", nth).where("_sm_nth = 1").select(*docs.columns).unionByName(docs.where(own.isNull()))
