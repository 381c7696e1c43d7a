"""Substring dedup by recompression.

Rounds name runs of one symbol and adjacent pairs of symbols; a name is a hash of what it stands for, so it is the same wherever
and on whichever machine it is made. A pair is named if its left symbol is on the left side of the round's
two-way division of symbols and its right one on the right side, so inside equal texts the rounds make equal symbols. With
each symbol goes its support: the words that decide that it is made. A symbol whose support lies in a window is made in
every window of the same words. Each window is known by one such symbol of the highest level that has any: that with the least
hash, the leftmost on ties. Single words are the lowest level, so each window has one. A first exchange, by symbol, finds the symbols
that occur twice: only their windows can repeat. A second one, by symbol too, brings the words of these windows together, and
there windows are compared word by word. Names only say what is compared: no word goes because two hashes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_of, cut, partitions_of

WINDOW = 35
LEVELS = 7
#: A round of runs, which widens every support, comes once in so many rounds; the others name pairs.
RUN_EVERY = 8
#: Texts are taken together up to so many bytes; a longer one is taken alone.
GROUP_BYTES = 2 << 20
PIECE = 1 << 17
WINDOWS_AT_ONCE = 400_000
MAX_CACHED = 200_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class WordHashes(dict):
    """Word to its XXH64, kept for short words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 1)
        if len(word) <= 40:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


class WordNumbers(dict):
    """Word to its number, in the order of first sight: equal numbers are equal words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in self), _U, len(self))


BASE = 0x9E3779B97F4A7C15


def _window_hashes(words: np.ndarray, names: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A polynomial of the names of each window's words, worked out for PIECE words at a time. Starts ascend."""
    out = np.empty(len(start), _U)
    with np.errstate(over="ignore"):
        n = min(PIECE, len(words)) + size
        powers = np.concatenate([[_U(1)], np.full(n, BASE, _U)]).cumprod(dtype=_U)
        inverse = np.concatenate([[_U(1)], np.full(n, pow(BASE, -1, 1 << 64), _U)]).cumprod(dtype=_U)
        for at in range(0, len(words), PIECE):
            i, j = np.searchsorted(start, (at, at + PIECE))
            part = names[words[at : at + PIECE + size]]
            c = np.concatenate([[_U(0)], np.cumsum(part * powers[: len(part)], dtype=_U)])
            own = start[i:j] - at
            out[i:j] = _mix((c[own + size] - c[own]) * inverse[own])
    return out


def _classes(words: np.ndarray, names: np.ndarray, start: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of windows, some at a time, and the class of each, numbered from 0: windows of one class, and no others, have the same words.

    words: numbers of words, names: a hash of each number, start: ascending. Hashes bring windows together; each is then compared, word by word, with the
    first of its hash, and where one differs, the windows of that hash are told apart by their words alone.
    """
    h = _window_hashes(words, names, start, size)
    parts = 1 + len(h) // WINDOWS_AT_ONCE
    for p in range(parts):
        some = np.flatnonzero(h % _U(parts) == p)
        if len(some):
            yield some, _told_apart(h[some], words, start[some], size)


def _told_apart(h: np.ndarray, words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    n = len(start)
    order = np.argsort(h, kind="stable")
    new = np.ones(n, bool)
    new[1:] = h[order][1:] != h[order][:-1]
    at = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)][at]  # the first of its hash, for each place of order
    rest = np.flatnonzero(~new)
    a, b = start[order[rest]], start[lead[rest]]
    differs = np.zeros(len(rest), bool)
    for k in range(size):
        differs |= words[a + k] != words[b + k]
    if differs.any():
        wrong = np.isin(at, at[rest[differs]])
        seen: dict[tuple[int, bytes], int] = {}
        fresh = numbers(int(at[-1]) + 1)
        for i in np.flatnonzero(wrong):
            key = (int(at[i]), words[start[order[i]] : start[order[i]] + size].tobytes())
            if key not in seen:
                seen[key] = next(fresh)
            at[i] = seen[key]
    out = np.empty(n, np.int64)
    out[order] = at
    return out


def _level_up(level: tuple, number: int, edges: tuple[np.ndarray, np.ndarray]) -> tuple:
    """The next level of (name, first word, end, support start, support end); edges: start and end of each word's document."""
    name, s, e, sl, sr = level
    lo, hi = edges
    n = len(name)
    if n < 2:
        return level
    same_doc = lo[s[1:]] == lo[s[:-1]]
    if number % RUN_EVERY == 0:  # runs: of one symbol; what is no run is known by its two neighbours
        equal = np.concatenate([[False], (name[1:] == name[:-1]) & same_doc])
        first = np.flatnonzero(~equal)
        last = np.concatenate([first[1:], [n]]) - 1
        count = (last - first + 1).astype(_U)
        left_ok = np.concatenate([[False], same_doc])[first]
        right_ok = np.concatenate([same_doc, [False]])[last]
        new_sl = np.where(left_ok, sl[np.maximum(first - 1, 0)], lo[s[first]] - 1)
        new_sr = np.where(right_ok, sr[np.minimum(last + 1, n - 1)], hi[s[first]] + 1)
        named = np.where(count > 1, _mix(name[first] * _U(0xD6E8FEB86659FD93) + count), name[first])
        return named, s[first], e[last], np.minimum(new_sl, sl[first]), np.maximum(new_sr, sr[last])
    right = (_mix(name + _U(number * 0x632BE59BD9B4E019 % (1 << 64))) & _U(1)).astype(bool)
    pair = ~right[:-1] & right[1:] & same_doc
    takes = np.concatenate([pair, [False]])
    taken = np.concatenate([[False], pair])
    after, before = np.minimum(np.arange(1, n + 1), n - 1), np.maximum(np.arange(-1, n - 1), 0)
    doc_end, doc_start = np.concatenate([~same_doc, [True]]), np.concatenate([[True], ~same_doc])
    # a left symbol is decided by the symbol after it, a right one by the symbol before it
    new_sr = np.where(right, sr, np.where(doc_end, hi[s] + 1, np.maximum(sr, sr[after])))
    new_sl = np.where(right, np.where(doc_start, lo[s] - 1, np.minimum(sl, sl[before])), sl)
    new_sl = np.where(takes, np.minimum(sl, sl[after]), new_sl)
    named = np.where(takes, _mix(name * _U(0x9E3779B97F4A7C15) + _mix(name[after] + _U(number))), name)
    keep = ~taken
    return named[keep], s[keep], np.where(takes, e[after], e)[keep], new_sl[keep], new_sr[keep]


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least value in each range [first, last], the leftmost on ties."""
    table = np.arange(len(values))
    out = first.copy()
    span, power = last - first + 1, 1
    while True:
        now = (span >= power) & (span < 2 * power)
        a, b = table[first[now]], table[last[now] - power + 1]
        out[now] = np.where(values[b] < values[a], b, a)
        if not (span >= 2 * power).any():
            return out
        after = table[np.minimum(np.arange(len(table)) + power, len(table) - 1)]
        table = np.where(values[after] < values[table], after, table)
        power *= 2


def choose(words: np.ndarray, size: np.ndarray, window: int = WINDOW, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents (word hashes one after the other, size words each): the occurrences of symbols that windows are known by.

    Returns name, first window and number of windows of each; a window is the place of its first word among all words.
    """
    n = len(words)
    end = np.cumsum(size)
    lo, hi = np.repeat(end - size, size), np.repeat(end, size)
    at = np.arange(n)
    stack = [(words, at, at + 1, at, at + 1)]
    for k in range(levels):
        stack.append(_level_up(stack[-1], k, (lo, hi)))
    open_ = np.flatnonzero(at + window <= hi)
    chosen = np.zeros(n, _U)
    which = np.full(n, -1, np.int64)  # level and number of the symbol
    for k in range(levels, -1, -1):
        name, _, _, sl, sr = stack[k]
        first, last = np.searchsorted(sl, open_), np.searchsorted(sr, open_ + window, "right") - 1
        ok = first <= last
        got = open_[ok]
        j = _least(_mix(name), first[ok], last[ok])
        chosen[got] = name[j]
        which[got] = j * (levels + 1) + k
        open_ = open_[~ok]
        if not len(open_):
            break
    all_ = np.flatnonzero(which >= 0)
    if not len(all_):
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], (which[all_][1:] != which[all_][:-1]) | (all_[1:] != all_[:-1] + 1)])
    first = np.flatnonzero(new)
    return chosen[all_[first]], all_[first], np.diff(np.concatenate([first, [len(all_)]]))


def _groups(rows: Iterator[tuple], text_at: int) -> Iterator[list[tuple]]:
    held, total = [], 0
    for r in rows:
        if held and total + len(r[text_at]) > GROUP_BYTES:
            yield held
            held, total = [], 0
        held.append(r)
        total += len(r[text_at])
    if held:
        yield held


def _packed(buckets: int, columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each bucket: the bytes of its part of each column, which comes with the bucket of each value."""
    parts = []
    some = np.zeros(buckets, bool)
    for bucket, values in columns.values():
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some |= bounds[1:] > bounds[:-1]
        parts.append((values[order], bounds))
    at = np.flatnonzero(some)
    out = [pa.array([v[b[i] : b[i + 1]].tobytes() for i in at], pa.binary()) for v, b in parts]
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *out], names=["bucket", *columns])


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[list[np.ndarray]]:
    """Rows come sorted by bucket: the columns of one bucket at a time."""
    held: list[list[bytes]] = []
    now = None
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(len(kinds) + 1))):
            if row[0] != now and held:
                yield [np.frombuffer(b"".join(c), k) for c, k in zip(zip(*held), kinds)]
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield [np.frombuffer(b"".join(c), k) for c, k in zip(zip(*held), kinds)]


SYMBOL = np.dtype((np.void, 5))
KEY = np.dtype([("a", "<i8"), ("b", "<i4")])
SEEN = [SYMBOL, KEY, np.dtype("<u4"), np.dtype("u1"), np.dtype("u1")]
ASKED = [KEY, np.dtype("<u4"), np.dtype("u1"), np.dtype("<u8"), np.dtype("<u8"), np.dtype("<u4")]


def _short(names: np.ndarray) -> np.ndarray:
    """40 bits of a name, which with the bucket tell most symbols apart; what they confuse, the words tell apart."""
    return np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8)[:, :5]).view(SYMBOL).ravel()


def _wide(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :5] = short.view(np.uint8).reshape(-1, 5)
    return out.view(_U).ravel()


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of equal values at each place, and whether it is the first of them there."""
    _, first, place, n = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(values), bool)
    is_first[first] = True
    return n[place], is_first


def _bits(masks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the mask and of the bit, for each bit that is set."""
    of, place = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :size])
    return of.astype(np.int32), place.astype(np.uint8)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(names) % _U(buckets)).astype(np.int64)


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), KEY)
    out["a"], out["b"] = a, b
    return out


def _row_key(own, text, salt: int) -> list:
    """96 bits that stand for a row's id and text: two hash functions that have nothing in common."""
    return [F.xxhash64(F.lit(salt), own, text).alias("ka"), F.hash(F.lit(salt), own, text).alias("kb")]


#: Result rows of one id and one text that are written together.
COPIES_AT_A_TIME = 10_000


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, bool]:
    """doc_id, text, copies and a key (ka, kb), one row for each id and text; with them, whether any row has copies.

    That no two share a key is made sure of: ids and SHA-256 digests of all rows are grouped by key, and where a key has two of them, another
    salt is tried. Rows of one id and one text collapse before they are sent.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    for salt in numbers():
        rows = docs.select(own.alias("doc_id"), text.alias("text"), *_row_key(own, text, salt))
        each = rows.groupBy("ka", "kb", "doc_id", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"))
        most = each.groupBy("ka", "kb").agg(F.count("*").alias("n"), F.max("copies").alias("copies")).agg(F.max("n").alias("n"), F.max("copies").alias("copies")).first()
        if (most.n or 1) > 1:
            continue
        if (most.copies or 1) == 1:
            return rows.withColumn("copies", F.lit(1).cast("long")), False
        again = cut(each.where("copies > 1").select("ka", "kb", "copies"), "substring-copies", "none")
        one = rows.join(again, ["ka", "kb"], "left_anti").withColumn("copies", F.lit(1).cast("long"))
        many = rows.join(again, ["ka", "kb"], "left_semi").groupBy("ka", "kb").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
        return cut(one.unionByName(many), "substring-rows"), True


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, levels: int = LEVELS, buckets: int | None = None, emit_text: bool = False) -> DataFrame:
    """Remove each word that is covered by a window of `window` words whose words also start anywhere else.

    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words with one space between) and, with emit_text, kept_text.
    A null, empty or blank text has no words. Repeated rows count as places of their own, so of two equal texts of a window
    or more both lose all words; ids may be null. Texts shorter than a window keep all; a very long text is taken alone and whole, by
    one worker. An empty table gives no rows. Other columns are not read. Groups of symbols and windows go through buckets; what
    occurs twice within one group of texts is known there: such symbols and windows are sent to their bucket once a group, and the
    other places of them, which need no more proof, are dealt out by row.
    """
    if not 2 <= window <= 63:
        raise ValueError("window must be from 2 to 63 words")
    rows, repeated_rows = _keyed(docs, text_col, id_col)
    partitions, buckets = partitions_of(rows), buckets or buckets_of(rows)
    texts = rows.repartition(partitions, "ka", "kb")  # both joins read this exchange: they ask for the same columns of it

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Symbols of all texts. Of those that repeat within a group, the first tells the bucket so; the others go by row."""
        hashes = WordHashes()
        each = (((a, b), t.encode("utf-8", "surrogatepass")) for c in batches for a, b, t in zip(*(c.column(i).to_pylist() for i in range(3))))
        with np.errstate(over="ignore"):
            for group in _groups(each, 1):
                words = [hashes.of(t.split()) for _, t in group]
                size = np.array([len(w) for w in words])
                name, lo, n = choose(np.concatenate(words), size, window, levels)
                if not len(name):
                    continue
                base = np.cumsum(size) - size
                doc = np.searchsorted(base + size, lo, "right")
                key = np.array([k for k, _ in group], KEY)[doc]
                count, first = _counted(name)
                kind = np.where(count > 1, np.where(first, 2, 3), 1).astype(np.uint8)  # once, repeats: its first, repeats: others
                bucket = np.where(kind == 3, _bucket(key["a"].view(_U) + _U(0), buckets), _bucket(name, buckets))
                cols = {"name": _short(name), "key": key, "lo": (lo - base[doc]).astype(np.uint32), "n": n.astype(np.uint8), "kind": kind}
                yield _packed(buckets, {k: (bucket, v) for k, v in cols.items()})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, key, lo, n, kind in _unpacked(batches, SEEN):
            wide = _wide(name)
            ok = kind == 3
            here = np.flatnonzero(~ok)
            order = here[np.argsort(wide[here], kind="stable")]
            if len(order):
                start = np.flatnonzero(np.concatenate([[True], wide[order][1:] != wide[order][:-1]]))
                weight = np.add.reduceat(kind[order].astype(np.int64), start)
                ok[order] = np.repeat(weight > 1, np.diff(np.append(start, len(order))))
            if ok.any():
                cols = [key["a"][ok], key["b"][ok], lo[ok].astype(np.int32), n[ok].astype(np.int32), wide[ok].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["ka", "kb", "lo", "n", "name"])

    seen = rows.select("ka", "kb", "text").mapInArrow(see, "bucket int, name binary, key binary, lo binary, n binary, kind binary")
    found = seen.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(shared, "ka long, kb int, lo int, n int, name long")
    asked = found.groupBy("ka", "kb").agg(F.collect_list(F.struct("lo", "n", "name")).alias("ask"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of the windows that are asked for, by symbol. A window that repeats within a group comes once, marked so."""
        each = ((a, t.encode("utf-8", "surrogatepass"), k) for c in batches for *k, t, a in zip(c.column(1).to_pylist(), c.column(2).to_pylist(), c.column(3).to_pylist(), c.column(4)))
        with np.errstate(over="ignore"):
            for group in _groups(each, 1):
                table, texts, words = WordNumbers(), [], []
                parts: list[list[np.ndarray]] = [[], [], [], [], []]
                base = 0
                for a, t, k in group:
                    texts.append(t.split())
                    words.append(table.of(texts[-1]))
                    lo, n, name = (a.values.field(i).to_numpy() for i in range(3))
                    _, once = np.unique(lo, return_index=True)  # rows of one key ask alike
                    for c, x in zip(parts, (lo[once] + base, n[once], name[once], np.full(len(once), len(texts) - 1), lo[once])):
                        c.append(x)
                    base += len(texts[-1])
                start, n, name, doc, lo = (np.concatenate(p) for p in parts)
                words = np.concatenate(words)
                first_of = np.cumsum(n) - n
                each_start = np.repeat(start - first_of, n) + np.arange(n.sum())
                count, first = np.empty(len(each_start), np.int64), np.empty(len(each_start), bool)
                for some, cls in _classes(words, table.hashes(), each_start, window):
                    count[some], first[some] = _counted(cls)
                bit = _U(1) << (np.arange(len(each_start)) - np.repeat(first_of, n)).astype(_U)
                known, sent = (np.bitwise_or.reduceat(np.where(m, bit, _U(0)), first_of) for m in (count > 1, first))
                place = np.where(first, np.arange(len(first)) - np.repeat(first_of, n), -1)
                last = np.maximum.reduceat(place, first_of)
                some = last >= 0
                begin = np.minimum.reduceat(np.where(first, place, 64), first_of)
                sent >>= np.where(some, begin, 0).astype(_U)
                length = np.where(some, last - begin + window, 0)
                key = np.array([tuple(k) for _, _, k in group], KEY)[doc]
                bucket = np.where(some, _bucket(name.view(_U), buckets), _bucket(key["a"].view(_U) + _U(0), buckets))
                skip = np.where(some, begin, 0).astype(np.uint8)
                cols = {"key": key, "lo": lo.astype(np.uint32), "skip": skip, "known": known, "sent": sent, "length": length.astype(np.uint32)}
                packed = _packed(buckets, {k: (bucket, v) for k, v in cols.items()})
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                blobs = []
                for b in packed.column(0).to_numpy():
                    mine = order[bounds[b] : bounds[b + 1]]
                    mine = mine[some[mine]]
                    blobs.append(b" ".join(w for d, i, j in zip(doc[mine].tolist(), (lo[mine] + begin[mine]).tolist(), (lo[mine] + last[mine] + window).tolist()) for w in texts[d][i:j]))
                yield packed.append_column("words", pa.array(blobs, pa.binary()))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, words, names in _with_words(batches):
            again: list[tuple[np.ndarray, np.ndarray]] = []
            key, lo, skip, known, sent, length = records
            at = np.cumsum(length.astype(np.int64)) - length
            of, place = _bits(sent, window)
            for some, cls in _classes(words, names, at[of] + place, window):
                mine, shift = of[some], (place[some] + skip[of[some]]).astype(_U)
                weight = 1 + (known[mine] >> shift & _U(1)).astype(np.int64)  # those known before don't change it: they count as two
                more = np.bincount(cls, weight)[cls] > 1
                again.append((mine[more], shift[more]))
            for mine, shift in again:
                np.bitwise_or.at(known, mine, _U(1) << shift)
            some = np.flatnonzero(known)
            if len(some):
                some = some[np.lexsort((lo[some], key["b"][some], key["a"][some]))]
                out = np.empty(len(some), RUN)
                out["lo"], out["mask"] = lo[some], known[some]
                k = key[some]
                start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                ends = np.append(start[1:], len(some))
                cols = [pa.array(k["a"][start]), pa.array(k["b"][start]), pa.array([out[i:j].tobytes() for i, j in zip(start, ends)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["ka", "kb", "runs"])

    kinds = "key binary, lo binary, skip binary, known binary, sent binary, length binary, words binary"
    windows = texts.join(asked, ["ka", "kb"]).select("doc_id", "ka", "kb", "text", "ask", "copies").mapInArrow(spans, f"bucket int, {kinds}")
    again = windows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(repeated, "ka long, kb int, runs binary")
    gone = again.groupBy("ka", "kb").agg(F.collect_list("runs").alias("gone"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * emit_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * emit_text + ", copies long"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, where, copies in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = words
                if copies > 1 and len(words) >= window:  # each window starts in each copy
                    kept = []
                elif where:
                    runs = np.frombuffer(b"".join(where), RUN)
                    of, place = _bits(np.ascontiguousarray(runs["mask"]), window)
                    start = np.unique(runs["lo"][of].astype(np.int64) + place)
                    mark = np.zeros(len(words) + 1, np.int64)
                    mark[start] += 1
                    mark[start + window] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                joined = b" ".join(kept)
                for c, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if emit_text else None)):
                    c.append(x)
            cols = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[3], pa.string())] * emit_text + [b.column(5)], names=[*names, "copies"])

    out = texts.join(gone, ["ka", "kb"], "left").select("doc_id", "ka", "kb", "text", "gone", "copies").mapInArrow(finish, schema)
    if not repeated_rows:
        return out.select(*names)
    # a row for each copy: the numbers of copies are parted and dealt out before rows are made of them
    times = F.transform(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES_AT_A_TIME)), lambda k: F.least(F.col("copies") - k * COPIES_AT_A_TIME, F.lit(COPIES_AT_A_TIME)))
    dealt = out.select(*names, F.explode(times).alias("_times")).repartition(partitions)
    return dealt.select(*names, F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*names)


#: First window of a run and which of the windows from there repeat.
RUN = np.dtype([("lo", "<u4"), ("mask", "<u8")])


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows come sorted by bucket: for each bucket its records, the numbers of their words, and a hash of each number."""
    held: list[list[bytes]] = []
    table, words, now = WordNumbers(), [], None

    def done() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        all_words = np.concatenate(words)
        return [np.frombuffer(b"".join(c), k).copy() for c, k in zip(zip(*held), ASKED)], all_words, table.hashes()

    for b in batches:
        for i in range(b.num_rows):
            bucket, *row = (c[i].as_py() for c in b.columns)
            if bucket != now and held:
                yield done()
                held, table, words = [], WordNumbers(), []
            now = bucket
            words.append(table.of(row.pop().split()))
            held.append(row)
    if held:
        yield done()
