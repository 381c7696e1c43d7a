"""Trees of any size: folders are listed in tasks, a level of the tree a round, and nothing but counts comes to the driver.

`tree.walk` goes through one tree on the driver, which suits a request of 20,000 entries. Here each round lists all folders that the
one before came to. A walk's order, depth first and by name, is that of the paths' components, so its budget is settled by places in that
order, and folders that lie beyond the budget already are never opened.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import py_format_of
from .shared import drop_written, written
from .tree import MAX_FILE_BYTES, _wanted

ENTRIES = "path string, rel array<string>, base string, size bigint, kind string"
#: Rows that a task sends at a time; folders that a task is to list, at least.
BATCH_ROWS = 4096
FOLDERS_A_TASK = 64
#: Bytes of a task that reads bodies, and what opening a file counts for.
PACK_BYTES = 32 << 20
OPEN_BYTES = 16 << 10


@dataclass
class Walked:
    """files: path, rel, base, size, is_dir (false) of the files that are kept. stopped: did the walk end at its budget?"""

    files: DataFrame
    stopped: bool
    opened: int


def _lossy(name: str) -> str:
    return os.fsencode(name).decode("utf-8", "replace")


def _entries(path: str, rel: list[str], limit: int | None, supported_only: bool) -> Iterator[tuple]:
    """Rows of ENTRIES for the names of a folder, the first `limit` in order. kind: dir (to be walked), file (kept), passed (only counts)."""
    try:
        with os.scandir(path) as it:
            for e in it if limit is None else nsmallest(limit, it, key=lambda e: e.name):
                kind, size = "passed", 0
                try:
                    if not e.is_symlink():
                        info = e.stat(follow_symlinks=False)
                        is_dir = stat.S_ISDIR(info.st_mode)
                        if _wanted(e.name, is_dir):
                            if is_dir:
                                kind = "dir"
                            elif stat.S_ISREG(info.st_mode) and (not supported_only or py_format_of(e.name)):
                                kind, size = "file", info.st_size
                except OSError:
                    pass
                yield _lossy(e.path), [*rel, _lossy(e.name)], _lossy(e.name), size, kind
    except OSError:
        return


def _listed(folders: DataFrame, limit: int | None, supported_only: bool) -> DataFrame:
    """The entries of folders (path, rel). A task sends what it lists as it goes, so a folder of any size is held by no one."""
    types = [pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string()]
    names = ["path", "rel", "base", "size", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for path, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in _entries(path, rel, limit, supported_only):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield done()
                        rows = []
        if rows:
            yield done()

    return folders.select("path", "rel").mapInArrow(run, ENTRIES)


def walk_tree(spark: SparkSession, root: str, max_entries: int | None = None, supported_only: bool = True) -> Walked:
    """The files that a walk of root comes to within max_entries entries, all of them without one: those of `tree.walk`.

    Every name of a folder that is walked counts, also one that is passed over: hidden ones, links, formats that aren't known.
    Folders that can't be read are empty. A name that isn't UTF-8 is shown with U+FFFD, and what is under it can't be read.
    With a budget, each round keeps the first max_entries + 1 of all entries that are known, by ranges of their order, and only
    folders among the first max_entries are listed next: what is found later can only push others back. Rounds are as many as
    the tree is deep; driver and tables hold no more than a round's entries beside those.
    """
    from ..operators.limits import numbered

    folders = spark.createDataFrame([(root, [])], "path string, rel array<string>")
    rounds: list[DataFrame] = []
    known, opened, n = None, 0, 1
    while n:
        opened += n
        tasks = max(1, min(n // FOLDERS_A_TASK + 1, 64 * spark.sparkContext.defaultParallelism))
        found = written(_listed(folders.repartition(tasks), None if max_entries is None else max_entries + 1, supported_only), "walk-round")
        new = F.lit(True)
        if max_entries is not None:
            every = found.withColumn("new", new) if known is None else found.withColumn("new", new).unionByName(known.withColumn("new", F.lit(False)))
            placed = numbered(every, [F.col("rel")], "nth")
            kept = written(placed.where(F.col("nth") <= max_entries + 1), "walk-known")
            drop_written(found, placed.reads, *([known] if known is not None else []))
            known = kept.drop("new", "nth")
            known.written_path = kept.written_path
            found = kept.where("new").where(F.col("nth") <= max_entries)
        else:
            rounds.append(found)
        folders = found.where("kind = 'dir'")
        n = folders.count()
    if max_entries is None:
        files, stopped = rounds[0], False
        for r in rounds[1:]:
            files = files.unionByName(r)
    else:
        files, stopped = kept.where(F.col("nth") <= max_entries), kept.count() > max_entries
    return Walked(files.where("kind = 'file'").select("path", "rel", "base", "size", F.lit(False).alias("is_dir")), stopped, opened)


def packed(files: DataFrame, pack_bytes: int = PACK_BYTES, cap: int = MAX_FILE_BYTES) -> DataFrame:
    """files dealt to tasks by their sizes: each gets about pack_bytes to read, however sizes are spread.

    A file counts for its size, for no more than cap, as larger ones aren't read, and for OPEN_BYTES at least. Rows are put in bins by running sums within each
    partition of a table that is written once; bins are numbered through by the partitions' counts, and each is one task.
    """
    names = files.columns
    at = names.index("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sum_ = TaskContext.get().partitionId(), 0
        for b in batches:
            bins = []
            for size in b.column(at).to_pylist():
                bins.append(sum_ // pack_bytes)
                sum_ += max(OPEN_BYTES, size if size is not None and size <= cap else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(bins), pa.int32()), pa.array(bins, pa.int32())], names=[*names, "_part", "_bin"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", _part int, _bin int"
    binned = written(files.mapInArrow(run, schema), "packed")
    parts = binned.groupBy("_part").agg((F.max("_bin") + 1).alias("n")).orderBy("_part").collect()  # one row for each partition
    first, total = [], 0
    for r in parts:
        first.append((r._part, total))
        total += r.n
    starts = F.broadcast(files.sparkSession.createDataFrame(first, "_p int, _first int"))
    numbered = binned.join(starts, F.col("_part") == F.col("_p"))
    return numbered.repartitionById(max(total, 1), (F.col("_first") + F.col("_bin")).cast("int")).select(*names)
