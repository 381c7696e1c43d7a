"""Maps of directories: tier, per-file map, per-child rollup, and nearest existing ancestors.

Files are rows of rel (components of the path from the directory), size and, for maps, content. Functions take the columns
that tell several directories apart, so one call maps many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import human_bytes
from ..sources.shared import written
from .limits import greedy_budget

SKELETON_FILES = 30
MAP_FILES = 300
MAX_SHOWN_FILES = 200
MAX_SHOWN_BYTES = 256 * 1024
LINE_COUNT_BYTES = 8 * 1024 * 1024
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_LISTED = 50


def tier(n: Column) -> Column:
    """How a directory of n supported files is shown."""
    return F.when(n == 0, "empty").when(n <= SKELETON_FILES, "skeleton").when(n <= MAP_FILES, "map").otherwise("rollup")


def scale(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n_files, n_dirs (distinct folders that hold a file), bytes and tier of each directory; reads no bodies."""
    parent = F.slice("rel", F.lit(1), F.size("rel") - 1)
    out = files.groupBy(*by).agg(F.count("*").alias("n_files"), F.countDistinct(parent).alias("n_dirs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return out.withColumn("tier", tier(F.col("n_files")))


def rollup(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each immediate child: label (folders end in /), n_files, bytes and the rendered row."""
    label = F.when(F.size("rel") > 1, F.concat(F.col("rel")[0], F.lit("/"))).otherwise(F.col("rel")[0])
    out = files.groupBy(*by, label.alias("label")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    word = F.when(F.col("n_files") == 1, "file").otherwise("files")
    padded = F.concat(F.col("label"), F.repeat(F.lit(" "), F.greatest(F.lit(0), 28 - F.length("label"))))
    return out.withColumn("line", F.concat(padded, F.format_string(" %5d %-5s ", "n_files", word), human_bytes(F.col("bytes"))))


def file_map(files: DataFrame, by: Sequence[str] = (), budget: int = LINE_COUNT_BYTES, readable: int = MAX_FILE_BYTES) -> DataFrame:
    """One row for each file: rel, size, read (is its line count within the reading budget) and skipped (past the budget).

    For directories of the map tier: a directory's sizes, at most MAP_FILES of them, are folded in the order of its paths.
    """
    each = files.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rel", "size"))).alias("_files"))
    read = greedy_budget(F.transform("_files", lambda f: f["size"].cast("long")), budget, readable)
    out = each.select(*by, F.explode(F.arrays_zip(F.col("_files").alias("f"), read.alias("r"))).alias("x"))
    return out.select(*by, F.col("x.f.rel").alias("rel"), F.col("x.f.size").alias("size"), F.col("x.r.read").alias("read"), F.col("x.r.skipped").alias("skipped"))


def map_line(rel: Column, lines: Column, size: Column) -> Column:
    """`path (N lines, SIZE)`; `?` for a null count."""
    return F.concat(F.array_join(rel, "/"), F.lit(" ("), F.coalesce(lines.cast("string"), F.lit("?")), F.lit(" lines, "), human_bytes(size), F.lit(")"))


def nearest_ancestors(asked: DataFrame, dirs: DataFrame, key: str = "id", path: str = "rel") -> DataFrame:
    """For each asked row its path, its deepest ancestor among dirs, and the first component that is missing under it.

    asked: key and path (components). dirs: rel, the components of folders that exist, in any number of copies; a folder needn't have
    its own ancestors among them. Rows are merged in the order of paths: folders and asked paths are dealt out by ranges once, and a task
    keeps the folders that are open at its place, at most as many as a path has components. What isn't settled in its range has its
    ancestors among those of the range's first path, as folders of earlier ranges can only hold a later path if they hold that one; they
    are looked up for each range, not for each path. So what is shuffled is a row for each path and folder, whatever the depth, and
    equal paths are dealt out by their rows. Asked rows keep their number; a null path, or one without an ancestor, has nulls.
    """
    rows = asked.where(F.col(path).isNotNull()).select(F.col(key).alias("_key"), F.col(path).alias("_p"), F.lit(True).alias("_asked"), F.monotonically_increasing_id().alias("_row"))
    known = dirs.where(F.col("rel").isNotNull()).select(F.col("rel").alias("_p")).distinct()
    known = known.select(F.lit(None).cast(asked.schema[key].dataType).alias("_key"), "_p", F.lit(False).alias("_asked"), F.lit(0).cast("long").alias("_row"))
    order = ["_p", "_asked", "_row"]
    merged = rows.unionByName(known).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = T.StructType([*(T.StructField(f.name, f.dataType) for f in merged.schema), T.StructField("_n", T.IntegerType()), T.StructField("_range", T.IntegerType()), T.StructField("_first", T.ArrayType(T.StringType()))])
    met = written(merged.mapInArrow(_open_folders, kind), "ancestors")

    # one row a range, with the depths at which its first path has a folder above it, or is one
    firsts = met.where(F.col("_first").isNotNull()).select("_range", "_first")
    steps = firsts.select("_range", "_first", F.explode(F.sequence(F.lit(0), F.size("_first"))).alias("_d"))
    steps = F.broadcast(steps.withColumn("_above", F.slice("_first", F.lit(1), F.col("_d"))))
    before = met.where(~F.col("_asked")).select("_p").join(steps, F.col("_p") == F.col("_above"))
    before = before.groupBy("_range", F.col("_first").alias("_head")).agg(F.collect_set("_d").alias("_depths"))

    found = met.where("_asked").select("_key", "_p", "_n", "_range").join(F.broadcast(before), "_range", "left")
    holds = lambda d: (d <= F.greatest(F.size("_p") - 1, F.lit(0))) & (F.slice("_p", F.lit(1), d) == F.slice("_head", F.lit(1), d))
    n = F.coalesce("_n", F.array_max(F.filter("_depths", holds)))
    found = found.select("_key", "_p", n.alias("_n")).select(F.col("_key").alias(key), F.col("_p").alias(path), F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "/").alias("ancestor"), F.try_element_at("_p", F.col("_n") + 1).alias("missing"))
    none = F.lit(None).cast("string")
    return found.unionByName(asked.where(F.col(path).isNull()).select(key, path, none.alias("ancestor"), none.alias("missing")))


def _open_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in the order of paths, each asked one with the depth of its deepest folder in the range; the first row tells its path."""
    here, first, open_ = TaskContext.get().partitionId(), True, []
    for b in batches:
        depths: list[int | None] = []
        paths = b.column("_p").to_pylist()
        for p, is_asked in zip(paths, b.column("_asked").to_pylist()):
            while open_ and p[: len(open_[-1])] != open_[-1]:
                open_.pop()
            if not is_asked:
                open_.append(p)
                depths.append(None)
                continue
            above = open_[:-1] if open_ and p and open_[-1] == p else open_
            depths.append(len(above[-1]) if above else None)
        heads = [None] * len(paths)
        if first and paths:
            heads[0], first = paths[0], False
        new = [pa.array(depths, pa.int32()), pa.array([here] * len(paths), pa.int32()), pa.array(heads, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "_n", "_range", "_first"])


def folders(files: DataFrame) -> DataFrame:
    """rel of all folders above files, the root among them, each once.

    The folders that hold files are taken in the order of their paths, and each names only those that the one before it hasn't, so
    there is a row for each folder (and the first one's ancestors in each range), not for each folder of each file.
    """
    holding = files.where(F.col("rel").isNotNull()).select(F.slice("rel", F.lit(1), F.greatest(F.size("rel") - 1, F.lit(0))).alias("rel")).distinct()
    return holding.repartitionByRange("rel").sortWithinPartitions("rel").mapInArrow(_new_folders, "rel array<string>").distinct()


def _new_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        out = []
        for p in b.column("rel").to_pylist():
            same = -1
            if last is not None:
                same = next((i for i, (x, y) in enumerate(zip(p, last)) if x != y), min(len(p), len(last)))
            out += [p[:n] for n in range(same + 1, len(p) + 1)]
            last = p
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["rel"])
