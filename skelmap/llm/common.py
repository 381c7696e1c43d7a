"""What the operators of this subpackage share: cut lineages, the shared folder, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table

#: Input to a bucket, which one worker holds, and to a partition of an exchange, where that is more than the session's.
BUCKET_BYTES = 4 << 20
PARTITION_BYTES = 512 << 20
#: Rows of a few numbers that go to one file of cut().
FILE_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which the cluster names.

    Where it is unset, a local session, whose driver is its executor, gets a temporary folder that goes when the driver ends; any other session
    must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skelmap-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def planned_bytes(df: DataFrame) -> int:
    """Bytes of df by the planner's estimate, which runs nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 59 else df.rdd.getNumPartitions() * BUCKET_BYTES  # it can't tell, as for rows from the driver


def partitions_of(df: DataFrame) -> int:
    """Partitions of an exchange of df: the session's number, or more where these would be over PARTITION_BYTES of input each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), planned_bytes(df) // PARTITION_BYTES)


def buckets_of(df: DataFrame) -> int:
    """Buckets of BUCKET_BYTES of df, at least one a partition."""
    return max(partitions_of(df), planned_bytes(df) // BUCKET_BYTES)


_recorded: list[dict] = []


def cut(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None, a_file: int = FILE_ROWS) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: a short lineage that outlives executors.

    Numbers that hardly shrink are better written uncompressed: each file's codec holds buffers outside the heap. rows: about how many rows df has
    at most, where that is known; they go to a file for each a_file of them instead of one a partition. All rows are written either way. On a
    local file system each file also costs processes that set its permissions.
    """
    if rows is not None:
        df = df.coalesce(rows // a_file + 1)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    for tables in _recorded:
        tables[path] = out
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables of cut() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        for found in _recorded:
            found.pop(df.cut_path, None)


@contextmanager
def recorded() -> Iterator[dict[str, DataFrame]]:
    """The tables that cut() writes meanwhile and that weren't discarded, by path: to discard once what reads them is written."""
    tables: dict[str, DataFrame] = {}
    _recorded.append(tables)
    try:
        yield tables
    finally:
        _recorded.remove(tables)


def tables_dir(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def lowest_hashed(pool: DataFrame, by: str, n: int, total: int) -> DataFrame:
    """At most n rows of each group of pool, and total rows in all: those with the least h, a hash of 64 bits that pool has.

    Groups share the total alike; where there are more groups than that, those with most rows have one each. Groups are counted first; then a bound on h
    lets through about twice what is wanted, whatever the size of the group, so the ranking that follows handles few rows. A
    sample that comes out short of n by chance is left so.
    """
    counts = pool.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by).limit(total).collect()
    n = max(1, min(n, total // max(1, len(counts))))
    bounds = [(r[by], min(int(min(1.0, (2 * n + 200) / r.n) * 2**64) - 2**63, 2**63 - 1)) for r in counts]
    kind = dict(pool.dtypes)[by]
    table = F.broadcast(pool.sparkSession.createDataFrame(bounds, f"_by {kind}, _bound long"))  # total rows at most
    nth = F.row_number().over(Window.partitionBy(by).orderBy("h", *[c for c in pool.columns if c not in (by, "h")]))
    few = pool.join(table, (F.col(by) == F.col("_by")) & (F.col("h") <= F.col("_bound"))).select(*pool.columns)
    return few.withColumn("nth", nth).where(F.col("nth") <= n)


def least(codes: np.ndarray, n: int) -> np.ndarray:
    """The n of these distinct codes whose hashes are least, in the order of the codes."""
    if len(codes) <= n:
        return codes
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return codes[np.sort(np.argpartition(h * np.uint64(0xBF58476D1CE4E5B9), n)[:n])]


def row_ident(digest: Column, own: Column) -> Column:
    """What rows of one text and one id share and no others: the digest in hex and the id."""
    return F.concat(F.hex(digest), F.lit(":"), F.coalesce(own.cast("string"), F.lit("")))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root), root the smallest node reached.

    Alternating large-star and small-star steps. A step is a minimum per node, which combines before its shuffle, and an
    equi-join, whose hot keys adaptive execution splits; no neighbour list is ever collected. Each round is
    written to the shared folder, and the rounds, whose number grows with the logarithm of the nodes, stop when the edges no longer
    change. rows: about how many edges there are at most, where that is known, as in cut(); no round makes them more.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", "none", rows)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above u go to the minimum of u's neighbourhood
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its neighbours below u go to their minimum
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        old, edges = edges, cut(small, "cc", "none", rows)
        discard(old)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")), allowMissingColumns=False)
