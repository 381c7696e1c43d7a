"""Outlines of files as they arrive, by Structured Streaming.

Beyond the engine's batch operators: a stateless mapping of new files, so it needs no watermark. Spark's file source passes over
names that begin with a dot or an underscore; list a whole tree with the srctree source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import GRAMMARS, format_of
from ..functions.text import base_name
from ..operators.outline import MAX_FILE_BYTES, bounded_depth, decoded, grammar_decls


def outline_stream(spark: SparkSession, path: str, depth: int | None = 1, max_files: int = 1000) -> DataFrame:
    """path, fmt, imports, decls, truncated of each new file that has a grammar; at most max_files a batch."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    files = reader.load(path).where(F.col("length") <= MAX_FILE_BYTES).withColumn("fmt", format_of(base_name(F.col("path")))).where(F.col("fmt").isin(list(GRAMMARS)))
    rows = files.select(F.xxhash64("path").alias("file_id"), "path", "fmt", decoded(F.col("content")).alias("text"))
    return grammar_decls(rows, bounded_depth(depth), keep=["path", "fmt"]).drop("file_id")
