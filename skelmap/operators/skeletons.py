"""Directories shown by the skeletons of their files, within a budget of files and bytes: many directories at once.

What a skeleton costs is known only once its file is parsed. So files are taken in rounds, each directory's next ones in order, and
a directory whose budget is used up takes no more: what lies beyond is neither read nor parsed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import human_bytes, line_count
from ..sources.shared import drop_written, written
from . import directory
from .limits import ranked
from .outline import decoded, outline
from .walk import filled

#: Files of a directory that the first round takes; a later one takes as many as all before.
FIRST_FILES = 4

# The messages.
SHOWN = " (showing {k}; index a specific file or subdirectory for the rest)"
HEAD = "{display} — {n} supported files"


def skeleton_head(rel: Column, content: Column) -> Column:
    """`path (N lines, SIZE)`, of the bytes that were read."""
    return F.concat(rel, F.lit(" ("), line_count(decoded(content)).cast("string"), F.lit(" lines, "), human_bytes(F.length(content)), F.lit(")"))


def _before(value: Column | str, by: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(by).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shown_skeletons(
    files: DataFrame, by: str, bodies: Callable[[DataFrame], DataFrame], depth: int | None = 1, parity: bool = False,
    max_files: int = directory.MAX_SHOWN_FILES, max_bytes: int = directory.MAX_SHOWN_BYTES, first: int = FIRST_FILES,
) -> DataFrame:
    """The files of each directory that are shown: by, nth (place among its files), rel, text (the skeleton and a line break).

    files: by, rel, fmt and what bodies() needs. bodies() is given rows of files and returns those that can be read, with content and name, which heads the
    skeleton. Files are taken in the order of rel; one that can't be read or outlined is passed over and costs nothing. A file is
    shown while fewer than max_files were shown and their texts are under max_bytes in all, so the last may go beyond. Rounds are as
    many as the doublings from `first` to what a directory takes, and no more than twice what is come to, plus `first`, is read. A null directory is one like
    the others. Files that share a path come in the order of rows. Files are numbered by ranges of the order, so a directory may have any number of them.
    """
    placed = written(ranked(files.withColumn("_row", F.monotonically_increasing_id()), by, ["rel", "_row"], "nth").drop("_row"), "skeleton-files")
    state = placed.groupBy(by).agg(F.max("nth").alias("_n")).select(F.col(by).alias("_by"), "_n", F.lit(0).cast("long").alias("_shown"), F.lit(0).cast("long").alias("_bytes"))
    state = written(state, "skeleton-state")
    rounds: list[DataFrame] = []
    taken, step = 0, first
    while not rounds or not state.isEmpty():
        batch = placed.where((F.col("nth") > taken) & (F.col("nth") <= taken + step)).join(state, F.col(by).eqNullSafe(F.col("_by"))).drop("_by", "_n")
        read = bodies(batch).withColumn("file_id", F.col("nth"))
        parsed = outline(read, depth, parity, keep=[by, "rel", "nth", "_shown", "_bytes"]).where(~F.col("is_error"))
        texts = parsed.select(by, "nth", "rel", F.concat("text", F.lit("\n")).alias("text"), "_shown", "_bytes").withColumn("_size", F.octet_length("text").cast("long"))
        texts = texts.withColumn("_before", F.col("_bytes") + _before("_size", by)).withColumn("_place", F.col("_shown") + _before(F.lit(1), by))
        kept = written(texts.where((F.col("_before") < max_bytes) & (F.col("_place") < max_files)).select(by, "nth", "rel", "text", "_size"), "skeleton-round")
        rounds.append(kept.drop("_size"))
        taken, step = taken + step, taken + step
        more = kept.groupBy(F.col(by).alias("_b")).agg(F.count("*").alias("_k"), F.sum("_size").alias("_s"))
        after = state.join(more, F.col("_by").eqNullSafe(F.col("_b")), "left").select(
            "_by", "_n", (F.col("_shown") + F.coalesce("_k", F.lit(0))).alias("_shown"), (F.col("_bytes") + F.coalesce("_s", F.lit(0))).alias("_bytes")
        )
        now = written(after.where((F.col("_n") > taken) & (F.col("_shown") < max_files) & (F.col("_bytes") < max_bytes)), "skeleton-state")
        drop_written(state)
        state = now
    drop_written(placed, state)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def render_skeletons(files: DataFrame, shown: DataFrame, by: str) -> DataFrame:
    """One row for each directory of files: by, n_files, n_shown and text, the whole answer. What is shown fits in the budget, so a text is bounded."""
    totals = files.groupBy(by).agg(F.count("*").alias("n_files"))
    texts = shown.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "").alias("_body"))
    out = totals.join(texts, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("n_shown", F.coalesce("_k", F.lit(0)))
    note = F.when(F.col("n_shown") < F.col("n_files"), filled(SHOWN, k=F.col("n_shown"))).otherwise("")
    head = filled(HEAD, display=F.coalesce(F.col(by).cast("string"), F.lit("")), n=F.col("n_files"))
    return out.select(by, "n_files", "n_shown", F.concat(head, note, F.lit("\n\n"), F.coalesce("_body", F.lit(""))).alias("text"))
