"""Where paths lead through symbolic links: all paths and all links of many trees at once, over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_written, written

#: Links that a path goes through at most; one that goes on is a loop, as it is for the kernel.
MAX_LINKS = 40
PARTS = "array<string>"


def _real(parts: Column) -> Column:
    return F.filter(parts, lambda x: ~x.isin("", "."))


def _run(parts: Column) -> Column:
    """How many `..` an array begins with: counted up while they last, then held below zero."""
    n = F.aggregate(parts, F.lit(0), lambda n, x: F.when(n < 0, n).when(x == "..", n + 1).otherwise(-n - 1))
    return F.when(n < 0, -n - 1).otherwise(n)


def resolved(paths: DataFrame, links: DataFrame, path: str = "parts", max_links: int = MAX_LINKS) -> DataFrame:
    """paths with real (components of where each leads; null for a loop) and looped.

    paths: `path`, the components of absolute paths. links: at (components of a link's own place, whose folders are real) and target, a path from its
    folder or from the root. As for the kernel, `..` steps back from where a link leads, not from the link, and a path that goes through
    more than max_links links is a loop; names that don't exist are taken as they stand. Null paths give a null. Where links share a
    place, that with the least target counts.

    A round takes each open path to its first link, found by an equi-join of its prefixes with the links, or past the first `..`;
    paths that are done leave the rounds, which are as many as the most links and steps back of one path; a loop takes max_links of them.
    """
    own = paths.columns
    rows = written(paths.withColumn("_row", F.monotonically_increasing_id()), "links-paths")
    known = links.groupBy(F.array_join("at", "/").alias("_at")).agg(F.min("target").alias("_target"))
    known = written(known, "links-known")
    none = F.array().cast(PARTS)
    open_ = rows.where(F.col(path).isNotNull()).select("_row", none.alias("done"), _real(F.col(path)).alias("rest"), F.lit(0).alias("hops"))
    ended: list[DataFrame] = []
    before: DataFrame | None = None
    while before is None or not before.isEmpty():
        upto = F.when(F.array_contains("rest", ".."), F.array_position("rest", "..").cast("int") - 1).otherwise(F.size("rest"))
        now = open_.withColumn("m", upto)
        steps = now.where("m > 0").select("_row", "done", "rest", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("k"))
        steps = steps.select("_row", "k", F.array_join(F.concat("done", F.slice("rest", F.lit(1), F.col("k"))), "/").alias("_p"))
        hits = steps.join(known, F.col("_p") == F.col("_at")).groupBy(F.col("_row").alias("_r")).agg(F.min(F.struct("k", "_target")).alias("hit"))
        met = now.join(hits, F.col("_row") == F.col("_r"), "left")
        k, target = F.col("hit.k"), F.col("hit._target")
        folder = F.concat("done", F.slice("rest", F.lit(1), k - 1))
        after = F.slice("rest", k + 1, F.lit(1 << 30))
        back = F.slice("rest", F.col("m") + 1, F.lit(1 << 30))
        so_far = F.concat("done", F.slice("rest", F.lit(1), F.col("m")))
        left = F.slice(so_far, F.lit(1), F.greatest(F.size(so_far) - _run(back), F.lit(0)))
        is_hit, through = F.col("hit").isNotNull(), F.concat(_real(F.split(target, "/")), after)
        step = met.select(
            "_row",
            F.when(is_hit, F.when(target.startswith("/"), none).otherwise(folder)).otherwise(left).alias("done"),
            F.when(is_hit, through).otherwise(F.slice(back, _run(back) + 1, F.lit(1 << 30))).alias("rest"),
            (F.col("hops") + is_hit.cast("int")).alias("hops"),
        )
        found = written(step.withColumn("over", (F.size("rest") == 0) | (F.col("hops") > max_links)), "links-round")
        ended.append(found.where("over").select("_row", F.when(F.col("hops") <= max_links, F.col("done")).alias("real"), (F.col("hops") > max_links).alias("looped")))
        before = open_ = found.where("NOT over").drop("over")
    drop_written(known)
    every = ended[0]
    for e in ended[1:]:
        every = every.unionByName(e)
    return rows.join(every.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left").select(*own, "real", F.coalesce("looped", F.lit(False)).alias("looped"))
