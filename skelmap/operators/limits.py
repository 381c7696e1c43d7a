"""Ordered limits: first rows, first items, running budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "nth") -> DataFrame:
    """The first n rows of each group, numbered from 1. Groups are cut to n before the shuffle as well as after it."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, nth).where(F.col(name) <= n)


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "nth") -> DataFrame:
    """rows numbered from 1 in an order without ties, however many they are.

    Rows are dealt out by ranges of the order, which are written once; a row's number is its place in the range, plus the rows of the
    ranges before. Only counts of ranges, a row for each partition, are gathered in one place. The written table is the result's attribute `reads`.
    """
    at = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ranges = at.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = F.broadcast(ranges.select("_range", (F.col("_first") - before).alias("_less")))
    out = at.join(ranges, F.shiftright("_at", 33) == F.col("_range")).select(*rows.columns, (F.col("_at") - F.col("_less") + 1).alias(name))
    out.reads = at
    return out


def ranked(rows: DataFrame, by: str, order: Sequence[str], name: str = "nth") -> DataFrame:
    """rows (of `by` and other columns) numbered from 1 in each group, in an order without ties, nulls last; a group of any size.

    Rows are dealt out by ranges of group and order and numbered by their place; a group's number is that place less its first one in
    the range, plus its rows in the ranges before. The ranges are written once, as both the places and the counts must come from the same.
    """
    keys = [F.col(by), *map(F.asc_nulls_last, order)]
    at = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    parts = at.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_by", "_p", "_first", before.alias("_before"))
    met = at.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return met.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))


def capped(items: Column, n: int) -> Column:
    """Distinct items in their order; beyond n, the first n and how many more there are."""
    kept = F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    more = F.array(F.format_string("(+%d more)", F.size(kept) - n))
    return F.when(F.size(kept) <= n, kept).otherwise(F.concat(F.slice(kept, F.lit(1), F.lit(n)), more))


def within_budget(rows: DataFrame, by: Sequence[str], order: Sequence[Column], size: str, max_rows: int, max_size: int) -> DataFrame:
    """Rows of each group while fewer than max_rows came before and their sizes are under max_size in all.

    The last row may go beyond max_size. Cutting to max_rows first keeps a group's running sum to so many rows.
    """
    some = first_rows(rows, by, order, max_rows, "_nth")
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.withColumn("_before", before).where(F.col("_before") < max_size).drop("_before", "_nth")


def greedy_budget(sizes: Column, budget: int, readable: int) -> Column:
    """For an ordered array of sizes, whether each is read, in turn, within what is left of the budget.

    A size over what is left is passed over and costs nothing, as does one over `readable`, which can't be read. Items: read
    (boolean) and skipped (for the budget alone). It is a fold: what is read now decides what is left for later.
    """
    zero = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<read:boolean,skipped:boolean>>").alias("out"))

    def step(a: Column, size: Column) -> Column:
        skipped = size > a["left"]
        read = ~skipped & (size <= readable)
        item = F.array(F.struct(read.alias("read"), skipped.alias("skipped")))
        return F.struct((a["left"] - F.when(read, size).otherwise(0)).cast("long").alias("left"), F.concat(a["out"], item).alias("out"))

    return F.aggregate(sizes, zero, step, lambda a: a["out"])
