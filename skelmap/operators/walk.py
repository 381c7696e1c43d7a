"""Walks, headings and help with missing paths over a table of paths, such as the inventory of a store: many trees at once, of any size.

The driver's own walk (`sources.tree`) goes through one tree of a file system; these come to the same files in the same order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import format_of
from ..sources.shared import written
from ..sources.tree import DENIED, MAX_ENTRIES, SHOWN_HIDDEN
from . import directory
from .limits import first_rows

# The messages.
OUTSIDE = "index: {path} is outside the workspace; `index` is confined to the project directory. Use `read` for files outside it (host `read` can be unjailed), or copy the file in first."
NO_ANCESTOR = "index: cannot access {asked} (No such file or directory (os error 2)). No directory above it exists inside the workspace; use `glob` to locate the file."
MISSING = "index: no such path {asked} — `{missing}` is not in {here}, which contains: {entries}"
MORE_ENTRIES = " Use `glob` if the file you want is not listed."
TAIL = "  … and {more} more ({total} total)."
CUT_SHORT = " — walk stopped at {limit} entries, so this is a LOWER BOUND; index a subdirectory for a complete view"


def filled(template: str, **parts: Column) -> Column:
    """A message with columns in place of its {names}."""
    return F.concat(*[parts[s].cast("string") if i % 2 else F.lit(s) for i, s in enumerate(re.split(r"\{(\w+)\}", template)) if s])


def wanted(name: Column, is_dir: Column) -> Column:
    """Is an entry of this name walked or kept?"""
    dotenv = ~is_dir & ((name == ".env") | name.startswith(".env."))  # a folder of that name is a virtual environment
    return F.when(name.startswith("."), name.isin(sorted(SHOWN_HIDDEN)) | dotenv).otherwise(~(is_dir & name.isin(sorted(DENIED))))


def walked(files: DataFrame, tree: str, key: str, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The entries that a walk of each tree comes to: tree, key, rel, is_dir, nth (from 1), found, stopped.

    files: tree, key, rel (components). A tree is walked depth first, the names of a folder in order, which is the order of the paths' components,
    so no folder is gone into one by one. Every entry counts, also one that is passed over; what lies under a folder that isn't walked
    isn't come to. found marks supported files, stopped a tree that has more than max_entries. Folders have a null key. Paths without components
    are left out; rows that share a path count each, in the order of key. Each tree is cut to max_entries before its shuffle.
    """
    rows = files.where(F.size("rel") > 0).select(tree, key, "rel")
    no_key = F.lit(None).cast(dict(rows.dtypes)[key]).alias(key)
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size("rel") - 1), lambda n: F.slice("rel", F.lit(1), n)))
    dirs = rows.where(F.size("rel") > 1).select(tree, above.alias("rel")).distinct().select(tree, no_key, "rel", F.lit(True).alias("is_dir"))
    inner = F.slice("rel", F.lit(1), F.size("rel") - 1)
    entries = rows.withColumn("is_dir", F.lit(False)).unionByName(dirs).where(F.forall(inner, lambda x: wanted(x, F.lit(True))))
    kept = first_rows(entries, [tree], [F.col("rel"), F.col("is_dir"), F.col(key)], max_entries + 1)
    kept = kept.withColumn("stopped", F.max("nth").over(Window.partitionBy(tree)) > max_entries).where(F.col("nth") <= max_entries)
    base = F.element_at("rel", -1)
    return kept.withColumn("found", ~F.col("is_dir") & wanted(base, F.col("is_dir")) & format_of(base).isNotNull())


def heading(display: Column, n_files: Column, n_dirs: Column, stopped: Column, limit: int = MAX_ENTRIES) -> Column:
    """`display — N supported files in D directories`, with a note where the walk stopped."""
    plus = F.when(stopped, "+").otherwise("")
    word = F.when((n_dirs == 1) & ~stopped, "directory").otherwise("directories")
    note = F.when(stopped, CUT_SHORT.format(limit=limit)).otherwise("")
    return filled("{display} — {n}{plus} supported files in {d}{plus} {word}{note}", display=display, n=n_files, d=n_dirs, plus=plus, word=word, note=note)


def headings(entries: DataFrame, tree: str, limit: int = MAX_ENTRIES) -> DataFrame:
    """One row a tree of walked(): n_files, n_dirs, stopped and its heading."""
    parent = F.slice("rel", F.lit(1), F.size("rel") - 1)
    out = entries.groupBy(tree).agg(F.count_if("found").alias("n_files"), F.countDistinct(F.when(F.col("found"), parent)).alias("n_dirs"), F.any_value("stopped").alias("stopped"))
    return out.withColumn("heading", heading(F.col(tree), F.col("n_files"), F.col("n_dirs"), F.col("stopped"), limit))


def normalised(parts: Column) -> Column:
    """Components of an absolute path without empty ones, `.` and `..`; `..` at the root stays there."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", back).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, none, step)


def inside(parts: Column, root: Column) -> Column:
    """Is a path of these components the root or under it?"""
    return F.slice(parts, F.lit(1), F.greatest(F.size(root), F.lit(0))) == root


def shown(parts: Column, cwd: Column) -> Column:
    """The path from cwd where it lies in it, `.` for cwd itself, else the whole path."""
    rest = F.array_join(F.slice(parts, F.size(cwd) + 1, F.lit(1 << 30)), "/")
    return F.when(parts == cwd, ".").when(inside(parts, cwd), rest).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def miss_messages(asked: DataFrame, files: DataFrame, key: str, path: str = "rel") -> DataFrame:
    """key and message of paths that aren't there: what the deepest folder above each holds, its first 50 names.

    asked: key, path (components); files: rel. Names are listed only for folders that are named in a message, and cut to 50 before their shuffle.
    """
    dirs = written(directory.folders(files), "folders")
    named_in = lambda rows, tail: rows.where(F.size("rel") > 0).select(F.array_join(F.slice("rel", F.lit(1), F.size("rel") - 1), "/").alias("_dir"), F.concat(F.element_at("rel", -1), F.lit(tail)).alias("_name"))
    children = named_in(files, "").unionByName(named_in(dirs, "/")).distinct()
    best = directory.nearest_ancestors(asked, dirs, key, path).withColumn("_asked", F.array_join(path, "/"))
    named = children.join(best.select(F.col("ancestor").alias("_dir")).distinct(), "_dir", "left_semi")
    totals = named.groupBy("_dir").agg(F.count("*").alias("_total"))
    some = first_rows(named, ["_dir"], [F.col("_name")], directory.MAX_LISTED).groupBy("_dir").agg(F.array_join(F.array_sort(F.collect_list("_name")), "  ").alias("_names"))
    listed = totals.join(some, "_dir")
    more = F.col("_total") - directory.MAX_LISTED
    tail = F.when(more > 0, F.concat(filled(TAIL, more=more, total=F.col("_total")), F.lit(MORE_ENTRIES))).otherwise("")
    here = F.when(F.col("ancestor") == "", "the workspace root").otherwise(F.concat("ancestor", F.lit("/")))
    found = F.concat(filled(MISSING, asked=F.col("_asked"), missing=F.col("missing"), here=here, entries=F.col("_names")), tail)
    none = filled(NO_ANCESTOR, asked=F.col("_asked"))
    return best.join(listed, F.col("ancestor") == F.col("_dir"), "left").select(key, F.coalesce(found, none).alias("message"))
