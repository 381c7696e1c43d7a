"""index(path, depth): the outline of a file, the map of a directory, or help with a path that isn't there."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import format_of, py_format_of
from ..functions.text import line_count, py_human_bytes
from ..operators import directory
from ..operators.outline import MAX_FILE_BYTES, TOO_LARGE, bounded_depth, decoded, outline
from ..operators.skeletons import SHOWN, shown_skeletons, skeleton_head
from ..operators.walk import CUT_SHORT, MISSING, MORE_ENTRIES, NO_ANCESTOR, OUTSIDE, TAIL
from ..sources import frontier, tree

# The messages.
NO_PATH = "index: missing `path` argument."
NOT_LISTED = "index: no such path {asked} — `{missing}` is not in {here}, which could not be listed. Use `glob` to locate the file."
EMPTY_FOLDER = "index: no such path {asked} — {here} is empty."
NOTHING_HERE = "index: {display} contains no supported source files to outline.{contents} Use `grep`/`read` to explore it."
MAP_HEAD = "(map only — `index <file>` or `index <subdir>` for skeletons)"
ROLLUP_HEAD = "(rolled up — `index <subdir>` to descend)"
UNREAD = "({n} line counts skipped past a {budget} read budget — sizes above are exact)"


def inside(path: str, roots: list[str]) -> bool:
    """Is the real path one of the roots or under one?"""
    real = os.path.realpath(path)
    return any(real == r or real.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots))


def workspace_display(path: str, cwd: str | None) -> str:
    """The path from cwd where it lies in it, `.` for cwd itself, else as it is."""
    for root in filter(None, (cwd, cwd and os.path.realpath(cwd))):
        if path == root:
            return "."
        if path.startswith(root.rstrip("/") + "/"):
            return path[len(root.rstrip("/")) + 1 :]
    return path


def _listed(names: list[str], total: int) -> str:
    tail = TAIL.format(more=total - len(names), total=total) if total > len(names) else ""
    return "  ".join(names) + tail


def list_entries(path: str) -> tuple[list[str], int] | None:
    """The alphabetically first 50 names of a folder, folders with a slash, and how many there are."""
    rows = tree.listing(path)
    if rows is None:
        return None
    names = sorted(r[2] + "/" * r[4] for r in rows)
    return names[: directory.MAX_LISTED], len(names)


def nearest_existing_ancestor(path: str, roots: list[str]) -> tuple[str, str] | None:
    """The deepest folder above path that exists within the roots, and the component under it that doesn't."""
    missing, cur = os.path.basename(path), os.path.dirname(path)
    while cur and missing:
        if os.path.exists(cur):
            return (os.path.realpath(cur), missing) if inside(cur, roots) and os.path.isdir(cur) else None
        missing, cur = os.path.basename(cur), os.path.dirname(cur)
    return None


def miss_message(path: str, roots: list[str], cwd: str | None) -> str:
    asked = workspace_display(path, cwd)
    found = nearest_existing_ancestor(path, roots)
    if found is None:
        return NO_ANCESTOR.format(asked=asked)
    folder, missing = found
    shown = workspace_display(folder, cwd)
    here = "the workspace root" if shown == "." else f"{shown}/"
    entries = list_entries(folder)
    if entries is None:
        return NOT_LISTED.format(asked=asked, missing=missing, here=here)
    names, total = entries
    if not total:
        return EMPTY_FOLDER.format(asked=asked, here=here)
    return MISSING.format(asked=asked, missing=missing, here=here, entries=_listed(names, total)) + MORE_ENTRIES * (total > len(names))


def files_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """The supported files under path: SCHEMA's columns, fmt, and file_id in the order of paths."""
    tree.register(spark)
    reader = spark.read.format("srctree").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().withColumn("fmt", format_of(F.col("base")))


def outline_tree(spark: SparkSession, path: str, depth: int | None = 1, parity: bool = False) -> DataFrame:
    """Outlines of all supported files of a tree, which the driver lists: rel, name, fmt, text, is_error. Bodies are never gathered."""
    files = tree.with_content(files_table(spark, path, maxEntries=str(1 << 62)).where(F.col("size") <= MAX_FILE_BYTES))
    return _tree_outlines(files, depth, parity)


def outline_large_tree(spark: SparkSession, path: str, depth: int | None = 1, parity: bool = False) -> DataFrame:
    """outline_tree() of a tree of any size: folders are listed in tasks, a level of the tree a round, and tasks read alike many bytes.

    It writes its listing to the shared folder, which costs some seconds a level; nothing but counts comes to the driver.
    """
    found = frontier.walk_tree(spark, path).files.where(F.col("size") <= MAX_FILE_BYTES).withColumn("fmt", format_of(F.col("base")))
    return _tree_outlines(tree.with_content(frontier.packed(found)), depth, parity)


def _tree_outlines(files: DataFrame, depth: int | None, parity: bool) -> DataFrame:
    keyed = files.withColumn("file_id", F.col("path")).withColumn("name", F.array_join("rel", "/"))
    return outline(keyed, depth, parity).withColumnRenamed("name", "rel")


def _note(cut: int) -> str:
    """cut: the number of entries that the walk stopped at, or 0."""
    return CUT_SHORT.format(limit=cut) if cut else ""


def _skeletons(files: DataFrame, display: str, depth: int, n: int, cut: int) -> str:
    """The skeletons of one directory; only files that are come to within its budget are read."""

    def bodies(some: DataFrame) -> DataFrame:
        some = tree.with_content(some).where(F.col("content").isNotNull())
        return some.withColumn("name", skeleton_head(F.array_join("rel", "/"), F.col("content")))

    shown = shown_skeletons(files.withColumn("one", F.lit(1)), "one", bodies, depth).orderBy("nth").select("text").collect()  # under 200 files and 256 KiB
    some = SHOWN.format(k=len(shown)) if len(shown) < n else ""
    return f"{display} — {n} supported files{some}{_note(cut)}\n\n" + "".join(r.text for r in shown)


def _scale(files: DataFrame, display: str, cut: int) -> str:
    r = directory.scale(files).first()
    plus = "+" if cut else ""
    word = "directory" if r.n_dirs == 1 and not cut else "directories"
    return f"{display} — {r.n_files}{plus} supported files in {r.n_dirs}{plus} {word}{_note(cut)}"


def _map(files: DataFrame, display: str, cut: int) -> str:
    plan = directory.file_map(files)
    paths = files.select("rel", "path")
    bodies = tree.with_content(plan.join(paths, "rel").where("read")).select("rel", line_count(decoded(F.col("content"))).alias("lines"))
    rows = plan.join(bodies, "rel", "left").orderBy("rel").select(directory.map_line(F.col("rel"), F.col("lines"), F.col("size")).alias("line"), "skipped").collect()  # at most 300
    unread = sum(r.skipped for r in rows)
    foot = "\n" + UNREAD.format(n=unread, budget=py_human_bytes(directory.LINE_COUNT_BYTES)) + "\n" if unread else ""
    return f"{_scale(files, display, cut)}\n{MAP_HEAD}\n\n" + "".join(r.line + "\n" for r in rows) + foot


def _rollup(files: DataFrame, display: str, cut: int) -> str:
    rows = directory.rollup(files).orderBy("label").select("line").collect()  # immediate children
    return f"{_scale(files, display, cut)}\n{ROLLUP_HEAD}\n\n" + "".join(r.line + "\n" for r in rows)


def _directory(spark: SparkSession, path: str, display: str, depth: int, max_entries: int) -> tuple[str, bool]:
    rows, stopped = tree.walk(path, max_entries)
    cut = max_entries if stopped else 0
    if not rows:
        entries = list_entries(path)
        contents = "" if entries is None else f" It contains: {_listed(*entries)}" if entries[1] else " The directory is empty."
        return NOTHING_HERE.format(display=display, contents=contents), True
    files = files_table(spark, path, maxEntries=max_entries)
    if len(rows) <= directory.SKELETON_FILES:
        return _skeletons(files, display, depth, len(rows), cut), False
    return (_map if len(rows) <= directory.MAP_FILES else _rollup)(files, display, cut), False


def index(spark: SparkSession, path: str, depth: int | None = 1, cwd: str | None = None, roots: list[str] | None = None, parity: bool = False, max_entries: int = tree.MAX_ENTRIES) -> tuple[str, bool]:
    """Text and whether it is an error. Paths are taken from cwd and confined to roots (cwd unless given)."""
    if not path:
        return NO_PATH, True
    depth, cwd = bounded_depth(depth), cwd or os.getcwd()
    roots = roots or [cwd]
    full = path if os.path.isabs(path) else os.path.join(cwd, path)
    if not os.path.exists(full):
        return miss_message(full, roots, cwd), True
    if not inside(full, roots):
        return OUTSIDE.format(path=full), True
    real = os.path.realpath(full)
    if os.path.isdir(real):
        return _directory(spark, real, path, depth, max_entries)
    size = os.path.getsize(real)
    if size > MAX_FILE_BYTES:
        return TOO_LARGE % size, True
    content = tree.read_bounded(real)
    name = os.path.basename(real)
    one = spark.createDataFrame([(0, name, py_format_of(name), None if content is None else bytearray(content))], "file_id bigint, name string, fmt string, content binary")
    r = outline(one, depth, parity).first()
    return r.text, r.is_error
