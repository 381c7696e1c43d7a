"""Source trees as tables.

`spark.read.format("srctree")` lists a tree by name and size only; bodies are read by with_content() on the executors, so
what needs no bodies reads none. Spark's own file sources won't do: they pass over names that start with a dot or an
underscore. Paths must be visible to the executors, as on one machine or a shared mount.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from heapq import nsmallest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formats import py_format_of

MAX_ENTRIES = 20_000
MAX_FILE_BYTES = 2 * 1024 * 1024
BATCH_FILES = 2000

# Hidden folders that are walked, and folders that never are.
SHOWN_HIDDEN = frozenset([".github", ".gitlab", ".circleci"])
DENIED = frozenset(["node_modules", "target", "vendor", "dist", "build", "__pycache__", "venv", "obj"])

SCHEMA = "path string, rel array<string>, base string, size bigint, is_dir boolean"


def _wanted(name: str, is_dir: bool) -> bool:
    if name.startswith("."):
        # a folder named like a dotenv file is a virtual environment
        return name in SHOWN_HIDDEN or (not is_dir and (name == ".env" or name.startswith(".env.")))
    return not (is_dir and name in DENIED)


def walk(root: str, max_entries: int = MAX_ENTRIES, supported_only: bool = True) -> tuple[list[tuple[str, list[str], str, int, bool]], bool]:
    """Rows of SCHEMA for the files under root, and whether the walk stopped at max_entries.

    Depth first, names of a folder in order: a folder is walked where its name comes, before the names after it. Every name that is come to counts
    against max_entries, also one that is passed over; files come to before the end are kept. Of a folder no more names are held than
    the walk can still come to. Symbolic links and folders that can't be read are passed over.
    """
    found, left, stopped = [], max_entries, False

    def names(path: str) -> Iterator[os.DirEntry]:
        nonlocal stopped
        try:
            with os.scandir(path) as it:
                entries = nsmallest(left + 1, it, key=lambda e: e.name)
        except OSError:
            return iter(())
        stopped |= len(entries) > left
        return iter(entries[:left])

    todo: list[tuple[list[str], Iterator[os.DirEntry]]] = [([], names(root))]
    while todo:
        rel, entries = todo[-1]
        e = next(entries, None)
        if e is None:
            todo.pop()
            continue
        if left <= 0:
            return found, True
        left -= 1
        try:
            if e.is_symlink():
                continue
            info = e.stat(follow_symlinks=False)
        except OSError:
            continue
        is_dir = stat.S_ISDIR(info.st_mode)
        if not _wanted(e.name, is_dir):
            continue
        if is_dir:
            todo.append(([*rel, e.name], names(e.path)))
        elif stat.S_ISREG(info.st_mode) and (not supported_only or py_format_of(e.name)):
            found.append((e.path, [*rel, e.name], e.name, info.st_size, False))
    return found, stopped


def listing(root: str) -> list[tuple[str, list[str], str, int, bool]] | None:
    """One level of a folder, everything in it; None if it can't be read. An entry that can't be looked at counts as an empty file."""

    def row(e: os.DirEntry) -> tuple[str, list[str], str, int, bool]:
        try:
            is_dir = e.is_dir(follow_symlinks=False)
            return e.path, [e.name], e.name, 0 if is_dir else e.stat(follow_symlinks=False).st_size, is_dir
        except OSError:
            return e.path, [e.name], e.name, 0, False

    try:
        with os.scandir(root) as it:
            return sorted(map(row, it))
    except OSError:
        return None


class _Files(InputPartition):
    def __init__(self, rows: list):
        super().__init__(len(rows))
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.limit = int(options.get("maxentries", MAX_ENTRIES))
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.all = options.get("filter", "supported").lower() == "none"

    def partitions(self) -> list[InputPartition]:
        rows = walk(self.root, self.limit, not self.all)[0] if self.recursive else (listing(self.root) or [])
        return [_Files(rows[i : i + BATCH_FILES]) for i in range(0, len(rows), BATCH_FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from partition.rows


class TreeSource(DataSource):
    """Options: path, maxEntries (20000), recursive (true), filter (supported, or none)."""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def read_bounded(path: str, cap: int = MAX_FILE_BYTES) -> bytes | None:
    """The bytes of a file; None if it can't be read or holds more than cap by now."""
    try:
        with open(path, "rb") as f:
            data = f.read(cap + 1)
    except OSError:
        return None
    return data if len(data) <= cap else None


def with_content(files: DataFrame, cap: int = MAX_FILE_BYTES) -> DataFrame:
    """files with a column content, null where the file can't be read or is over cap."""
    names = files.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 32):
                some = pdf.iloc[at : at + 32]
                yield some.assign(content=[read_bounded(p, cap) for p in some["path"]])[[*names, "content"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", content binary"
    return files.mapInPandas(run, schema)
