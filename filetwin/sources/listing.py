"""Listing a directory tree into rows, spread over the executors."""

from __future__ import annotations

import fnmatch
import os
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..session import fresh_dir
from .stores import plain_path, store_of

ENTRY_SCHEMA = "kind string, path string, parent_path string, size bigint, mtime bigint, error_status string"
# Of a folder with very many names, a row stands for a part of them.
_LEVEL_SCHEMA = ENTRY_SCHEMA + ", part int, parts int"
BATCH_ROWS = 10_000
SPLIT_NAMES = 100_000
FILE, FOLDER, NEXT = "file", "folder", "next"


def _entries(
    store, path: str, parent: str | None, part: int, parts: int, hidden: bool, split: int, tasks: int
) -> Iterator[tuple]:
    """The folder's own row, its files, and its sub-folders as `next` rows.

    A folder of more than `split` names becomes several `next` rows, each for the names of one hash value, whose sizes
    other tasks look up. Each of them reads all names, so there are no more rows than `tasks`. An unreadable folder
    keeps its row with the error; a file that cannot be read is left out.
    """
    try:
        waiting, names = [], 0
        for entry in store.entries(path):
            if not hidden and entry.name[0] in "._":
                continue
            if parts > 1 and zlib.crc32(entry.name.encode("utf-8", "surrogateescape")) % parts != part:
                continue
            names += 1
            if parts > 1 or names <= split:
                waiting.append(entry)
            if parts > 1 and len(waiting) >= BATCH_ROWS:
                yield from _rows(waiting, path)
                waiting = []
        if parts == 1 and names > split:
            count = min(-(-names // split), max(tasks, 2))
            for k in range(count):
                yield NEXT, path, parent, None, None, None, k, count
            return
        yield from _rows(waiting, path)
        if part == 0:
            yield FOLDER, path, parent, None, None, None, 0, 1
    except OSError as error:
        if part == 0:
            yield FOLDER, path, parent, None, None, str(error), 0, 1


def _rows(entries: list, path: str) -> Iterator[tuple]:
    for entry in entries:
        if entry.is_folder:
            yield NEXT, entry.path, path, None, None, None, 0, 1
            continue
        try:
            size, mtime = entry.stat()
        except OSError:
            continue
        yield FILE, entry.path, path, size, mtime, None, 0, 1


def _list_folders(handle: Callable, hidden: bool, split: int, tasks: int):
    names = ["kind", "path", "parent_path", "size", "mtime", "error_status", "part", "parts"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=names)
        return df.astype({"size": "Int64", "mtime": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        store = None
        for batch in batches:
            for path, parent, part, parts in batch.itertuples(index=False):
                store = store or handle(path)
                for row in _entries(store, path, parent, part, parts, hidden, split, tasks):
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    return run


def walk_tree(
    spark: SparkSession,
    root: str,
    hidden: bool = True,
    traverse_links: bool = False,
    out_dir: str | None = None,
    tasks: int | None = None,
    handle: Callable = store_of,
    split: int = SPLIT_NAMES,
) -> DataFrame:
    """All folders and files at or below `root`: kind, path, parent_path, size, mtime, error_status, root_path.

    The tree is listed level by level; the folders of a level are spread over the executors and
    each level is a written table in the shared folder, so a lost executor costs one task and the
    driver never holds names. `root` is a path that all executors see or a URI of a store; tasks list it through the
    file-system handle that `handle(path)` gives them. A folder with more than `split` names is dealt to
    several tasks, to all at most.
    Empty files, empty folders and hidden names are included (`hidden=False` skips names beginning with '.' or '_').
    """
    root = plain_path(root)
    out_dir = out_dir or fresh_dir(spark, "walk")
    tasks = tasks or spark.sparkContext.defaultParallelism
    if not traverse_links and os.path.islink(root):
        empty = spark.createDataFrame([], ENTRY_SCHEMA)
        return empty.withColumn("root_path", F.lit(root))
    frontier = spark.createDataFrame([(root, None, 0, 1)], "path string, parent_path string, part int, parts int")
    level = 0
    while True:
        target = f"{out_dir}/level={level}"
        (
            frontier.repartition(tasks if level else 1, "path", "part")
            .mapInPandas(_list_folders(handle, hidden, split, tasks), _LEVEL_SCHEMA)
            .write.mode("overwrite")
            .parquet(target)
        )
        written = spark.read.schema(_LEVEL_SCHEMA).parquet(target)
        frontier = written.where(F.col("kind") == NEXT).select("path", "parent_path", "part", "parts")
        if frontier.isEmpty():
            break
        level += 1
    found = spark.read.schema(ENTRY_SCHEMA).parquet(*[f"{out_dir}/level={n}" for n in range(level + 1)])
    return found.where(F.col("kind") != NEXT).withColumn("root_path", F.lit(root))


def listed_files(entries: DataFrame) -> DataFrame:
    """The files of a walk as a listing: path, size, mtime, folder_path, root_path."""
    return entries.where(F.col("kind") == FILE).select(
        "path", "size", "mtime", F.col("parent_path").alias("folder_path"), "root_path"
    )


def listed_folders(entries: DataFrame) -> DataFrame:
    """The folders of a walk: folder_path, parent_path, root_path, error_status."""
    return entries.where(F.col("kind") == FOLDER).select(
        F.col("path").alias("folder_path"), "parent_path", "root_path", "error_status"
    )


def list_files(spark: SparkSession, root: str, glob: str | None = None, **walk) -> DataFrame:
    """Every file below `root`, empty and hidden ones included: path, size, mtime, folder_path, root_path.

    `glob` keeps the files whose name it matches. Listed by `walk_tree`, whose options it takes; no file is opened.
    """
    found = listed_files(walk_tree(spark, root, **walk))
    return found.where(base_name("path").rlike(fnmatch.translate(glob))) if glob else found
