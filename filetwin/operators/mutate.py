"""Catalog changes. Each takes the old table and returns the new one; `sources.tables` stores it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import subtree_end, tree_key
from ..session import materialize
from .integrity import root_statistics
from .ordered import running_max
from .skew import fits_broadcast, lookup


class Catalog(NamedTuple):
    roots: DataFrame
    folders: DataFrame
    files: DataFrame
    scans: DataFrame


def latest_per_key(new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, the other columns breaking ties.

    A maximum, so a key seen very often combines before the shuffle.
    """
    rest = [name for name in new.columns if name not in keys and name not in order]
    return (
        new.groupBy(*keys)
        .agg(F.max(F.struct(*order, *rest)).alias("_row"))
        .select(*[F.col(name) if name in keys else F.col(f"_row.{name}") for name in new.columns])
    )


def merge(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    rule: Callable[[Column, Column], dict[str, Column]],
    force_outer: bool = False,
) -> DataFrame:
    """Old and new rows of unique keys combined column by column.

    `rule(exists, arrives)` gives an expression for every column that may change; inside it `x` is
    the old and `n_x` the new value. A batch small enough to broadcast leaves the old table where
    it is; a larger one takes a full outer join.
    """
    values = [name for name in old.columns if name not in keys]
    arriving = new.select(*keys, *[F.col(v).alias(f"n_{v}") for v in values], F.lit(True).alias("_new"))
    marked = old.withColumn("_old", F.lit(True))
    if fits_broadcast(new) and not force_outer:
        matched = old.select(*keys).join(new.select(*keys), keys, "left_semi")
        inserts = arriving.join(matched, keys, "left_anti")
        blank = [F.lit(None).cast(old.schema[v].dataType).alias(v) for v in values]
        inserts = inserts.select("*", *blank, F.lit(None).cast("boolean").alias("_old"))
        joined = marked.join(arriving, keys, "left").unionByName(inserts)
    else:
        joined = marked.join(arriving, keys, "full_outer")
    changes = rule(F.col("_old").isNotNull(), F.col("_new").isNotNull())
    insert_only = lambda v: F.when(F.col("_old").isNull(), F.col(f"n_{v}")).otherwise(F.col(v))
    return joined.select(
        *[F.col(c) if c in keys else changes.get(c, insert_only(c)).alias(c) for c in old.columns]
    )


def _replaced(names: list[str], arrives: Column) -> dict[str, Column]:
    return {name: F.when(arrives, F.col(f"n_{name}")).otherwise(F.col(name)) for name in names}


def _revived(exists: Column, arrives: Column) -> Column:
    return F.when(exists & arrives, 0).when(arrives, F.col("n_removed")).otherwise(F.col("removed"))


def upsert_files(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """Files by path: an arriving row replaces all but the first scan time and clears `removed`."""
    latest = latest_per_key(new.select(*old.columns), ["path"], ["last_scanned_at", "mtime"])
    replaced = [c for c in old.columns if c not in ("path", "first_scanned_at", "removed")]
    return merge(
        old,
        latest,
        ["path"],
        lambda exists, arrives: {**_replaced(replaced, arrives), "removed": _revived(exists, arrives)},
        **options,
    )


def upsert_folders(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """Folders by path: parent, error and last time replaced, root and first time kept."""
    latest = latest_per_key(new.select(*old.columns), ["folder_path"], ["last_scanned_at"])
    replaced = ["parent_path", "error_status", "last_scanned_at"]
    return merge(
        old,
        latest,
        ["folder_path"],
        lambda exists, arrives: {**_replaced(replaced, arrives), "removed": _revived(exists, arrives)},
        **options,
    )


def upsert_roots(old: DataFrame, new: DataFrame, strict: bool = False, **options) -> DataFrame:
    """Roots by path: agent and link flag replaced, statistics kept.

    New roots start without statistics. With `strict` an existing path is an error, found by a job of
    its own before there is a result.
    """
    if strict:
        clash = old.select("root_path").join(new.select("root_path").distinct(), "root_path", "left_semi").head()
        if clash:
            raise ValueError(f"root already registered: {clash['root_path']}")
    zero = F.lit(0).cast("bigint")
    added = new.select(
        "root_path",
        "agent_id",
        "traverse_links",
        F.lit(None).cast("bigint").alias("last_scan_date"),
        *[zero.alias(c) for c in ("folder_count", "file_count", "total_size")],
    )

    def rule(exists: Column, arrives: Column) -> dict[str, Column]:
        return _replaced(["agent_id", "traverse_links"], arrives)

    return merge(old, latest_per_key(added, ["root_path"], ["agent_id"]), ["root_path"], rule, **options)


def upsert_agents(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """Agents by (name, guid): enabled, updated and status replaced, the id kept."""
    latest = latest_per_key(new.select(*old.columns), ["name", "guid"], ["updated"])
    replaced = ["enabled", "updated", "status"]
    return merge(old, latest, ["name", "guid"], lambda exists, arrives: _replaced(replaced, arrives), **options)


def set_hashes(files: DataFrame, digests: DataFrame, now: int, **skew) -> DataFrame:
    """Hash and algorithm of the given paths set, their last scan time stamped.

    A good hash clears an earlier error; a failed one (no hash, but `error_status`, if the digests
    have that column) is recorded and keeps the old hash. Of several digests of one path a good one
    counts, the largest of them.
    """
    error = F.col("error_status") if "error_status" in digests.columns else F.lit(None)
    named = digests.select(
        "path",
        F.struct(
            F.col("hash_value").isNotNull().alias("good"),
            F.col("hash_algorithm").alias("algorithm"),
            F.col("hash_value").alias("hash"),
            error.cast("string").alias("error"),
        ).alias("_d"),
    ).where(F.col("_d.good") | F.col("_d.error").isNotNull())
    fresh = named.groupBy("path").agg(F.max("_d").alias("_d")).select(
        "path", F.col("_d.hash").alias("_hash"), F.col("_d.algorithm").alias("_algorithm"), F.col("_d.error").alias("_error")
    )
    good = F.col("_hash").isNotNull()
    hit = good | F.col("_error").isNotNull()
    return (
        files.join(fresh, "path", "left")
        .withColumns(
            {
                "hash_value": F.coalesce("_hash", "hash_value"),
                "hash_algorithm": F.when(good, F.col("_algorithm")).otherwise(F.col("hash_algorithm")),
                "error_status": F.when(good, F.lit(None)).otherwise(F.coalesce("_error", "error_status")),
                "last_scanned_at": F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("last_scanned_at")),
            }
        )
        .select(*files.columns)
    )


def set_removed(table: DataFrame, paths: DataFrame, removed: int, now: int, key: str = "path") -> DataFrame:
    """`removed` set or cleared for the given paths of files (or folders, with their key)."""
    hits = paths.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        table.join(hits, key, "left")
        .withColumns(
            {
                "removed": F.when(F.col("_hit"), F.lit(removed)).otherwise(F.col("removed")),
                "last_scanned_at": F.when(F.col("_hit"), F.lit(now).cast("bigint")).otherwise(
                    F.col("last_scanned_at")
                ),
            }
        )
        .select(*table.columns)
    )


def refresh_roots(roots: DataFrame, folders: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """Live counts and bytes written into the roots with the scan time."""
    stats = root_statistics(roots, folders, files)
    kept = roots.drop("folder_count", "file_count", "total_size")
    return (
        kept.join(stats, "root_path")
        .withColumn("last_scan_date", F.lit(now).cast("bigint"))
        .select(*roots.columns)
    )


def delete_root(catalog: Catalog, doomed: DataFrame, **skew) -> Catalog:
    """The catalog without the roots in `doomed` (root_path) and all that belongs to them."""
    gone = doomed.select("root_path").distinct()
    without = lambda df, spread: lookup(df, gone, ["root_path"], "left_anti", spread=spread, **skew)
    return Catalog(
        without(catalog.roots, "root_path"),
        without(catalog.folders, "folder_path"),
        without(catalog.files, "path"),
        without(catalog.scans, "scan_id"),
    )


def deleted_statistics(roots: DataFrame, doomed: DataFrame) -> DataFrame:
    """What `delete_root` reports: the stored counts and bytes of each deleted root."""
    return roots.join(doomed.select("root_path").distinct(), "root_path", "left_semi").select(
        "root_path", "folder_count", "file_count", "total_size"
    )


def folders_below(folders: DataFrame, tops: DataFrame) -> DataFrame:
    """Folders at or below one of `tops` (folder_path, root_path) in the same root: folder_path, root_path.

    Folders and tops are sorted together so that a subtree is a run of rows. A folder lies below a top when the furthest end of
    the tops before it is behind it, which is a running maximum over ranges: one row per folder, however deep, and neither
    recursion nor `/a/docs2` comes in.
    """
    rows = folders.select("folder_path", "root_path", tree_key("folder_path", "root_path").alias("key"))
    ends = tops.select(tree_key("folder_path", "root_path").alias("key")).distinct()
    both = ends.withColumn("end", subtree_end("key")).unionByName(rows, allowMissingColumns=True)
    reached = running_max(both, ["key", F.col("end").asc_nulls_last()], "end", "reach", "subtrees")
    return reached.where(F.col("folder_path").isNotNull() & (F.col("reach") > F.col("key"))).select(
        "folder_path", "root_path"
    )


class Purge(NamedTuple):
    folders: DataFrame
    files: DataFrame
    counts: DataFrame


def purge_removed(
    folders: DataFrame,
    files: DataFrame,
    kind: str = "all",
    root_path: str | None = None,
    before: int | None = None,
    **skew,
) -> Purge:
    """Removed rows deleted: `files`, `folders` or `all`, with `before` those last seen earlier.

    Deleting a folder deletes everything below it, live or not; `counts` has those rows apart. With `root_path` the
    other roots' rows are handed on as they are and only that root's are looked at.
    """
    if kind not in ("files", "folders", "all"):
        raise ValueError(f"unknown kind to purge: {kind}")
    if root_path is not None:
        own = F.col("root_path").eqNullSafe(F.lit(root_path))
        done = purge_root(folders, files, root_path, kind, before, **skew)
        return Purge(
            folders.where(~own).unionByName(done.folders), files.where(~own).unionByName(done.files), done.counts
        )
    return _purged(folders, files, kind, before, **skew)


def purge_root(
    folders: DataFrame, files: DataFrame, root_path: str, kind: str = "all", before: int | None = None, **skew
) -> Purge:
    """`purge_removed` of one root, giving that root's rows only, as `sources.tables.replace_roots` stores them."""
    own = F.col("root_path") == root_path
    return _purged(folders.where(own), files.where(own), kind, before, **skew)


def _purged(folders: DataFrame, files: DataFrame, kind: str, before: int | None, **skew) -> Purge:
    wanted = F.col("removed") == 1
    if before is not None:
        wanted = wanted & (F.col("last_scanned_at") < before)
    file_marks = files.withColumn("_own", wanted if kind != "folders" else F.lit(False))
    folder_marks = folders.withColumn("_own", wanted if kind != "files" else F.lit(False))
    if kind == "files":
        # Nothing lies below a file.
        file_marks, folder_marks = [df.withColumn("_below", F.lit(False)) for df in (file_marks, folder_marks)]
    else:
        below = materialize(folders_below(folders, folders.where(wanted)), "purged-folders")
        doomed = below.select("folder_path", F.lit(True).alias("_below"))
        folder_marks = folder_marks.join(doomed, "folder_path", "left")
        file_marks = lookup(file_marks, doomed, ["folder_path"], "left", spread="path", **skew)
    fate = F.when(F.col("_own"), "purged").when(F.col("_below"), "cascaded").otherwise("kept")
    folder_fate = folder_marks.withColumn("_fate", fate)
    file_fate = file_marks.withColumn("_fate", fate)

    rows = folder_fate.select("root_path", F.lit("folders").alias("k"), "_fate").unionByName(
        file_fate.select("root_path", F.lit("files").alias("k"), "_fate")
    )
    tally = lambda k, f: F.count_if((F.col("k") == k) & (F.col("_fate") == f))
    counts = (
        rows.where(F.col("_fate") != "kept")
        .groupBy("root_path")
        .agg(
            tally("files", "purged").alias("purged_files"),
            tally("folders", "purged").alias("purged_folders"),
            tally("files", "cascaded").alias("cascaded_files"),
            tally("folders", "cascaded").alias("cascaded_folders"),
        )
    )
    return Purge(
        folder_fate.where(F.col("_fate") == "kept").select(*folders.columns),
        file_fate.where(F.col("_fate") == "kept").select(*files.columns),
        counts,
    )


def scan_state(events: DataFrame) -> DataFrame:
    """Current row per scan from the append-only log; cleared scans are gone.

    Events: `start`, `save` (folder, file), `complete`, `clear`; `seq` orders equal times. All
    aggregates are extremes, so a scan with very many saves combines before the shuffle.
    """
    is_event = lambda name: F.col("event") == name
    at = F.struct("at", "seq")
    saved = F.when(is_event("save"), at)
    first = F.when(is_event("start"), at)
    return (
        events.groupBy("scan_id", "root_path")
        .agg(
            F.min_by("scan_mode", first).alias("scan_mode"),
            F.max_by("folder_path", saved).alias("current_folder_path"),
            F.max_by("file_path", saved).alias("last_processed_file"),
            F.min(F.when(is_event("start"), F.col("at"))).alias("started_at"),
            F.max("at").alias("updated_at"),
            F.max(is_event("complete").cast("int")).alias("completed"),
            F.max(is_event("clear").cast("int")).alias("_cleared"),
        )
        .where((F.col("_cleared") == 0) & F.col("started_at").isNotNull())
        .drop("_cleared")
    )


def start_scans(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (scan_id, root_path, scan_mode, at) with `accepted`.

    It is 0 where a scan is unfinished, and for all but the first request (by `at`, if there, then
    `scan_id`) for one root.
    """
    order = F.struct(*[name for name in ("at", "scan_id") if name in requests.columns])
    first = requests.groupBy("root_path").agg(F.min(order)["scan_id"].alias("_first"))
    busy = state.where(F.col("completed") == 0).select("root_path").distinct().withColumn("_busy", F.lit(True))
    decided = first.join(busy, "root_path", "left")
    return (
        lookup(requests, decided, ["root_path"], "left", spread="scan_id")
        .withColumn("accepted", F.when(F.col("_busy") | (F.col("scan_id") != F.col("_first")), 0).otherwise(1))
        .drop("_busy", "_first")
    )
