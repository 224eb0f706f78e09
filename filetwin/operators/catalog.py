"""Look-ups and listings of roots, folders, scans and agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import human_size, iso_time, scan_time_text, short_path, status_label, thousands
from .skew import lookup


def root_by_path(roots: DataFrame, path: str) -> DataFrame:
    return roots.where(F.col("root_path") == path)


def folder_by_path(folders: DataFrame, path: str) -> DataFrame:
    return folders.where(F.col("folder_path") == path)


def active_folders(folders: DataFrame, root_path: str | None = None) -> DataFrame:
    """Not-removed folders of one root, or of all, in path order."""
    live = folders.where(F.col("removed") == 0)
    if root_path is not None:
        live = live.where(F.col("root_path") == root_path)
    return live.orderBy("folder_path")


def resolve_parent(folders: DataFrame, registered: DataFrame, **skew) -> DataFrame:
    """`registered_parent`: the parent path where a folder row has it, else null."""
    known = registered.select(F.col("folder_path").alias("parent_path"), F.col("folder_path").alias("registered_parent"))
    return lookup(folders, known, ["parent_path"], "left", spread="folder_path", measure=False, **skew)


def removed_candidates(
    folders: DataFrame, files: DataFrame, root_path: str | None = None, before: int | None = None
) -> DataFrame:
    """Removed files and folders per root, with `before` only those last seen earlier."""

    def removed(df: DataFrame, kind: str) -> DataFrame:
        gone = df.where(F.col("removed") == 1)
        if root_path is not None:
            gone = gone.where(F.col("root_path") == root_path)
        if before is not None:
            gone = gone.where(F.col("last_scanned_at") < before)
        return gone.groupBy("root_path").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))

    return removed(files, "files").unionByName(removed(folders, "folders"))


def active_scan(scans: DataFrame) -> DataFrame:
    """Per root its unfinished scan, the latest started one.

    A maximum per root combines before the shuffle.
    """
    columns = [name for name in scans.columns if name not in ("root_path", "started_at", "scan_id")]
    latest = F.max(F.struct("started_at", "scan_id", *columns)).alias("_s")
    return (
        scans.where(F.col("completed") == 0)
        .groupBy("root_path")
        .agg(latest)
        .select("root_path", "_s.*")
        .select(*scans.columns)
    )


def roots_listing(roots: DataFrame, width: int = 40) -> DataFrame:
    """All roots by path as the list command prints them."""
    return roots.select(
        "root_path",
        short_path("root_path", width).alias("shown_path"),
        thousands("folder_count").alias("folders_text"),
        thousands("file_count").alias("files_text"),
        human_size("total_size").alias("size_text"),
        scan_time_text("last_scan_date").alias("last_scan_text"),
    ).orderBy("root_path")


def roots_json(roots: DataFrame) -> DataFrame:
    """One JSON document per root; an absent scan time is null in it."""
    body = F.struct(
        F.col("root_path").alias("path"),
        "folder_count",
        "file_count",
        F.col("total_size").alias("total_size_bytes"),
        iso_time("last_scan_date").alias("last_scan_date"),
    )
    return roots.select("root_path", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def roots_total(roots: DataFrame) -> DataFrame:
    return roots.agg(F.count(F.lit(1)).alias("total_roots"))


def agents_listing(agents: DataFrame) -> DataFrame:
    """All agents, newest id first, with their status label."""
    return agents.withColumn("status_label", status_label("status")).orderBy(F.desc("id"))
