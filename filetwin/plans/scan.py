"""Scans: list a tree, hash its files, merge both into the catalog."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.duplicates import duplicate_counts, hash_candidates
from ..operators.folders import folder_tree
from ..operators.lifecycle import detect_removed, rehash_candidates, restored_files
from ..operators.mutate import Catalog, refresh_roots, upsert_files, upsert_folders, upsert_roots
from ..operators.skew import lookup
from ..schemas import DEFAULT_ALGORITHM, FILES, FOLDERS, ROOTS, SCANS
from ..session import fresh_dir, materialize
from ..sources.fingerprint import fingerprint_files
from ..sources.listing import listed_files, listed_folders, walk_tree


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(*[spark.createDataFrame([], schema) for schema in (ROOTS, FOLDERS, FILES, SCANS)])


def stamped_folders(tree: DataFrame, now: int) -> DataFrame:
    """Folder rows as a scan at `now` registers them."""
    error = F.col("error_status") if "error_status" in tree.columns else F.lit(None).cast("string")
    time = F.lit(now).cast("bigint")
    return tree.select(
        "folder_path",
        "parent_path",
        "root_path",
        error.alias("error_status"),
        time.alias("first_scanned_at"),
        time.alias("last_scanned_at"),
        F.lit(0).alias("removed"),
    )


def stamped_files(listing: DataFrame, digests: DataFrame, now: int) -> DataFrame:
    """File rows from a listing and its digests; files without a digest stay unhashed."""
    time = F.lit(now).cast("bigint")
    return listing.join(digests, "path", "left").select(
        "path",
        "size",
        "mtime",
        "hash_value",
        "hash_algorithm",
        "error_status",
        time.alias("first_scanned_at"),
        time.alias("last_scanned_at"),
        F.lit(0).alias("removed"),
        "folder_path",
        "root_path",
    )


def scan_folders(catalog: Catalog, files: DataFrame, now: int) -> DataFrame:
    """The folders table after registering the tree that holds `files`; nothing is hashed."""
    return upsert_folders(catalog.folders, stamped_folders(folder_tree(files), now))


def in_active_folders(listing: DataFrame, folders: DataFrame, **skew) -> DataFrame:
    """Listed files whose direct parent is a registered folder that is not removed."""
    active = folders.where(F.col("removed") == 0).select("folder_path")
    return lookup(listing, active, ["folder_path"], "left_semi", spread="path", measure=False, **skew)


def scan_files(
    catalog: Catalog, listing: DataFrame, digests: DataFrame, now: int, root_path: str | None = None
) -> DataFrame:
    """The files table after hashing the files in registered folders, of one root or of all."""
    folders = catalog.folders
    if root_path is not None:
        folders = folders.where(F.col("root_path") == root_path)
        listing = listing.where(F.col("root_path") == root_path)
        if folders.isEmpty():
            raise ValueError(f"no folders registered below {root_path}: scan its folders first")
    found = in_active_folders(listing, folders)
    return upsert_files(catalog.files, stamped_files(found, digests, now))


class Scan(NamedTuple):
    catalog: Catalog
    summary: DataFrame


def rescan(
    spark: SparkSession,
    catalog: Catalog,
    root: str,
    now: int,
    algorithm: str = DEFAULT_ALGORITHM,
    **walk,
) -> Scan:
    """A later scan of a tree that reads only what changed.

    Hashed are new files and those without a hash, with an error, hashed by another algorithm, or with another size or time than
    the catalog has; all others keep their hash. Files and folders that are no longer listed are marked removed, removed ones that
    are listed again are live. The summary counts listed, hashed, removed and restored files.
    """
    entries = walk_tree(spark, root, **walk)
    tops = entries.select("root_path").distinct()
    listing = listed_files(entries)
    known = catalog.files.join(F.broadcast(tops), "root_path", "left_semi")
    again = rehash_candidates(known, listing, algorithm).select("path")
    new = listing.select("path").join(known.select("path"), "path", "left_anti")
    to_hash = listing.join(again.unionByName(new), "path", "left_semi")
    digests = materialize(fingerprint_files(to_hash, algorithm), "digests")

    kept = known.select("path", "hash_value", "hash_algorithm", "error_status").join(digests, "path", "left_anti")
    stamped = stamped_files(listing, digests.unionByName(kept), now)
    restored = materialize(restored_files(known, listing), "restored-files")
    files = detect_removed(upsert_files(catalog.files, stamped), listing, now, listed_roots=tops)
    files = materialize(files, "rescanned-files")
    found = listed_folders(entries)
    folders = upsert_folders(catalog.folders, stamped_folders(found, now))
    folders = detect_removed(folders, found, now, key="folder_path", listed_roots=tops)
    roots = upsert_roots(
        catalog.roots,
        tops.join(catalog.roots.select("root_path"), "root_path", "left_anti").select(
            "root_path", F.lit(None).cast("bigint").alias("agent_id"), F.lit(0).alias("traverse_links")
        ),
    )
    refreshed = refresh_roots(roots.join(tops, "root_path", "left_semi"), folders, files, now)
    roots = roots.join(tops, "root_path", "left_anti").unionByName(refreshed)
    lost = known.where(F.col("removed") == 0).join(listing, "path", "left_anti")
    counts = [
        df.agg(F.count(F.lit(1)).alias(name))
        for name, df in (("listed", listing), ("hashed", digests), ("removed", lost), ("restored", restored))
    ]
    both = counts[0]
    for count in counts[1:]:
        both = both.unionByName(count, allowMissingColumns=True)
    summary = both.agg(*[F.max(name).alias(name) for name in both.columns])
    return Scan(Catalog(roots, folders, files, catalog.scans), summary)


def scan_all(
    spark: SparkSession,
    catalog: Catalog,
    root: str,
    now: int,
    algorithm: str = DEFAULT_ALGORITHM,
    hidden: bool = True,
    only_candidates: bool = False,
    agent_id: int | None = None,
) -> Scan:
    """A complete scan of one tree: listing, folders, files, hashes, statistics, summary.

    The listing and the digests are written tables in the shared folder, so no file is read twice.
    With `only_candidates` only files whose size occurs twice are hashed.
    """
    entries = walk_tree(spark, root, hidden=hidden)
    listing = listed_files(entries)
    to_hash = hash_candidates(listing) if only_candidates else listing
    digest_dir = fresh_dir(spark, "digests")
    fingerprint_files(to_hash, algorithm).write.parquet(digest_dir)
    digests = spark.read.parquet(digest_dir)

    new_root = entries.where(F.col("kind") == "folder").select("root_path").distinct()
    registered = upsert_roots(
        catalog.roots,
        new_root.select(
            "root_path", F.lit(agent_id).cast("bigint").alias("agent_id"), F.lit(0).alias("traverse_links")
        ),
    )
    folders = upsert_folders(catalog.folders, stamped_folders(listed_folders(entries), now))
    files = upsert_files(catalog.files, stamped_files(listing, digests, now))
    refreshed = refresh_roots(registered.join(new_root, "root_path", "left_semi"), folders, files, now)
    others = registered.join(new_root, "root_path", "left_anti")
    roots = others.unionByName(refreshed)
    counted = refreshed.select(
        F.col("folder_count").alias("folders"), F.col("file_count").alias("files"), F.col("total_size").alias("bytes")
    )
    found = duplicate_counts(files).select(F.col("sets").alias("duplicate_sets"), F.col("files").alias("duplicate_files"))
    both = counted.unionByName(found, allowMissingColumns=True)
    summary = both.agg(*[F.max(name).alias(name) for name in both.columns])
    return Scan(Catalog(roots, folders, files, catalog.scans), summary)
