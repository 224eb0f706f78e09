"""What changed between the catalog and a newer listing: removed, restored, moved, to hash again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_ALGORITHM
from ..session import materialize
from .duplicates import CONTENT
from .mutate import folders_below
from .ordered import ranged
from .skew import key_counts, lookup


def detect_removed(
    catalog: DataFrame, listing: DataFrame, now: int, key: str = "path", listed_roots: DataFrame | None = None, **skew
) -> DataFrame:
    """Live rows of the listed roots that the listing lacks get `removed` = 1; all rows are kept.

    `listed_roots` names the roots the listing covers, for listings that may be empty.
    """
    roots = (listing if listed_roots is None else listed_roots).select("root_path").distinct()
    seen = listing.select(key).distinct().withColumn("_seen", F.lit(True))
    marked = catalog.join(seen, key, "left")
    marked = lookup(
        marked,
        roots.withColumn("_covered", F.lit(True)),
        ["root_path"],
        "left",
        spread=key,
        counts=key_counts(catalog, ["root_path"]),
        **skew,
    )
    lost = F.col("_seen").isNull() & F.col("_covered").isNotNull() & (F.col("removed") == 0)
    return marked.withColumns(
        {
            "last_scanned_at": F.when(lost, F.lit(now).cast("bigint")).otherwise(F.col("last_scanned_at")),
            "removed": F.when(lost, 1).otherwise(F.col("removed")),
        }
    ).select(*catalog.columns)


def cascade_removed(
    folders: DataFrame, files: DataFrame, now: int, root_path: str | None = None, **skew
) -> tuple[DataFrame, DataFrame]:
    """Everything below a removed folder marked removed: (folders, files).

    With `root_path` only the rows of that root, which are also the only ones read.
    """
    if root_path is not None:
        own = F.col("root_path") == root_path
        folders, files = folders.where(own), files.where(own)
    below = materialize(folders_below(folders, folders.where(F.col("removed") == 1)), "removed-folders")
    gone = below.select("folder_path", F.lit(True).alias("_gone"))

    def applied(df: DataFrame, joined: DataFrame) -> DataFrame:
        hit = F.coalesce("_gone", F.lit(False)) & (F.col("removed") == 0)
        return joined.withColumns(
            {
                "last_scanned_at": F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("last_scanned_at")),
                "removed": F.when(hit, 1).otherwise(F.col("removed")),
            }
        ).select(*df.columns)

    return (
        applied(folders, folders.join(gone, "folder_path", "left")),
        applied(files, lookup(files, gone, ["folder_path"], "left", spread="path", **skew)),
    )


def restored_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Removed files that are listed again; `upsert_files` with the listing clears their flag."""
    gone = catalog.where(F.col("removed") == 1).select("path", "root_path", "first_scanned_at")
    again = listing.select("path", F.col("size").alias("listed_size"), F.col("mtime").alias("listed_mtime"))
    return gone.join(again, "path")


def rehash_candidates(catalog: DataFrame, listing: DataFrame, algorithm: str = DEFAULT_ALGORITHM) -> DataFrame:
    """Files that need a hash, with the first reason that holds."""
    listed = listing.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = catalog.join(listed, "path", "left")
    changed = F.col("_size").isNotNull() & ~(
        F.col("_size").eqNullSafe(F.col("size")) & F.col("_mtime").eqNullSafe(F.col("mtime"))
    )
    reason = (
        F.when(F.col("error_status").isNotNull(), "error")
        .when(F.col("hash_value").isNull(), "unhashed")
        .when(~F.col("hash_algorithm").eqNullSafe(F.lit(algorithm)), "algorithm")
        .when(changed, "changed")
    )
    return (
        joined.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("path", "root_path", F.col("hash_algorithm").alias("old_algorithm"), F.lit(algorithm).alias("new_algorithm"), "reason")
    )


def rehash_summary(candidates: DataFrame) -> DataFrame:
    """Files to hash again per old and new algorithm."""
    return candidates.groupBy("old_algorithm", "new_algorithm").agg(F.count(F.lit(1)).alias("n"))


def moved_files(catalog: DataFrame, include_empty: bool = False, **skew) -> DataFrame:
    """Removed files with the live file of the same content that was first seen next.

    One row per removed file with its best match (earliest later first sight, then path) and the
    number of later live copies, not all pairs: copies are first reduced to the distinct times of
    each content. The time lines are cut into ranges of (content, time); what a range needs of the later ones is one row
    for the content that goes on there, so a content with any number of times is spread over tasks.
    """
    floor = 0 if include_empty else 1
    hashed = catalog.where(F.col("hash_value").isNotNull() & F.col("error_status").isNull() & (F.col("size") >= floor))
    live = F.col("removed") == 0
    times = hashed.groupBy(*CONTENT, "first_scanned_at").agg(
        F.min(F.when(live, F.col("path"))).alias("_path"),
        F.count_if(live).alias("_live"),
        F.count_if(~live).alias("_gone"),
    )
    is_live = F.col("_live") > 0
    target = F.when(is_live, F.struct(F.col("first_scanned_at").alias("at"), F.col("_path").alias("to_path")))
    lines = ranged(times.withColumn("_target", target), [*CONTENT, "first_scanned_at"], "time-lines")

    own = Window.partitionBy("_part", *CONTENT).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    within = lines.withColumns(
        {"_own_next": F.last("_target", ignorenulls=True).over(own), "_own_later": F.sum("_live").over(own)}
    )
    later = Window.partitionBy(*CONTENT).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("_part", *CONTENT).agg(F.min("_target").alias("_first"), F.sum("_live").alias("_n"))
    carried = parts.select(
        "_part",
        *CONTENT,
        F.last("_first", ignorenulls=True).over(later).alias("_next"),
        F.sum("_n").over(later).alias("_later"),
    ).where(F.col("_later").isNotNull())
    # Only the last content of a range can go on in a later one: at most a row per range.
    matches = (
        within.join(F.broadcast(carried), ["_part", *CONTENT], "left")
        .withColumn("_next", F.coalesce("_own_next", "_next"))
        .where((F.col("_gone") > 0) & F.col("_next").isNotNull())
        .select(
            *CONTENT,
            "first_scanned_at",
            F.col("_next.to_path").alias("to_path"),
            F.col("_next.at").alias("moved_at"),
            (F.coalesce("_own_later", F.lit(0)) + F.coalesce("_later", F.lit(0))).alias("later_copies"),
        )
    )
    gone = hashed.where(~live).select(F.col("path").alias("from_path"), *CONTENT, "first_scanned_at")
    return lookup(gone, matches, [*CONTENT, "first_scanned_at"], "inner", spread="from_path", **skew).drop(
        "first_scanned_at"
    )
