"""Duplicate files: same content hash and same size.

No operator gathers a duplicate set into one row or one task: sets are counted with map-side
partial sums, members stay rows, and the JSON documents are cut into parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key
from ..functions.text import STATUS, human_size, iso_time, short_path, thousands
from ..session import materialize
from .folders import folder_labels, rule_ranks
from .ordered import numbered
from .skew import key_counts, lookup

CONTENT = ["hash_value", "size"]
UNKNOWN_ROOT = "(unknown)"


def live_files(files: DataFrame) -> DataFrame:
    """Hashed files that are neither removed nor in error, empty ones included."""
    return files.where(
        F.col("hash_value").isNotNull() & (F.col("removed") == 0) & F.col("error_status").isNull()
    )


def eligible_files(files: DataFrame, min_size: int = 0, include_empty: bool = False) -> DataFrame:
    """The files that may be duplicates of each other."""
    floor = min_size if include_empty else max(min_size, 1)
    return live_files(files).where(F.col("size") >= floor)


def content_counts(files: DataFrame, min_size: int = 0, include_empty: bool = False) -> DataFrame:
    """Eligible files per content: hash_value, size, n."""
    return key_counts(eligible_files(files, min_size, include_empty), CONTENT)


def _same_path_key(case_insensitive: bool) -> Column:
    return path_key("path") if case_insensitive else F.col("path")


def duplicate_groups(
    files: DataFrame, min_count: int = 2, min_size: int = 0, include_empty: bool = False
) -> DataFrame:
    """Contents held by at least `min_count` files: hash_value, size, n."""
    return content_counts(files, min_size, include_empty).where(F.col("n") >= min_count)


def unordered_sets(
    files: DataFrame,
    min_count: int = 2,
    min_size: int = 0,
    include_empty: bool = False,
    case_insensitive: bool = True,
    with_algorithm: bool = False,
) -> DataFrame:
    """One row per set: `n` rows counted, `files` after dropping equal paths.

    Two aggregations and no join: first by (content, path key), then by content.
    """
    eligible = eligible_files(files, min_size, include_empty)
    first_name = [F.min("hash_algorithm").alias("hash_algorithm")] if with_algorithm else []
    if case_insensitive:
        paths = eligible.groupBy(*CONTENT, path_key("path").alias("_key")).agg(
            F.count(F.lit(1)).alias("c"), *first_name
        )
        sets = paths.groupBy(*CONTENT).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("files"), *first_name)
    else:
        counted = eligible.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("n"), *first_name)
        sets = counted.withColumn("files", F.col("n"))
    return sets.where(F.col("n") >= min_count)


def duplicate_sets(files: DataFrame, min_count: int = 2, min_size: int = 0, **options) -> DataFrame:
    """`unordered_sets` in report order: largest size first, then hash."""
    return unordered_sets(files, min_count, min_size, **options).orderBy(F.desc("size"), "hash_value")


def _distinct_paths(members: DataFrame, keep: list[str], case_insensitive: bool, by: list[str]) -> DataFrame:
    """First file in path order of each (content, path key)."""
    if not case_insensitive:
        return members.select(*by, "path", *keep)
    first = F.min(F.struct("path", *keep)).alias("_first")
    return (
        members.groupBy(*by, "_salt", "_key")
        .agg(first)
        .select(*by, "_first.path", *[f"_first.{name}" for name in keep])
    )


def with_root_paths(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`root_path` blanked where no root row has it."""
    known = roots.select("root_path", F.lit(True).alias("_known"))
    joined = lookup(members, known, ["root_path"], "left", spread="path")
    return joined.withColumn(
        "root_path", F.when(F.col("_known"), F.col("root_path")).otherwise("")
    ).drop("_known")


def duplicate_members(
    files: DataFrame,
    min_count: int = 2,
    min_size: int = 0,
    include_empty: bool = False,
    case_insensitive: bool = True,
    keep: list[str] | None = None,
    sets: DataFrame | None = None,
    **skew,
) -> DataFrame:
    """One row per (set, path): hash_value, size, n, path and the columns in `keep`.

    The sets are joined back to the files with hot contents salted by path key; grouping by the
    same salt then drops equal paths without another shuffle. `sets` may hand over the sets with
    further columns for the members to carry.
    """
    keep = ["root_path"] if keep is None else keep
    if sets is None:
        counts = content_counts(files, min_size, include_empty)
        sets = counts.where(F.col("n") >= min_count)
    else:
        counts = sets
    carried = [name for name in sets.columns if name not in CONTENT]
    eligible = eligible_files(files, min_size, include_empty).select(
        *CONTENT, "path", *keep, _same_path_key(case_insensitive).alias("_key")
    )
    members = lookup(eligible, sets, CONTENT, "inner", spread="_key", counts=counts, keep_salt=True, **skew)
    return _distinct_paths(members, keep, case_insensitive, [*CONTENT, *carried])


def files_by_hash(
    files: DataFrame,
    roots: DataFrame,
    hash_value: str | None = None,
    size: int | None = None,
    case_insensitive: bool = True,
) -> DataFrame:
    """Live files of one content, or of every content, with their root path ('' if unregistered)."""
    found = live_files(files)
    if hash_value is not None:
        found = found.where(F.col("hash_value") == hash_value)
    if size is not None:
        found = found.where(F.col("size") == size)
    keyed = found.select(
        *CONTENT, "path", "mtime", "root_path", _same_path_key(case_insensitive).alias("_key"), F.lit(0).alias("_salt")
    )
    return with_root_paths(_distinct_paths(keyed, ["mtime", "root_path"], case_insensitive, CONTENT), roots)


def files_with_a_twin(files: DataFrame, include_empty: bool = False, **skew) -> DataFrame:
    """Eligible files for which another one has the same content."""
    counts = content_counts(files, include_empty=include_empty)
    twins = counts.where(F.col("n") >= 2).drop("n")
    eligible = eligible_files(files, include_empty=include_empty).select("path", *CONTENT, "root_path")
    return lookup(eligible, twins, CONTENT, "left_semi", spread="path", counts=counts, **skew)


def duplicate_counts(files: DataFrame, min_count: int = 2) -> DataFrame:
    """One row: number of sets and of files in them."""
    return duplicate_groups(files, min_count).agg(
        F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("files")
    )


def duplicates_by_root(files: DataFrame, roots: DataFrame, min_count: int = 2, min_size: int = 0) -> DataFrame:
    """Per root: sets that touch it, duplicate files in it and their bytes."""
    members = with_root_paths(duplicate_members(files, min_count, min_size), roots)
    root = F.when(F.col("root_path") == "", UNKNOWN_ROOT).otherwise(F.col("root_path"))
    per_set = members.groupBy(root.alias("root_path"), *CONTENT).agg(F.count(F.lit(1)).alias("c"))
    return (
        per_set.groupBy("root_path")
        .agg(
            F.count(F.lit(1)).alias("duplicate_sets"),
            F.sum("c").alias("duplicate_files"),
            F.sum(F.col("size") * F.col("c")).alias("total_size"),
        )
        .orderBy("root_path")
    )


def duplicates_by_root_text(files: DataFrame, roots: DataFrame, width: int = 50) -> DataFrame:
    """`duplicates_by_root` as the printed summary shows it."""
    return duplicates_by_root(files, roots).select(
        "root_path",
        short_path("root_path", width).alias("shown_path"),
        thousands("duplicate_sets").alias("sets_text"),
        thousands("duplicate_files").alias("files_text"),
        human_size("total_size").alias("size_text"),
    )


def duplicate_totals(files: DataFrame, min_count: int = 2, min_size: int = 0) -> DataFrame:
    """One row: sets, files after dropping equal paths, bytes they take."""
    return unordered_sets(files, min_count, min_size).agg(
        F.count(F.lit(1)).alias("sets"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.col("size") * F.col("files")), F.lit(0)).alias("bytes"),
    )


def reclaimable_bytes(files: DataFrame, min_count: int = 2) -> DataFrame:
    """Per set: the bytes freed by keeping one copy."""
    return duplicate_groups(files, min_count).select(
        *CONTENT, "n", (F.col("size") * (F.col("n") - 1)).alias("reclaimable")
    )


def reclaimable_total(files: DataFrame, min_count: int = 2) -> DataFrame:
    return reclaimable_bytes(files, min_count).agg(
        F.count(F.lit(1)).alias("sets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"),
    )


def number_sets(sets: DataFrame) -> DataFrame:
    """Adds `set_no`, the place of each set by (size desc, hash), counted over ranges of that order.

    So neither the whole report nor all sets of one size ever lie in one task.
    """
    order = [F.desc("size"), F.col("hash_value")]
    return numbered(sets, order, "_place", "numbered-sets").withColumn("set_no", F.col("_place") + 1).drop("_place")


def numbered_sets(files: DataFrame, min_count: int = 2, min_size: int = 0, **skew) -> DataFrame:
    """The detail report, one row per (set, path), sets numbered from 1 in report order."""
    sets = materialize(unordered_sets(files, min_count, min_size), "duplicate-sets")
    numbered = number_sets(sets).select(*CONTENT, "n", "set_no", "files")
    members = duplicate_members(files, min_size=min_size, keep=[], sets=numbered, **skew)
    return members.select(
        "set_no",
        "files",
        human_size("size").alias("size_text"),
        F.substring("hash_value", 1, 16).alias("short_hash"),
        "path",
    ).orderBy("set_no", "path")


def _json_parts(
    files: DataFrame,
    min_count: int,
    min_size: int,
    part_files: int,
    keep: tuple[str, ...] = (),
    carry: tuple[str, ...] = (),
    **skew,
) -> DataFrame:
    """Members with the number of parts of their set and the part they are in.

    A part holds about `part_files` paths: a set is cut by the path's MD5, so parts are even and
    the same in every run.
    """
    parts = F.ceil(F.col("files") / part_files).cast("bigint").alias("parts")
    sets = unordered_sets(files, min_count, min_size, with_algorithm=bool(carry))
    sets = sets.select(*CONTENT, "n", "files", *carry, parts)
    members = duplicate_members(files, min_size=min_size, keep=list(keep), sets=sets, **skew)
    digest = F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return members.withColumn("part", digest % F.col("parts"))


def duplicates_json(
    files: DataFrame, min_count: int = 2, min_size: int = 0, part_files: int = 10_000, **skew
) -> DataFrame:
    """JSON documents of the sets; a set of more than `part_files` paths spans several parts."""
    parts = _json_parts(files, min_count, min_size, part_files, **skew)
    documents = parts.groupBy(*CONTENT, "files", "parts", "part").agg(
        F.sort_array(F.collect_list(F.struct("path", "size"))).alias("_files")
    )
    body = F.struct(
        F.col("hash_value").alias("hash"),
        F.col("size"),
        F.col("files").alias("count"),
        F.col("_files").alias("files"),
    )
    return documents.select(*CONTENT, "part", "parts", F.to_json(body).alias("document"))


def duplicates_json_full(
    files: DataFrame, min_count: int = 2, min_size: int = 0, part_files: int = 10_000, **skew
) -> DataFrame:
    """Like `duplicates_json` with algorithm, file times and counts per set."""
    times = ("mtime", "first_scanned_at", "last_scanned_at")
    parts = _json_parts(files, min_count, min_size, part_files, keep=times, carry=("hash_algorithm",), **skew)
    entry = F.struct("path", *[iso_time(name).alias(name) for name in times])
    documents = parts.groupBy(*CONTENT, "files", "hash_algorithm", "parts", "part").agg(
        F.sort_array(F.collect_list(entry)).alias("_files")
    )
    body = F.struct(
        F.col("hash_value").alias("hash"),
        F.col("hash_algorithm").alias("algorithm"),
        F.col("size").alias("size_bytes"),
        F.col("files").alias("file_count"),
        F.col("_files").alias("files"),
    )
    return documents.select(*CONTENT, "part", "parts", F.to_json(body).alias("document"))


def duplicates_json_summary(files: DataFrame, now: int, min_count: int = 2, min_size: int = 0) -> DataFrame:
    """The totals that accompany `duplicates_json_full`, as one JSON document."""
    body = F.struct(
        F.col("files").alias("total_duplicate_files"),
        F.col("sets").alias("total_duplicate_sets"),
        iso_time(F.lit(now).cast("bigint")).alias("scan_timestamp"),
    )
    return duplicate_totals(files, min_count, min_size).select(F.to_json(body).alias("document"))


def keep_primary(
    files: DataFrame, folder_rank: DataFrame | None = None, default_rank: int = 1_000_000, **skew
) -> DataFrame:
    """In each set one primary copy, the others marked for deletion.

    The primary has the lowest rank of its folder (`folder_rank`: folder_path, rank), then the
    oldest first sight, then the first path. Files are counted first, so that only repeated
    contents go on; the primary is then a minimum per content, which combines before the shuffle,
    not a ranking of a whole set in one task.
    """
    eligible = eligible_files(files).select("path", *CONTENT, "folder_path", "first_scanned_at")
    counts = key_counts(eligible, CONTENT)
    repeated = counts.where(F.col("n") >= 2).drop("n")
    eligible = lookup(eligible, repeated, CONTENT, "left_semi", spread="path", counts=counts, **skew)
    if folder_rank is None:
        ranked = eligible.withColumn("rank", F.lit(default_rank))
    else:
        # A folder listed twice has its lowest rank; its files are not counted twice.
        ranks = folder_rank.groupBy("folder_path").agg(F.min("rank").alias("rank"))
        ranked = lookup(eligible, ranks, ["folder_path"], "left", **skew)
        ranked = ranked.withColumn("rank", F.coalesce("rank", F.lit(default_rank)))
    best = ranked.groupBy(*CONTENT).agg(F.min(F.struct("rank", "first_scanned_at", "path")).alias("_best"))
    primaries = best.select(*CONTENT, F.col("_best.path").alias("primary_path"))
    members = lookup(eligible, primaries, CONTENT, "inner", spread="path", **skew)
    is_primary = F.col("path") == F.col("primary_path")
    return members.select(
        "path",
        *CONTENT,
        "primary_path",
        F.when(is_primary, STATUS["Synced"]).otherwise(STATUS["Marked for Deletion"]).alias("status"),
    )


def keep_primary_by_labels(
    files: DataFrame,
    folders: DataFrame,
    labels: DataFrame,
    rules: DataFrame,
    default_rank: int = 1_000_000,
    **skew,
) -> DataFrame:
    """`keep_primary` with ranks from rules over the labels that folders have or inherit (see `rule_ranks`)."""
    ranks = rule_ranks(folder_labels(folders, labels, **skew), rules, **skew)
    return keep_primary(files, ranks, default_rank, **skew)


def hash_candidates(listing: DataFrame, **skew) -> DataFrame:
    """Files that can have a duplicate at all: their size occurs at least twice."""
    counts = key_counts(listing, ["size"])
    shared = counts.where(F.col("n") >= 2).drop("n")
    return lookup(listing, shared, ["size"], "left_semi", spread="path", counts=counts, **skew)
