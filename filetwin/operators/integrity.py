"""Integrity checks over roots, folders and files, their report, and the repairs.

Checks run for all roots at once. Orphans and cascade violations are found folder by folder first
(one row per folder, whatever the number of files in it) and only then joined back to files.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_time
from ..schemas import ALGORITHMS, SCAN_MODES
from ..session import materialize
from .skew import key_counts, lookup

# Names of the checks, severities and texts of the issues.
FOREIGN_KEYS = "foreign_key_integrity"
TIMESTAMPS = "timestamp_validity"
CASCADE = "removed_flag_cascade"
STATISTICS = "statistics_accuracy"
ALGORITHM = "hash_algorithm_consistency"
CHECKS = [FOREIGN_KEYS, TIMESTAMPS, CASCADE, STATISTICS, ALGORITHM]
ERROR, WARNING, PASS = "error", "warning", "pass"
ORPHAN_FILES_TEXT = "%d files reference non-existent folders"
ORPHAN_FOLDERS_TEXT = "%d folders reference non-existent parent folders"
FUTURE_TEXT = "%d files have future timestamps"
INVERTED_TEXT = "%d files have created_at > updated_at"
VIOLATION_TEXT = "Folder %s removed but child file %s not marked removed"
MORE_VIOLATIONS_TEXT = "...and %d more inconsistencies"
STATISTICS_TEXT = "Statistics mismatch - Expected: %d folders, %d files; Actual: %d folders, %d files"
ALGORITHMS_TEXT = "Multiple hash algorithms detected: "
MORE_ALGORITHMS_TEXT = "...and %d more"
ALGORITHM_ENTRY_TEXT = "%s (%d files)"
ALGORITHM_ENTRIES = 10
SAMPLE_ROWS = 3


def _folder_names(folders: DataFrame) -> DataFrame:
    return folders.select("folder_path")


def orphan_files(files: DataFrame, folders: DataFrame, **skew) -> DataFrame:
    """Files whose folder row is missing."""
    counts = key_counts(files, ["folder_path"])
    lost = counts.join(_folder_names(folders), "folder_path", "left_anti").drop("n")
    return lookup(files, lost, ["folder_path"], "left_semi", spread="path", counts=counts, **skew).select(
        "path", "folder_path", "root_path"
    )


def orphan_folders(folders: DataFrame, **skew) -> DataFrame:
    """Folders whose non-null parent is missing."""
    named = folders.where(F.col("parent_path").isNotNull()).select("folder_path", "parent_path", "root_path")
    known = folders.select(F.col("folder_path").alias("parent_path"))
    return lookup(named, known, ["parent_path"], "left_anti", spread="folder_path", measure=False, **skew)


def removed_cascade_violations(files: DataFrame, folders: DataFrame, **skew) -> DataFrame:
    """Live files inside removed folders."""
    live = files.where(F.col("removed") == 0).select("path", "folder_path", "root_path")
    gone = folders.where(F.col("removed") == 1).select("folder_path")
    return lookup(live, gone, ["folder_path"], "left_semi", spread="path", **skew)


def root_statistics(
    roots: DataFrame, folders: DataFrame, files: DataFrame, live_only: bool = True, skip_errors: bool = False
) -> DataFrame:
    """Per root: folder count, file count and bytes, 0 where nothing is found.

    One aggregate over folders and files together; rows in error count unless `skip_errors` takes
    them out of the bytes.
    """
    live = (F.col("removed") == 0) if live_only else F.lit(True)
    bytes_ = F.when(F.col("error_status").isNull(), F.col("size")) if skip_errors else F.col("size")
    zero = F.lit(0).cast("bigint")
    rows = (
        folders.where(live)
        .select("root_path", F.lit(1).alias("d"), F.lit(0).alias("f"), zero.alias("s"))
        .unionByName(files.where(live).select("root_path", F.lit(0).alias("d"), F.lit(1).alias("f"), bytes_.alias("s")))
    )
    counted = rows.groupBy("root_path").agg(
        F.sum("d").alias("folder_count"), F.sum("f").alias("file_count"), F.sum("s").alias("total_size")
    )
    names = ["folder_count", "file_count", "total_size"]
    return (
        roots.select("root_path")
        .join(counted, "root_path", "left")
        .select("root_path", *[F.coalesce(name, zero).alias(name) for name in names])
    )


def statistics_mismatch(roots: DataFrame, folders: DataFrame, files: DataFrame, live_only: bool = True) -> DataFrame:
    """Roots whose stored counts differ from the counted rows."""
    actual = root_statistics(roots, folders, files, live_only).select(
        "root_path", F.col("folder_count").alias("actual_folders"), F.col("file_count").alias("actual_files")
    )
    stored = roots.select(
        "root_path", F.col("folder_count").alias("stored_folders"), F.col("file_count").alias("stored_files")
    )
    return stored.join(actual, "root_path").where(
        (F.col("stored_folders") != F.col("actual_folders")) | (F.col("stored_files") != F.col("actual_files"))
    )


def algorithm_mix(files: DataFrame) -> DataFrame:
    """Files per root and algorithm, with `mixed` = 1 for roots using more than one."""
    per = (
        files.where(F.col("hash_algorithm").isNotNull())
        .groupBy("root_path", "hash_algorithm")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kinds = Window.partitionBy("root_path")
    return per.withColumn("mixed", (F.count(F.lit(1)).over(kinds) > 1).cast("int"))


def _in_future(now: int) -> Column:
    return (F.col("first_scanned_at") > now) | (F.col("last_scanned_at") > now)


def _inverted() -> Column:
    return F.col("first_scanned_at") > F.col("last_scanned_at")


def future_timestamps(files: DataFrame, now: int) -> DataFrame:
    """Per root with any: files with a catalog time later than `now`."""
    return files.where(_in_future(now)).groupBy("root_path").agg(F.count(F.lit(1)).alias("n"))


def inconsistent_timestamps(files: DataFrame) -> DataFrame:
    """Per root with any: files first seen later than last seen."""
    return files.where(_inverted()).groupBy("root_path").agg(F.count(F.lit(1)).alias("n"))


def _first_violations(found: DataFrame) -> DataFrame:
    """The first of the `removed_cascade_violations` of each root by path.

    `row_number() <= 3` is cut down in each map task before the shuffle (window group limit), so a
    root with very many violations costs three rows per task.
    """
    place = F.row_number().over(Window.partitionBy("root_path").orderBy("path"))
    text = F.format_string(VIOLATION_TEXT, F.col("folder_path"), F.col("path"))
    return (
        found.withColumn("issue_no", place)
        .where(F.col("issue_no") <= SAMPLE_ROWS)
        .select("root_path", "issue_no", text.alias("description"))
    )


def _more_violations(n: Column) -> Column:
    return F.format_string(MORE_VIOLATIONS_TEXT, n - SAMPLE_ROWS)


def violation_sample(files: DataFrame, folders: DataFrame, **skew) -> DataFrame:
    """Per root the first cascade violations by path and one row counting the others."""
    found = materialize(removed_cascade_violations(files, folders, **skew), "violations")
    rest = (
        found.groupBy("root_path")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > SAMPLE_ROWS)
        .select(
            "root_path", F.lit(SAMPLE_ROWS + 1).alias("issue_no"), _more_violations(F.col("n")).alias("description")
        )
    )
    return _first_violations(found).unionByName(rest)


def root_profile(folders: DataFrame, files: DataFrame, now: int, live_only: bool = True) -> DataFrame:
    """Per root all counts the checks need, from one pass over the files.

    Files are counted per (root, folder, algorithm) first; only those rows meet the folders.
    """
    per_folder = files.groupBy("root_path", "folder_path", "hash_algorithm").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("removed") == 0).alias("live"),
        F.count_if(_in_future(now)).alias("future"),
        F.count_if(_inverted()).alias("inverted"),
    )
    placed = per_folder.join(
        folders.select("folder_path", F.col("removed").alias("folder_removed")), "folder_path", "left"
    )
    per_algorithm = placed.groupBy("root_path", "hash_algorithm").agg(
        F.sum("n").alias("n"),
        F.sum("live").alias("live"),
        F.sum("future").alias("future"),
        F.sum("inverted").alias("inverted"),
        F.sum(F.when(F.col("folder_removed").isNull(), F.col("n"))).alias("orphans"),
        F.sum(F.when(F.col("folder_removed") == 1, F.col("live"))).alias("violations"),
    )
    # Names are free text, so a damaged catalog has any number of them: only the most frequent are spelt out.
    place = F.row_number().over(Window.partitionBy("root_path").orderBy(F.desc("n"), "hash_algorithm"))
    entries = (
        per_algorithm.where(F.col("hash_algorithm").isNotNull())
        .withColumn("_place", place)
        .where(F.col("_place") <= ALGORITHM_ENTRIES)
        .groupBy("root_path")
        .agg(F.sort_array(F.collect_list(F.format_string(ALGORITHM_ENTRY_TEXT, "hash_algorithm", "n"))).alias("_names"))
    )
    of_files = per_algorithm.groupBy("root_path").agg(
        F.sum("live" if live_only else "n").alias("actual_files"),
        *[F.sum(name).alias(name) for name in ("future", "inverted", "orphans", "violations")],
        F.count("hash_algorithm").alias("_named"),
    )
    others = F.col("_named") - F.size("_names")
    of_files = of_files.join(entries, "root_path", "left").withColumn(
        "algorithms",
        F.when(F.col("_names").isNull(), F.array().cast("array<string>"))
        .when(others > 0, F.concat("_names", F.array(F.format_string(MORE_ALGORITHMS_TEXT, others))))
        .otherwise(F.col("_names")),
    )
    of_files = of_files.drop("_named", "_names")
    counted = (F.col("removed") == 0) if live_only else F.lit(True)
    lost = orphan_folders(folders).groupBy("root_path").agg(F.count(F.lit(1)).alias("orphan_folders"))
    of_folders = (
        folders.groupBy("root_path")
        .agg(F.count_if(counted).alias("actual_folders"))
        .join(lost, "root_path", "left")
    )
    return of_files.join(of_folders, "root_path", "full_outer")


def integrity_issues(
    roots: DataFrame, folders: DataFrame, files: DataFrame, now: int, live_only: bool = True
) -> DataFrame:
    """Every issue of the five checks, one row each, for all roots."""
    stored = roots.select(
        "root_path", F.col("folder_count").alias("stored_folders"), F.col("file_count").alias("stored_files")
    )
    counts = ("actual_files", "actual_folders", "future", "inverted", "orphans", "violations", "orphan_folders")
    zero = F.lit(0).cast("bigint")
    profile = (
        root_profile(folders, files, now, live_only)
        .join(stored, "root_path", "full_outer")
        .withColumns({name: F.coalesce(name, zero) for name in counts})
    )

    def issue(check: str, severity: str, place: int, holds: Column, description: Column, n: Column) -> Column:
        found = F.struct(
            F.lit(check).alias("check"),
            F.lit(severity).alias("severity"),
            F.lit(place).alias("issue_no"),
            description.alias("description"),
            n.cast("bigint").alias("n"),
        )
        return F.when(holds, found)

    def counted(check: str, severity: str, place: int, name: str, text: str) -> Column:
        n = F.col(name)
        return issue(check, severity, place, n > 0, F.format_string(text, n), n)

    wrong = (F.col("stored_folders") != F.col("actual_folders")) | (F.col("stored_files") != F.col("actual_files"))
    mismatch = F.format_string(
        STATISTICS_TEXT,
        *[F.col(c) for c in ("stored_folders", "stored_files", "actual_folders", "actual_files")],
    )
    mixed = F.concat(F.lit(ALGORITHMS_TEXT), F.array_join("algorithms", " "))
    one = F.lit(1)
    more = F.col("violations")
    found = F.array(
        counted(FOREIGN_KEYS, ERROR, 1, "orphans", ORPHAN_FILES_TEXT),
        counted(FOREIGN_KEYS, ERROR, 2, "orphan_folders", ORPHAN_FOLDERS_TEXT),
        counted(TIMESTAMPS, WARNING, 1, "future", FUTURE_TEXT),
        counted(TIMESTAMPS, WARNING, 2, "inverted", INVERTED_TEXT),
        issue(CASCADE, ERROR, SAMPLE_ROWS + 1, more > SAMPLE_ROWS, _more_violations(more), one),
        issue(STATISTICS, WARNING, 1, F.coalesce(wrong, F.lit(False)), mismatch, one),
        issue(ALGORITHM, WARNING, 1, F.coalesce(F.size("algorithms") > 1, F.lit(False)), mixed, one),
    )
    sample = _first_violations(removed_cascade_violations(files, folders)).select(
        "root_path",
        F.lit(CASCADE).alias("check"),
        F.lit(ERROR).alias("severity"),
        "issue_no",
        "description",
        one.cast("bigint").alias("n"),
    )
    return profile.select("root_path", F.inline(F.array_compact(found))).unionByName(sample)


def integrity_report(
    roots: DataFrame, folders: DataFrame, files: DataFrame, now: int, live_only: bool = True
) -> DataFrame:
    """One row per root and check: status, number of issues, errors and warnings.

    A root without issues passes all five checks.
    """
    return report_of(roots, integrity_issues(roots, folders, files, now, live_only))


def report_of(roots: DataFrame, issues: DataFrame) -> DataFrame:
    """`integrity_report` from issues already found."""
    found = issues.groupBy("root_path", "check").agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if(F.col("severity") == ERROR).alias("errors"),
    )
    wanted = roots.select("root_path", F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"))
    zero = F.lit(0).cast("bigint")
    status = F.when(F.col("errors") > 0, ERROR).when(F.col("issues") > 0, WARNING).otherwise(PASS)
    return (
        wanted.join(found, ["root_path", "check"], "left")
        .select("root_path", "check", F.coalesce("issues", zero).alias("issues"), F.coalesce("errors", zero).alias("errors"))
        .select("root_path", "check", status.alias("status"), "issues", "errors", (F.col("issues") - F.col("errors")).alias("warnings"))
    )


def integrity_summary(report: DataFrame) -> DataFrame:
    """Per root: checks run, issues found, errors and warnings."""
    return report.groupBy("root_path").agg(
        F.count(F.lit(1)).alias("checks_run"),
        F.sum("issues").alias("issues_found"),
        F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"),
    )


def integrity_json(
    roots: DataFrame, folders: DataFrame, files: DataFrame, now: int, live_only: bool = True
) -> DataFrame:
    """One JSON document per root: the checks in order with their issues, and totals.

    A root has at most ten issues, so a document stays small.
    """
    issues = materialize(integrity_issues(roots, folders, files, now, live_only), "issues")
    entry = F.struct("issue_no", "description", "severity")
    listed = issues.groupBy("root_path", "check").agg(F.sort_array(F.collect_list(entry)).alias("_issues"))
    details = F.transform(
        F.coalesce("_issues", F.array().cast("array<struct<issue_no:int,description:string,severity:string>>")),
        lambda i: F.struct(i["description"].alias("description"), i["severity"].alias("severity")),
    )
    checks = (
        report_of(roots, issues)
        .join(listed, ["root_path", "check"], "left")
        .select(
            "root_path",
            "issues",
            F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("check")).alias("_place"),
            F.struct(F.col("check").alias("name"), "status", details.alias("issues")).alias("_check"),
        )
    )
    whole = checks.groupBy("root_path").agg(
        F.count(F.lit(1)).alias("checks_run"),
        F.sum("issues").alias("issues_found"),
        F.sort_array(F.collect_list(F.struct("_place", "_check")))["_check"].alias("checks"),
    )
    body = F.struct(
        "root_path", "checks_run", "issues_found", "checks", iso_time(F.lit(now).cast("bigint")).alias("scan_timestamp")
    )
    return whole.select("root_path", F.to_json(body).alias("document"))


def repair_orphan_files(files: DataFrame, folders: DataFrame, **skew) -> DataFrame:
    """`files` without those whose folder is missing."""
    return lookup(files, _folder_names(folders), ["folder_path"], "left_semi", spread="path", measure=False, **skew)


def repair_orphan_folders(folders: DataFrame, **skew) -> DataFrame:
    """`folders` with missing parents set to null."""
    known = folders.select(F.col("folder_path").alias("parent_path"), F.lit(True).alias("_known"))
    joined = lookup(folders, known, ["parent_path"], "left", spread="folder_path", measure=False, **skew)
    return joined.withColumn("parent_path", F.when(F.col("_known"), F.col("parent_path"))).select(*folders.columns)


def repair_timestamps(files: DataFrame, now: int) -> DataFrame:
    """Times clamped to `now`, then the last time raised to the first."""
    limit = F.lit(now).cast("bigint")
    first = F.least("first_scanned_at", limit)
    return files.withColumns(
        {"first_scanned_at": first, "last_scanned_at": F.greatest(F.least("last_scanned_at", limit), first)}
    )


def repair_removed_cascade(files: DataFrame, folders: DataFrame, now: int, **skew) -> DataFrame:
    """Live files in removed folders marked removed and stamped `now`."""
    gone = folders.where(F.col("removed") == 1).select("folder_path", F.lit(True).alias("_gone"))
    joined = lookup(files, gone, ["folder_path"], "left", spread="path", **skew)
    hit = F.coalesce("_gone", F.lit(False)) & (F.col("removed") == 0)
    return joined.withColumns(
        {
            "last_scanned_at": F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("last_scanned_at")),
            "removed": F.when(hit, 1).otherwise(F.col("removed")),
        }
    ).select(*files.columns)


def repair_statistics(roots: DataFrame, folders: DataFrame, files: DataFrame, live_only: bool = True) -> DataFrame:
    """Stored counts and bytes recounted; the scan time stays."""
    stats = root_statistics(roots, folders, files, live_only)
    kept = roots.drop("folder_count", "file_count", "total_size")
    return kept.join(stats, "root_path").select(*roots.columns)


class Repaired(NamedTuple):
    """A catalog after all repairs, and per root and check the number of rows mended."""

    roots: DataFrame
    folders: DataFrame
    files: DataFrame
    fixed: DataFrame


def repair_all(
    roots: DataFrame, folders: DataFrame, files: DataFrame, now: int, live_only: bool = True, **skew
) -> Repaired:
    """All repairs in the order of the checks, each on what the one before has left.

    `fixed` has `root_path`, `check`, `fixed` and the root's `issues_fixed`. Deleted files, unset parents and
    newly marked files are told by comparing counts per root before and after, so no repair is joined twice. A
    file with a future time counts once, and once more if its clamped times are still in the wrong order.
    Mixed algorithms are reported, never repaired.
    """
    kept = materialize(repair_orphan_files(files, folders, **skew), "repair-files")
    new_folders = materialize(repair_orphan_folders(folders, **skew), "repair-folders")
    mended = repair_removed_cascade(repair_timestamps(kept, now), new_folders, now, **skew)
    mended = materialize(mended, "repair-files")
    new_roots = repair_statistics(roots, new_folders, mended, live_only)

    limit = F.lit(now).cast("bigint")
    still_inverted = F.least("first_scanned_at", limit) > F.least("last_scanned_at", limit)
    times = F.when(_in_future(now), 1).otherwise(0) + F.when(still_inverted, 1).otherwise(0)
    live = F.when(F.col("removed") == 0, 1).otherwise(0)
    named = F.when(F.col("parent_path").isNotNull(), 1).otherwise(0)
    tally = lambda rows, check, n: rows.select("root_path", F.lit(check).alias("check"), n.alias("n"))
    parts = [
        tally(files, FOREIGN_KEYS, F.lit(1)),
        tally(kept, FOREIGN_KEYS, F.lit(-1)),
        tally(folders, FOREIGN_KEYS, named),
        tally(new_folders, FOREIGN_KEYS, -named),
        tally(kept, TIMESTAMPS, times),
        tally(kept, CASCADE, live),
        tally(mended, CASCADE, -live),
        tally(statistics_mismatch(roots, new_folders, mended, live_only), STATISTICS, F.lit(1)),
    ]
    counted = reduce(DataFrame.unionByName, parts).groupBy("root_path").agg(
        *[F.sum(F.when(F.col("check") == name, F.col("n")).otherwise(0)).alias(name) for name in CHECKS]
    )
    each = [F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(0)).cast("long").alias("fixed")) for c in CHECKS]
    total = sum((F.coalesce(c, F.lit(0)) for c in CHECKS), F.lit(0)).cast("long")
    fixed = roots.select("root_path").join(counted, "root_path", "left").select(
        "root_path", total.alias("issues_fixed"), F.inline(F.array(*each))
    )
    return Repaired(new_roots, new_folders, mended, fixed)


def constraint_violations(
    roots: DataFrame, folders: DataFrame, files: DataFrame, scans: DataFrame, **skew
) -> DataFrame:
    """Rows per broken value rule, one pass over each table."""
    negative = lambda name: F.col(name) < 0
    not_flag = lambda name: ~F.col(name).isin(0, 1)
    parents = folders.select("folder_path", F.col("root_path").alias("folder_root"))
    placed = lookup(files, parents, ["folder_path"], "left", spread="path", measure=False, **skew)
    rules = [
        (
            "files",
            placed,
            {
                "algorithm_name": ~F.col("hash_algorithm").isin(*ALGORITHMS),
                "size_not_negative": negative("size"),
                "removed_flag": not_flag("removed"),
                "first_not_after_last": _inverted(),
                "same_root_as_folder": F.col("folder_root") != F.col("root_path"),
            },
        ),
        ("folders", folders, {"removed_flag": not_flag("removed"), "first_not_after_last": _inverted()}),
        (
            "roots",
            roots,
            {
                "traverse_links_flag": not_flag("traverse_links"),
                "folder_count_not_negative": negative("folder_count"),
                "file_count_not_negative": negative("file_count"),
                "total_size_not_negative": negative("total_size"),
            },
        ),
        (
            "scans",
            scans,
            {"scan_mode_name": ~F.col("scan_mode").isin(*SCAN_MODES), "completed_flag": not_flag("completed")},
        ),
    ]
    parts = []
    for table, df, checks in rules:
        broken = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in checks.items()])
        parts.append(df.select(F.lit(table).alias("table"), F.explode(F.array_compact(broken)).alias("rule")))
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("n"))


def stale_scans(scans: DataFrame, now: int, max_age: int = 86400) -> DataFrame:
    """Unfinished scans without an update for `max_age` seconds."""
    return scans.where((F.col("completed") == 0) & (F.col("updated_at") < now - max_age)).select(
        "scan_id", "root_path", "scan_mode", "started_at", "updated_at", (F.lit(now) - F.col("updated_at")).alias("age")
    )
