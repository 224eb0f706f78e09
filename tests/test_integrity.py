import pytest

from filetwin import schemas
from filetwin.operators import integrity as check

from .conftest import rows

SALTED = [dict(), dict(force_salt=True, hot_rows=1)]
NOW = 5000


@pytest.fixture
def damaged(make):
    folders = make.folders("/r", ("/r/gone", dict(removed=1)), ("/r/lost", dict(parent_path="/r/nowhere")), "/ok")
    files = make.files(
        *[(f"/r/gone/{i}", dict()) for i in range(5)],
        "/r/missing/a",
        ("/r/b", dict(first_scanned_at=6000)),
        ("/r/c", dict(hash_algorithm="sha256")),
        "/ok/d",
    )
    roots = make.roots(("/r", dict(folder_count=2, file_count=8)), ("/ok", dict(folder_count=1, file_count=9)), "/empty")
    return roots, folders, files


@pytest.mark.parametrize("skew", SALTED)
def test_single_checks(damaged, skew):
    _, folders, files = damaged
    assert rows(check.orphan_files(files, folders, **skew), "path") == [("/r/missing/a",)]
    assert rows(check.orphan_folders(folders, **skew), "folder_path") == [("/r/lost",)]
    assert check.removed_cascade_violations(files, folders, **skew).count() == 5
    assert rows(check.future_timestamps(files, NOW)) == [("/r", 1)]
    assert rows(check.inconsistent_timestamps(files)) == [("/r", 1)]
    assert rows(check.violation_sample(files, folders, **skew), "issue_no", "description")[-1] == (
        4,
        "...and 2 more inconsistencies",
    )


def test_report_names_every_root_and_check(damaged):
    report = check.integrity_report(*damaged, NOW)
    got = {(r.root_path, r.check): (r.status, r.issues) for r in report.collect()}
    assert len(got) == 15
    assert got[("/r", check.FOREIGN_KEYS)] == ("error", 2)
    assert got[("/r", check.TIMESTAMPS)] == ("warning", 2)
    assert got[("/r", check.CASCADE)] == ("error", 4)
    assert got[("/r", check.STATISTICS)] == ("pass", 0)
    assert got[("/r", check.ALGORITHM)] == ("warning", 1)
    assert got[("/ok", check.STATISTICS)] == ("warning", 1)
    assert all(status == "pass" for (root, _), (status, _) in got.items() if root == "/empty")
    assert rows(check.integrity_summary(report).where("root_path = '/r'")) == [("/r", 5, 9, 6, 3)]


def test_issue_texts(damaged):
    text = {r.description for r in check.integrity_issues(*damaged, NOW).collect()}
    assert "1 files reference non-existent folders" in text
    assert "Multiple hash algorithms detected: sha256 (1 files) sha512 (7 files)" in text
    assert "Statistics mismatch - Expected: 1 folders, 9 files; Actual: 1 folders, 1 files" in text


def test_statistics_over_all_rows(damaged):
    found = check.statistics_mismatch(*damaged, live_only=False)
    assert rows(found, "root_path", "actual_folders") == [("/ok", 1), ("/r", 3)]


@pytest.mark.parametrize("skew", SALTED)
def test_repairs_leave_nothing_to_report(damaged, skew):
    roots, folders, files = damaged
    files = check.repair_orphan_files(files, folders, **skew)
    folders = check.repair_orphan_folders(folders, **skew)
    files = check.repair_timestamps(files, NOW)
    files = check.repair_removed_cascade(files, folders, NOW, **skew)
    roots = check.repair_statistics(roots, folders, files)
    left = check.integrity_issues(roots, folders, files, NOW)
    assert rows(left, "check") == [(check.ALGORITHM,)]
    assert rows(files.where("path = '/r/b'"), "first_scanned_at", "last_scanned_at") == [(5000, 5000)]
    assert rows(roots, "root_path", "folder_count", "file_count") == [("/empty", 0, 0), ("/ok", 1, 1), ("/r", 2, 2)]


@pytest.mark.parametrize("skew", SALTED)
def test_constraints(make, spark, skew):
    files = make.files(
        ("/r/a", dict(hash_algorithm="md5", size=-1)),
        ("/r/b", dict(removed=2, first_scanned_at=9999)),
        ("/r/c", dict(root_path="/s")),
        ("/r/d", dict(hash_algorithm=None)),
    )
    roots = make.roots(("/r", dict(traverse_links=3, file_count=-1)))
    scans = spark.createDataFrame([(1, "/r", "half", None, None, 1, 1, 5)], schemas.SCANS)
    found = check.constraint_violations(roots, make.folders("/r"), files, scans, **skew)
    assert rows(found) == [
        ("files", "algorithm_name", 1),
        ("files", "first_not_after_last", 1),
        ("files", "removed_flag", 1),
        ("files", "same_root_as_folder", 1),
        ("files", "size_not_negative", 1),
        ("roots", "file_count_not_negative", 1),
        ("roots", "traverse_links_flag", 1),
        ("scans", "completed_flag", 1),
        ("scans", "scan_mode_name", 1),
    ]


def test_stale_scans(spark):
    scans = spark.createDataFrame(
        [(1, "/r", "all", None, None, 0, 100, 0), (2, "/s", "all", None, None, 0, 90_000, 0), (3, "/t", "all", None, None, 0, 1, 1)],
        schemas.SCANS,
    )
    assert rows(check.stale_scans(scans, 100_000), "scan_id", "age") == [(1, 99_900)]


def test_sample_is_cut_before_the_shuffle(damaged):
    _, folders, files = damaged
    plan = check.violation_sample(files, folders)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("skew", SALTED)
def test_repair_run_counts_what_it_mends(damaged, skew):
    done = check.repair_all(*damaged, NOW, **skew)
    got = {(r.root_path, r.check): r.fixed for r in done.fixed.collect()}
    assert len(got) == 15
    assert got[("/r", check.FOREIGN_KEYS)] == 2
    assert got[("/r", check.TIMESTAMPS)] == 2
    assert got[("/r", check.CASCADE)] == 5
    assert got[("/ok", check.STATISTICS)] == 1
    assert all(n == 0 for (root, name), n in got.items() if root == "/empty" or name == check.ALGORITHM)
    left = check.integrity_report(done.roots, done.folders, done.files, NOW)
    assert {r.check for r in left.where("issues > 0").collect()} == {check.ALGORITHM}
    again = check.repair_all(done.roots, done.folders, done.files, NOW, **skew)
    assert {r.issues_fixed for r in again.fixed.collect()} == {0}


def test_only_the_most_frequent_algorithm_names_are_spelt_out(make):
    specs = [(f"/r/{k}-{n}", dict(hash_algorithm=f"name{k:02d}")) for k in range(30) for n in range(1 + (k < 3))]
    profile = check.root_profile(make.folders("/r"), make.files(*specs), NOW).first()
    assert len(profile.algorithms) == check.ALGORITHM_ENTRIES + 1
    assert sum("name" in a for a in profile.algorithms) == 10 and profile.algorithms[-1] == "...and 20 more"
    assert all(any(f"name0{k}" in a for a in profile.algorithms) for k in range(3))
