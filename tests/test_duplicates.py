import json

import pytest
from pyspark.sql import functions as F

from filetwin.operators import duplicates as dup

from .conftest import rows

SALTED = [dict(), dict(force_salt=True, hot_rows=1)]


@pytest.fixture
def files(make):
    return make.files(
        ("/r/A.txt", dict(hash_value="c", size=7)),
        ("/r/a.txt", dict(hash_value="c", size=7)),
        ("/r/x/1", dict(hash_value="d", size=2000)),
        ("/r/y/2", dict(hash_value="d", size=2000)),
        ("/s/3", dict(hash_value="d", size=2000)),
        ("/s/other-size", dict(hash_value="d", size=2001)),
        ("/s/empty1", dict(hash_value="e", size=0)),
        ("/s/empty2", dict(hash_value="e", size=0)),
        ("/s/gone", dict(hash_value="d", size=2000, removed=1)),
        ("/s/bad", dict(hash_value="d", size=2000, error_status="denied")),
        ("/s/none", dict(hash_value=None, size=2000)),
    )


def test_sets_count_before_and_after_dropping_equal_paths(files):
    found = dup.duplicate_sets(files).select("hash_value", "size", "n", "files").collect()
    assert [tuple(r) for r in found] == [("d", 2000, 3, 3), ("c", 7, 2, 1)]


def test_case_sensitive_sets(files):
    found = dup.duplicate_sets(files, case_insensitive=False)
    assert rows(found, "hash_value", "files") == [("c", 2), ("d", 3)]


def test_filters(files):
    assert rows(dup.duplicate_sets(files, min_count=3), "hash_value") == [("d",)]
    assert rows(dup.duplicate_sets(files, min_size=8), "hash_value") == [("d",)]
    assert ("e",) in rows(dup.duplicate_sets(files, include_empty=True), "hash_value")


@pytest.mark.parametrize("skew", SALTED)
def test_members_keep_first_path_of_a_clash(files, skew):
    assert rows(dup.duplicate_members(files, **skew), "hash_value", "path") == [
        ("c", "/r/A.txt"),
        ("d", "/r/x/1"),
        ("d", "/r/y/2"),
        ("d", "/s/3"),
    ]


@pytest.mark.parametrize("skew", SALTED)
def test_files_with_a_twin(files, skew):
    assert [r[0] for r in rows(dup.files_with_a_twin(files, **skew), "path")] == ["/r/A.txt", "/r/a.txt", "/r/x/1", "/r/y/2", "/s/3"]


def test_files_by_hash(files, make):
    found = dup.files_by_hash(files, make.roots("/r"), "d", 2000)
    assert rows(found, "path", "root_path") == [("/r/x/1", "/r"), ("/r/y/2", "/r"), ("/s/3", "")]


def test_spanning_set_counts_once_per_root_and_blank_root_is_unknown(files, make):
    assert rows(dup.duplicates_by_root(files, make.roots("/r"))) == [("(unknown)", 1, 1, 2000), ("/r", 2, 3, 4007)]
    assert rows(dup.duplicate_totals(files)) == [(2, 4, 6007)]
    assert rows(dup.duplicate_counts(files)) == [(2, 5)]


def test_no_duplicates_gives_zero_totals(make):
    assert rows(dup.duplicate_totals(make.files("/r/a"))) == [(0, 0, 0)]
    assert rows(dup.duplicate_counts(make.files("/r/a"))) == [(0, 0)]
    assert rows(dup.reclaimable_total(make.files("/r/a"))) == [(0, 0, 0)]


def test_reclaimable(files):
    assert rows(dup.reclaimable_bytes(files), "hash_value", "reclaimable") == [("c", 7), ("d", 4000)]


def test_numbers_follow_report_order(spark):
    sets = spark.range(500).select(
        F.sha2(F.col("id").cast("string"), 256).alias("hash_value"),
        F.when(F.col("id") % 3 == 0, 4096).otherwise(F.col("id") % 40 + 1).cast("bigint").alias("size"),
        F.lit(2).alias("files"),
    )
    got = [(r.hash_value, r.set_no) for r in dup.number_sets(sets).orderBy("set_no").collect()]
    wanted = [r.hash_value for r in sets.orderBy(F.desc("size"), "hash_value").collect()]
    assert got == [(h, i) for i, h in enumerate(wanted, start=1)]


def test_report_lines(files):
    found = rows(dup.numbered_sets(files))
    assert found == [
        (1, 3, "2.0 KB", "d", "/r/x/1"),
        (1, 3, "2.0 KB", "d", "/r/y/2"),
        (1, 3, "2.0 KB", "d", "/s/3"),
        (2, 1, "7 B", "c", "/r/A.txt"),
    ]


@pytest.mark.parametrize("skew", SALTED)
def test_json_parts_hold_every_path_once(make, skew):
    files = make.files(*[(f"/r/{i}", dict(hash_value="h")) for i in range(200)])
    parts = dup.duplicates_json(files, part_files=20, **skew).collect()
    assert len(parts) > 5 and {r.parts for r in parts} == {10}
    documents = [json.loads(r.document) for r in parts]
    assert {d["count"] for d in documents} == {200}
    paths = [f["path"] for d in documents for f in d["files"]]
    assert sorted(paths) == sorted(f"/r/{i}" for i in range(200))
    assert max(len(d["files"]) for d in documents) < 60


def test_full_json(files):
    found = {r.hash_value: json.loads(r.document) for r in dup.duplicates_json_full(files, min_count=3).collect()}
    assert found["d"]["file_count"] == 3 and found["d"]["algorithm"] == "sha512"
    assert found["d"]["files"][0] == {
        "path": "/r/x/1",
        "mtime": "1970-01-01T00:01:40Z",
        "first_scanned_at": "1970-01-01T00:16:40Z",
        "last_scanned_at": "1970-01-01T00:33:20Z",
    }


@pytest.mark.parametrize("skew", SALTED)
def test_primary_by_rank_then_age_then_path(make, spark, skew):
    files = make.files(
        ("/r/a/1", dict(first_scanned_at=5)),
        ("/r/b/2", dict(first_scanned_at=9)),
        ("/r/c/3", dict(first_scanned_at=5)),
        ("/r/c/4", dict(hash_value="x")),
    )
    by_age = dup.keep_primary(files, **skew)
    assert rows(by_age, "path", "status") == [("/r/a/1", 7), ("/r/b/2", 9), ("/r/c/3", 9)]
    ranks = spark.createDataFrame([("/r/b", 1)], "folder_path string, rank int")
    assert rows(dup.keep_primary(files, ranks, **skew).where("status = 7"), "path") == [("/r/b/2",)]


@pytest.mark.parametrize("skew", SALTED)
def test_hash_candidates(make, skew):
    listing = make.files(("/r/a", dict(size=1)), ("/r/b", dict(size=1)), ("/r/c", dict(size=2)))
    assert rows(dup.hash_candidates(listing.select("path", "size"), **skew), "path") == [("/r/a",), ("/r/b",)]


def test_one_content_with_a_third_of_all_rows(spark, make):
    files = spark.range(30_000).select(
        F.concat(F.lit("/r/f"), F.col("id")).alias("path"),
        F.lit(5).cast("bigint").alias("size"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("hash_value"),
        F.lit(None).cast("string").alias("error_status"),
        F.lit(0).alias("removed"),
        F.lit("/r").alias("root_path"),
    )
    members = dup.duplicate_members(files, force_salt=True, hot_rows=500)
    assert members.count() == 10_000
    assert rows(dup.duplicate_sets(files), "n", "files") == [(10_000, 10_000)]
