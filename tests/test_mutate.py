import random

import pytest
from pyspark.sql import functions as F

from filetwin import schemas
from filetwin.operators import mutate as change
from filetwin.operators.mutate import Catalog

from .conftest import rows

PATHS = [dict(), dict(force_outer=True)]
SALTED = [dict(), dict(force_salt=True, hot_rows=1)]


@pytest.mark.parametrize("options", PATHS)
def test_upsert_files_keeps_first_time_and_revives(make, options):
    old = make.files(("/r/a", dict(removed=1, hash_value="old", first_scanned_at=1)), "/r/b")
    new = make.files(
        ("/r/a", dict(hash_value=None, first_scanned_at=50, last_scanned_at=50, size=11)),
        ("/r/c", dict(first_scanned_at=50, last_scanned_at=50)),
    )
    found = change.upsert_files(old, new, **options)
    assert found.columns == old.columns
    assert rows(found, "path", "size", "hash_value", "first_scanned_at", "last_scanned_at", "removed") == [
        ("/r/a", 11, None, 1, 50, 0),
        ("/r/b", 10, "h", 1000, 2000, 0),
        ("/r/c", 10, "h", 50, 50, 0),
    ]


def test_upsert_files_takes_the_latest_of_repeated_rows(make):
    new = make.files(
        ("/r/a", dict(size=1, last_scanned_at=5)), ("/r/a", dict(size=2, last_scanned_at=9)), ("/r/a", dict(size=3, last_scanned_at=7))
    )
    assert rows(change.upsert_files(make.files("/r/b"), new), "path", "size") == [("/r/a", 2), ("/r/b", 10)]


@pytest.mark.parametrize("options", PATHS)
def test_upsert_folders_keeps_root_and_first_time(make, options):
    old = make.folders(("/r/a", dict(removed=1)))
    new = make.folders(
        ("/r/a", dict(parent_path=None, root_path="/other", error_status="denied", first_scanned_at=9, last_scanned_at=9)),
        "/r/b",
    )
    found = change.upsert_folders(old, new, **options)
    assert rows(found, "folder_path", "parent_path", "root_path", "error_status", "first_scanned_at", "removed") == [
        ("/r/a", None, "/r", "denied", 1000, 0),
        ("/r/b", "/r", "/r", None, 1000, 0),
    ]


@pytest.mark.parametrize("options", PATHS)
def test_upsert_roots_keeps_statistics_and_strict_refuses(make, options):
    old = make.roots(("/r", dict(file_count=5)))
    new = make.roots(("/r", dict(agent_id=9, file_count=77)), ("/s", dict(file_count=77)))
    assert rows(change.upsert_roots(old, new, **options), "root_path", "agent_id", "file_count") == [("/r", 9, 5), ("/s", 1, 0)]
    with pytest.raises(Exception, match="already registered"):
        change.upsert_roots(old, new, strict=True, **options).collect()


def test_upsert_agents_keeps_id(spark):
    agent = lambda *row: spark.createDataFrame([row], schemas.AGENTS)
    found = change.upsert_agents(agent(1, "n", "g", 1, 5, 2), agent(8, "n", "g", 0, 6, 3))
    assert rows(found) == [(1, "n", "g", 0, 6, 3)]
    assert change.upsert_agents(agent(1, "n", "g", 1, 5, 2), agent(8, "n", "other", 0, 6, 3)).count() == 2


def test_set_hashes_and_removed(make, spark):
    files = make.files(("/r/a", dict(hash_value=None)), "/r/b")
    digests = spark.createDataFrame([("/r/a", "new", "sha256")], "path string, hash_value string, hash_algorithm string")
    assert rows(change.set_hashes(files, digests, 7), "path", "hash_value", "hash_algorithm", "last_scanned_at") == [
        ("/r/a", "new", "sha256", 7),
        ("/r/b", "h", "sha512", 2000),
    ]
    failed = make.files(("/r/a", dict(error_status="old")), ("/r/b", dict(error_status=None)))
    repeated = spark.createDataFrame(
        [("/r/a", "x", "sha256", None), ("/r/a", "y", "sha256", None), ("/r/a", None, None, "unreadable"), ("/r/b", None, None, "unreadable")],
        "path string, hash_value string, hash_algorithm string, error_status string",
    )
    assert rows(change.set_hashes(failed, repeated, 7), "path", "hash_value", "error_status", "last_scanned_at") == [
        ("/r/a", "y", None, 7),
        ("/r/b", "h", "unreadable", 7),
    ]
    paths = spark.createDataFrame([("/r/b",), ("/r/b",)], "path string")
    assert rows(change.set_removed(files, paths, 1, 7), "path", "removed", "last_scanned_at") == [("/r/a", 0, 2000), ("/r/b", 1, 7)]


def test_refresh_counts_live_rows_including_errors(make):
    files = make.files(("/r/a", dict(error_status="x")), "/r/b", ("/r/c", dict(removed=1)))
    folders = make.folders("/r", ("/r/d", dict(removed=1)))
    found = change.refresh_roots(make.roots("/r", "/s"), folders, files, 99)
    assert rows(found, "root_path", "folder_count", "file_count", "total_size", "last_scan_date") == [
        ("/r", 1, 2, 20, 99),
        ("/s", 0, 0, 0, 99),
    ]


@pytest.mark.parametrize("skew", SALTED)
def test_delete_root_cascades(make, spark, skew):
    scans = spark.createDataFrame(
        [(1, "/r", "all", None, None, 1, 1, 0), (2, "/s", "all", None, None, 1, 1, 0)], schemas.SCANS
    )
    catalog = Catalog(make.roots("/r", "/s"), make.folders("/r", "/s"), make.files("/r/a", "/s/b"), scans)
    left = change.delete_root(catalog, make.roots("/r"), **skew)
    assert [rows(df, "root_path") for df in left] == [[("/s",)]] * 4


@pytest.mark.parametrize("skew", SALTED)
def test_purge_cascades_below_folder_but_not_to_its_name_sake(make, skew):
    folders = make.folders("/r", ("/r/docs", dict(removed=1)), "/r/docs/in", "/r/docs2")
    files = make.files("/r/docs/a", "/r/docs/in/b", "/r/docs2/c", ("/r/docs2/d", dict(removed=1)))
    done = change.purge_removed(folders, files, **skew)
    assert rows(done.folders, "folder_path") == [("/r",), ("/r/docs2",)]
    assert rows(done.files, "path") == [("/r/docs2/c",)]
    assert rows(done.counts) == [("/r", 1, 1, 2, 1)]


def test_purge_kinds_and_cutoff(make):
    folders = make.folders("/r", ("/r/x", dict(removed=1)))
    files = make.files(("/r/x/a", dict(removed=1)), ("/r/b", dict(removed=1, last_scanned_at=10)), "/r/x/c")
    only_files = change.purge_removed(folders, files, "files")
    assert rows(only_files.files, "path") == [("/r/x/c",)] and only_files.folders.count() == 2
    only_folders = change.purge_removed(folders, files, "folders")
    assert rows(only_folders.files, "path") == [("/r/b",)] and only_folders.folders.count() == 1
    early = change.purge_removed(folders, files, before=11)
    assert rows(early.files, "path") == [("/r/x/a",), ("/r/x/c",)]
    assert change.purge_removed(folders, files, root_path="/other").files.count() == 3
    with pytest.raises(ValueError):
        change.purge_removed(folders, files, "everything")


@pytest.mark.parametrize("seed", range(3))
def test_folders_below_equal_brute_force(spark, make, seed):
    dice = random.Random(seed)
    names = ["a", "a0", "a b", "b", "ä", "-", "a.x"]
    paths = {f"/r{dice.randrange(2)}" + "".join(f"/{dice.choice(names)}" for _ in range(dice.randrange(5))) for _ in range(300)}
    folders = make.folders(*sorted(paths))
    tops = folders.where(F.pmod(F.xxhash64("folder_path", F.lit(seed)), F.lit(9)) == 0)
    chosen = [r.folder_path for r in tops.collect()]
    wanted = [(p, "/" + p.split("/")[1]) for p in sorted(paths) if any(p == t or p.startswith(t + "/") for t in chosen)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = rows(change.folders_below(folders, tops))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert chosen and found == sorted(wanted)


def test_nested_roots_keep_to_themselves(make):
    folders = make.folders(
        ("/r", dict(root_path="/r", removed=1)), ("/r/s", dict(root_path="/r/s")), ("/r/s/x", dict(root_path="/r/s"))
    )
    assert rows(change.folders_below(folders, folders.where("removed = 1")), "folder_path") == [("/r",)]


@pytest.mark.parametrize("kind", ["all", "files", "folders"])
def test_purge_of_a_root_reads_only_that_root(spark, make, tmp_path, kind):
    folders = make.folders("/r", ("/r/x", dict(removed=1)), "/r/x/y", "/s", ("/s/x", dict(removed=1)))
    files = make.files("/r/x/y/a", ("/r/b", dict(removed=1)), "/r/c", "/s/x/a", ("/s/b", dict(removed=1)))
    for name, df in (("folders", folders), ("files", files)):
        df.write.parquet(str(tmp_path / name))
    folders, files = [spark.read.parquet(str(tmp_path / name)) for name in ("folders", "files")]
    purge = change.purge_removed(folders, files, kind, root_path="/r")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for df in (purge.counts, *change.purge_root(folders, files, "/r", kind)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        leaves = [k for k, line in enumerate(plan.splitlines()) if "Relation [" in line and "root_path" in line and "first_scanned" in line]
        lines = plan.splitlines()
        assert leaves and all("(root_path" in lines[k - 1] and "= /r)" in lines[k - 1] for k in leaves), plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    left = {"all": ["/r/c"], "files": ["/r/c", "/r/x/y/a"], "folders": ["/r/b", "/r/c"]}[kind]
    assert rows(purge.files, "path") == sorted([(p,) for p in left] + [("/s/b",), ("/s/x/a",)])
    assert rows(change.purge_root(folders, files, "/r", kind).files, "path") == [(p,) for p in left]
    kept = ["/r", "/r/x", "/r/x/y"] if kind == "files" else ["/r"]
    assert rows(purge.folders, "folder_path") == [(p,) for p in kept + ["/s", "/s/x"]]


def test_scan_log(spark):
    event = lambda scan, root, kind, at, folder=None: (scan, root, "all", kind, folder, folder and folder + "/f", at, at)
    log = spark.createDataFrame(
        [
            event(1, "/r", "start", 1),
            event(1, "/r", "save", 2, "/r/a"),
            event(1, "/r", "save", 3, "/r/b"),
            event(1, "/r", "complete", 4),
            event(2, "/r", "start", 5),
            event(3, "/s", "start", 6),
            event(3, "/s", "clear", 7),
        ],
        "scan_id bigint, root_path string, scan_mode string, event string, folder_path string, file_path string, at bigint, seq bigint",
    )
    state = change.scan_state(log)
    assert rows(state) == [(1, "/r", "all", "/r/b", "/r/b/f", 1, 4, 1), (2, "/r", "all", None, None, 5, 5, 0)]
    requests = spark.createDataFrame([(9, "/r"), (10, "/s")], "scan_id bigint, root_path string")
    assert rows(change.start_scans(state, requests), "root_path", "accepted") == [("/r", 0), ("/s", 1)]
    rivals = spark.createDataFrame([(11, "/s", 8), (10, "/s", 9)], "scan_id bigint, root_path string, at bigint")
    assert rows(change.start_scans(state, rivals), "scan_id", "accepted") == [(10, 0), (11, 1)]
