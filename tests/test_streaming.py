import os

from pyspark.sql import functions as F

from filetwin import schemas
from filetwin.operators.mutate import scan_state
from filetwin.sources import listing, tables
from filetwin.streaming import observe, resume

from .conftest import rows


def _write(spark, directory, *observed):
    spark.createDataFrame(list(observed), schemas.OBSERVATIONS).coalesce(1).write.mode("append").parquet(directory)


def _run(spark, source, out, done):
    stream = spark.readStream.schema(schemas.OBSERVATIONS).option("maxFilesPerTrigger", 1).parquet(source)
    observe.observe_stream(stream, out, done).awaitTermination()


def test_late_and_repeated_observations_fold_by_time(spark, tmp_path):
    source, out, done = (str(tmp_path / name) for name in ("in", "out", "done"))
    _write(spark, source, (1, 100, "/r", "/r/a", 1, "x"), (2, 300, "/r", "/r/a", 3, "z"))
    _run(spark, source, out, done)
    _write(spark, source, (3, 50, "/r", "/r/a", 9, "late"), (4, 10, "/r", "/r/b", 5, "b"))
    _write(spark, source, (5, 300, "/r", "/r/a", 4, "tie"))
    _run(spark, source, out, done)
    assert rows(observe.observed_files(spark, out)) == [
        ("/r/a", "/r", 4, "tie", 50, 300),
        ("/r/b", "/r", 5, "b", 10, 10),
    ]


def test_finished_input_is_not_read_again_and_replay_changes_nothing(spark, tmp_path):
    source, out, done = (str(tmp_path / name) for name in ("in", "out", "done"))
    _write(spark, source, (1, 100, "/r", "/r/a", 1, "x"))
    _run(spark, source, out, done)
    batches = spark.read.parquet(out).select("batch").distinct().count()
    _run(spark, source, out, done)
    assert spark.read.parquet(out).select("batch").distinct().count() == batches
    _run(spark, source, out, str(tmp_path / "another"))
    assert rows(observe.observed_files(spark, out), "path", "first_seen") == [("/r/a", 100)]


def test_compaction_keeps_the_fold(spark, tmp_path):
    source, out, done, small = (str(tmp_path / name) for name in ("in", "out", "done", "small"))
    for i in range(3):
        _write(spark, source, (i, 100 - i, "/r", "/r/a", i, str(i)), (10 + i, i, "/r", f"/r/{i}", i, "v"))
    _run(spark, source, out, done)
    before = rows(observe.observed_files(spark, out))
    observe.compact(spark, [out], small)
    assert rows(observe.observed_files(spark, small)) == before
    assert spark.read.parquet(small).count() == 4


def test_interrupted_scan_goes_on(spark, tmp_path):
    top = tmp_path / "top"
    top.mkdir()
    for i in range(6):
        (top / f"f{i}").write_text(str(i))
    listed, out, done = (str(tmp_path / name) for name in ("listing", "digests", "done"))
    found = listing.list_files(spark, str(top))
    first = F.col("path").rlike("[0-2]$")
    resume.write_listing(found.where(first), f"{listed}/part=0", files=1)
    resume.resumable_scan(spark, f"{listed}/part=*", out, done).awaitTermination()
    assert resume.scanned_digests(spark, out).count() == 3
    # Were the finished part read again, its files would now fail.
    for i in range(3):
        (top / f"f{i}").write_text("changed")
    resume.write_listing(found.where(~first), f"{listed}/part=1", files=1)
    resume.resumable_scan(spark, f"{listed}/part=*", out, done, algorithm="sha256").awaitTermination()
    digests = rows(resume.scanned_digests(spark, out), "path", "hash_algorithm")
    assert [a for _, a in digests] == ["sha512"] * 3 + ["sha256"] * 3
    restarted = str(tmp_path / "fresh")
    resume.resumable_scan(spark, f"{listed}/part=*", restarted).awaitTermination()
    assert resume.scanned_digests(spark, restarted).count() == 6


def _catalog(spark, source, base, done):
    stream = spark.readStream.schema(schemas.OBSERVATIONS).option("maxFilesPerTrigger", 1).parquet(source)
    observe.observe_catalog(stream, base, done, algorithm="sha256").awaitTermination()


COLUMNS = ["path", "size", "mtime", "hash_value", "hash_algorithm", "first_scanned_at", "last_scanned_at", "removed", "folder_path"]


def test_observations_reach_the_catalog(spark, make, tmp_path):
    source, base, done = (str(tmp_path / name) for name in ("in", "catalog", "done"))
    old = make.files(
        ("/r/x/a", dict(first_scanned_at=50, last_scanned_at=60, removed=1)),
        ("/r/x/b", dict(first_scanned_at=50, last_scanned_at=500, removed=1)),
        ("/q/c", dict(first_scanned_at=1, last_scanned_at=2)),
    )
    tables.write_table(old, base, "files")
    _write(spark, source, (1, 100, "/r", "/r/x/a", 1, "x"), (2, 300, "/r", "/r/x/a", 3, None), (3, 20, "/r", "/r/x/b", 7, "late"))
    _catalog(spark, source, base, done)
    _write(spark, source, (4, 400, "/s", "/s/new", 5, "n"), (5, 40, "/r", "/r/x/a", 9, "older"))
    _catalog(spark, source, base, done)
    wanted = [
        ("/q/c", 10, 100, "h", "sha512", 1, 2, 0, "/q"),
        ("/r/x/a", 3, 300, None, None, 40, 300, 0, "/r/x"),
        ("/r/x/b", 10, 100, "h", "sha512", 20, 500, 1, "/r/x"),
        ("/s/new", 5, 400, "n", "sha256", 400, 400, 0, "/s"),
    ]
    assert rows(tables.read_table(spark, base, "files"), *COLUMNS) == wanted
    assert tables.table_note(spark, base, "files")["batch"] == 1
    # A new checkpoint reads all of it again: nothing changes.
    _catalog(spark, source, base, str(tmp_path / "another"))
    assert rows(tables.read_table(spark, base, "files"), *COLUMNS) == wanted


def test_replayed_batch_is_applied_once(spark, tmp_path, monkeypatch):
    source, base, done = (str(tmp_path / name) for name in ("in", "catalog", "done"))
    _write(spark, source, (1, 100, "/r", "/r/a", 1, "x"))
    _catalog(spark, source, base, done)
    # The batch was written, but its end never reached the checkpoint.
    os.remove(f"{done}/commits/0")
    os.remove(f"{done}/commits/.0.crc")
    calls, plain = [], tables.replace_buckets
    monkeypatch.setattr(tables, "replace_buckets", lambda *a: (calls.append(a), plain(*a)))
    _catalog(spark, source, base, done)
    assert calls == [] and tables.read_table(spark, base, "files").count() == 1
    _write(spark, source, (2, 200, "/r", "/r/b", 1, "x"))
    _catalog(spark, source, base, done)
    assert len(calls) == 1 and tables.read_table(spark, base, "files").count() == 2


def test_observed_rows_take_what_is_told(spark):
    told = spark.createDataFrame(
        [(1, 5, "/r", "/r/a", 1, "x", 3, "sha3-256", None), (2, 6, "/r", "/r/b", None, None, None, None, "denied"), (3, None, "/r", None, 1, "", 0, "", "")],
        "seq long, ts long, root_path string, path string, size long, hash_value string, mtime long, hash_algorithm string, error_status string",
    )
    assert rows(observe.observed_rows(told), "path", "size", "mtime", "hash_algorithm", "error_status") == [
        ("/r/a", 1, 3, "sha3-256", None),
        ("/r/b", 0, 6, None, "denied"),
    ]


def test_logged_scan_goes_on_from_its_log(spark, tmp_path):
    top = tmp_path / "top"
    (top / "sub").mkdir(parents=True)
    for name in ("a", "b", "sub/c", "sub/d"):
        (top / name).write_text(name)
    root, listed, out = str(top), str(tmp_path / "listing"), str(tmp_path / "out")
    found = listing.list_files(spark, root)
    state = lambda: rows(
        scan_state(resume.scan_events(spark, out)), "scan_id", "last_processed_file", "started_at", "updated_at", "completed"
    )
    assert state() == [] and not resume.complete_scan(spark, out, root, 1)
    resume.write_listing(found.where(~F.col("path").contains("sub")), f"{listed}/part=0", files=1)
    resume.logged_scan(spark, f"{listed}/part=*", out, root, 10).awaitTermination()
    assert state() == [(1, f"{root}/b", 10, 10, 0)]
    for name in ("a", "b"):
        os.remove(top / name)  # not read again
    resume.write_listing(found.where(F.col("path").contains("sub")), f"{listed}/part=1", files=1)
    resume.logged_scan(spark, f"{listed}/part=*", out, root, 20).awaitTermination()
    assert state() == [(1, f"{root}/sub/d", 10, 20, 0)]
    assert resume.scanned_digests(spark, out).where("error_status is null").count() == 4
    assert resume.complete_scan(spark, out, root, 30) and not resume.complete_scan(spark, out, root, 31)
    assert state() == [(1, f"{root}/sub/d", 10, 30, 1)]
    # The next scan of the root is a new one; a restart clears it.
    resume.logged_scan(spark, f"{listed}/part=*", out, root, 40).awaitTermination()
    resume.logged_scan(spark, f"{listed}/part=*", out, root, 50, restart=True).awaitTermination()
    assert state() == [(1, f"{root}/sub/d", 10, 30, 1), (3, f"{root}/sub/d", 50, 50, 0)]
    assert resume.scanned_digests(spark, out).where("error_status is not null").count() == 2
