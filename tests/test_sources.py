import hashlib
import os

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from filetwin.operators.duplicates import duplicate_sets
from filetwin.plans import scan
from filetwin.session import drop_intermediate, materialize, path_exists, shared_dir
from filetwin.sources import fingerprint, listing, tables

from .conftest import rows


@pytest.fixture
def tree(tmp_path):
    """The scenario tree: copies, empty and hidden files, odd names, a link, an empty folder."""
    top = tmp_path / "top"
    (top / "dup" / "deep").mkdir(parents=True)
    (top / "empty folder").mkdir()
    (top / "dup" / "file1.txt").write_text("Hello World")
    (top / "dup" / "deep" / "file1_copy.txt").write_text("Hello World")
    (top / "dup" / "file2.bin").write_bytes(b"\x01" * (1 << 20))
    (top / "dup" / "file2_copy.bin").write_bytes(b"\x01" * (1 << 20))
    (top / "empty.txt").write_text("")
    (top / "empty2.txt").write_text("")
    (top / ".hidden").write_text("h")
    (top / ("n" * 200 + " ü%20'\"#.txt")).write_text("odd")
    os.symlink(top / "dup", top / "link")
    return str(top)


def test_walk_lists_everything_once(spark, tree):
    entries = listing.walk_tree(spark, tree)
    files = listing.listed_files(entries)
    wanted = sorted(os.path.join(d, f) for d, _, names in os.walk(tree) for f in names + (["link"] if d == tree else []))
    assert [r[0] for r in rows(files, "path")] == wanted
    sizes = {os.path.basename(p): s for p, s in rows(files, "path", "size")}
    assert sizes["file2.bin"] == 1 << 20 and sizes["empty.txt"] == 0
    folders = listing.listed_folders(entries)
    assert rows(folders, "folder_path", "parent_path") == [
        (tree, None),
        (f"{tree}/dup", tree),
        (f"{tree}/dup/deep", f"{tree}/dup"),
        (f"{tree}/empty folder", tree),
    ]
    mtime = files.where(F.col("path").endswith("file1.txt")).first().mtime
    assert mtime == int(os.stat(f"{tree}/dup/file1.txt").st_mtime)


def test_walk_can_skip_hidden_names(spark, tree):
    names = [r[0] for r in rows(listing.listed_files(listing.walk_tree(spark, tree, hidden=False)), "path")]
    assert not any(os.path.basename(n).startswith(".") for n in names)


def test_unreadable_folder_keeps_its_row(spark, tmp_path):
    missing = str(tmp_path / "nowhere")
    entries = listing.walk_tree(spark, missing).collect()
    assert [(r.kind, r.path) for r in entries] == [("folder", missing)]
    assert "No such file" in entries[0].error_status


def test_linked_root_is_skipped_unless_asked_for(spark, tree):
    link = f"{tree}/link"
    assert listing.walk_tree(spark, link).count() == 0
    assert listing.walk_tree(spark, link, traverse_links=True).count() > 0


def test_files_are_listed_completely(spark, tree):
    names = {os.path.basename(p) for (p,) in rows(listing.list_files(spark, tree), "path")}
    assert {"file1.txt", "file1_copy.txt", "file2.bin", "file2_copy.bin", "empty.txt", ".hidden", "link"} <= names
    globbed = rows(listing.list_files(spark, tree, glob="file?_c*.txt"), "path")
    assert globbed == [(f"{tree}/dup/deep/file1_copy.txt",)]


def test_a_large_folder_is_read_by_no_more_parts_than_tasks(tmp_path):
    for k in range(200):
        (tmp_path / f"f{k}").touch()
    found = list(listing._entries(listing.store_of(""), str(tmp_path), None, 0, 1, True, 2, 5))
    assert {row[0] for row in found} == {"next"} and len(found) == 5


@pytest.mark.parametrize("split", [1, 3, 7])
def test_very_large_folders_are_split(spark, tree, split):
    whole = rows(listing.walk_tree(spark, tree))
    assert rows(listing.walk_tree(spark, tree, split=split)) == whole


def _arrow(path):
    from pyarrow import fs

    from filetwin.sources.stores import ArrowStore

    return ArrowStore(fs.LocalFileSystem(), "store://box")


def test_any_store_is_listed_and_read_through_its_handle(spark, tree):
    os.remove(f"{tree}/link")  # this handle follows links
    wanted = rows(listing.list_files(spark, tree), "path", "size", "mtime")
    root = f"store://box{tree}"
    found = listing.list_files(spark, root, handle=_arrow, split=3)
    assert rows(found, "path", "size", "mtime") == [(f"store://box{p}", *rest) for p, *rest in wanted]
    assert rows(found.select("root_path").distinct()) == [(root,)]
    digests = {p: h for p, h in rows(fingerprint.fingerprint_tree(spark, root, "sha256", handle=_arrow), "path", "hash_value")}
    assert digests[f"{root}/dup/file1.txt"] == hashlib.sha256(b"Hello World").hexdigest() and len(digests) == len(wanted)


def test_uris_name_their_store(tmp_path):
    from filetwin.sources.stores import ArrowStore, LocalStore, plain_path, store_of

    (tmp_path / "f").write_text("x")
    assert isinstance(store_of(str(tmp_path)), LocalStore) and plain_path(f"file://{tmp_path}/") == str(tmp_path)
    store = store_of(f"file://{tmp_path}")
    assert isinstance(store, ArrowStore)
    assert [e.path for e in store.entries(f"file://{tmp_path}")] == [f"file://{tmp_path}/f"]
    store.write(f"file://{tmp_path}/a/b", b"y")
    assert store.open(f"file://{tmp_path}/a/b").read() == b"y"


def test_hashing_is_dealt_by_bytes(spark, tmp_path):
    """One long file, many short ones, one that is gone: tasks have about as many bytes each."""
    sizes = {f"s{k:03d}": 1000 for k in range(200)} | {"long": 3_000_000, "none": 0}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(b"x" * size)
    listed = spark.createDataFrame(
        [(str(tmp_path / n), size) for n, size in sizes.items()] + [(str(tmp_path / "gone"), 500)], "path string, size long"
    )
    dealt = fingerprint.dealt_by_bytes(listed, 1_000_000).withColumn("task", F.spark_partition_id())
    tasks = {}
    for path, task in rows(dealt, "path", "task"):
        tasks.setdefault(task, []).append(sizes.get(os.path.basename(path), 500) + fingerprint.FILE_COST)
    # An even share, one file more, and the long one in a task nearly its own.
    assert len(tasks) > 12 and max(sum(t) - max(t) for t in tasks.values()) <= 1_000_000
    found = {os.path.basename(r.path): r for r in fingerprint.fingerprint_files(listed, "sha256", 1_000_000).collect()}
    assert len(found) == 203 and found["long"].hash_value == hashlib.sha256(b"x" * 3_000_000).hexdigest()
    assert found["gone"].hash_value is None and "No such file" in found["gone"].error_status
    assert fingerprint.fingerprint_files(listed.limit(0)).collect() == []


def test_tree_digests_record_errors(spark, tree, monkeypatch):
    os.remove(f"{tree}/dup/file1.txt")
    os.symlink(f"{tree}/nowhere", f"{tree}/dup/file1.txt")
    found = {r.path: r for r in fingerprint.fingerprint_tree(spark, f"{tree}/dup").collect()}
    assert found[f"{tree}/dup/file1.txt"].hash_value is None and "No such file" in found[f"{tree}/dup/file1.txt"].error_status
    assert found[f"{tree}/dup/file2.bin"].hash_value is not None


@pytest.mark.parametrize("algorithm", ["sha256", "sha512", "sha3-256"])
def test_digests_of_columns_and_files_agree_with_hashlib(spark, tree, algorithm):
    name = algorithm.replace("-", "_")
    wanted = hashlib.new(name, b"Hello World").hexdigest()
    text = spark.range(1).select(fingerprint.digest(F.lit("Hello World"), algorithm).alias("h"))
    assert rows(text) == [(wanted,)]
    listed = listing.list_files(spark, f"{tree}/dup")
    by_path = {p: h for p, h in rows(fingerprint.fingerprint_files(listed, algorithm), "path", "hash_value")}
    assert by_path[f"{tree}/dup/file1.txt"] == by_path[f"{tree}/dup/deep/file1_copy.txt"] == wanted
    assert by_path[f"{tree}/dup/file2.bin"] == hashlib.new(name, b"\x01" * (1 << 20)).hexdigest()
    by_spark = dict(rows(fingerprint.fingerprint_tree(spark, f"{tree}/dup", algorithm), "path", "hash_value"))
    assert by_spark == by_path


def test_known_digest_prefix(spark):
    found = spark.range(1).select(fingerprint.digest(F.lit("Hello World")).alias("h")).first().h
    assert found.startswith("2c74fd17edafd80e")


def test_unknown_algorithm_is_an_error():
    with pytest.raises(ValueError, match="md5"):
        fingerprint.check_algorithm("md5")


def test_unreadable_file_records_the_error(spark, tree):
    paths = spark.createDataFrame([(f"{tree}/empty.txt",), (f"{tree}/absent",)], "path string")
    found = {os.path.basename(r.path): r for r in fingerprint.fingerprint_files(paths).collect()}
    assert found["absent"].hash_value is None and "No such file" in found["absent"].error_status
    assert found["absent"].hash_algorithm is None
    assert found["empty.txt"].hash_value == hashlib.sha512(b"").hexdigest()


def test_tables_have_versions(spark, make, tmp_path):
    base = str(tmp_path / "catalog")
    assert tables.read_table(spark, base, "files").count() == 0
    assert tables.write_table(make.files("/r/a", "/r/b"), base, "files") == 1
    smaller = tables.read_table(spark, base, "files").where("path = '/r/a'")
    assert tables.write_table(smaller, base, "files") == 2
    assert rows(tables.read_table(spark, base, "files"), "path") == [("/r/a",)]
    assert tables.read_table(spark, base, "files", version=1).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, base, "files", version=7)


def test_unfinished_version_is_not_read(spark, make, tmp_path):
    base = str(tmp_path / "catalog")
    tables.write_table(make.files("/r/a"), base, "files")
    os.makedirs(f"{base}/files/v000002")
    assert tables.versions(spark, base, "files") == [1]


def _stored(base, name):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(f"{base}/{name}")
        for f in names
        if f.endswith(".parquet")
    }


def test_change_of_one_root_leaves_other_buckets_untouched(spark, make, tmp_path):
    base = str(tmp_path / "catalog")
    files = make.files(*[f"/r{k}/{f}" for k in range(30) for f in "ab"])
    tables.write_table(files, base, "files")
    before = _stored(base, "files")
    (bucket,) = tables.buckets_of(files.where("root_path = '/r7'"), "files")
    same = [r[0] for r in rows(files.where(tables.bucket_of("files") == bucket).select("root_path").distinct())]
    tables.replace_roots(make.files("/r7/new"), base, "files", ["/r7"])
    after = _stored(base, "files")
    others = {p for p in before if f"/bucket={bucket}/" not in p}
    assert len(others) > 5 and all(after[p] == before[p] for p in others)
    assert {p for p in after if p not in before} == {p for p in after if f"/bucket={bucket}/" in p}
    wanted = {f"/r{k}/{f}" for k in range(30) for f in "ab"} - {"/r7/a", "/r7/b"} | {"/r7/new"}
    assert {r[0] for r in rows(tables.read_table(spark, base, "files"), "path")} == wanted
    assert rows(tables.read_table(spark, base, "files", roots=["/r7"]), "path") == [("/r7/new",)]
    assert tables.versions(spark, base, "files") == [1]

    for gone in same:
        tables.replace_roots(make.files().limit(0) if gone == "/r7" else make.files(f"{gone}/x").limit(0), base, "files", [gone])
    left = tables.read_table(spark, base, "files")
    assert left.where(F.col("root_path").isin(same)).count() == 0 and left.count() == 60 - 2 * len(same)
    assert not any(f"/bucket={bucket}/" in p for p in _stored(base, "files"))


def test_reading_a_root_skips_other_buckets(spark, make, tmp_path):
    base = str(tmp_path / "catalog")
    tables.write_table(make.files(*[f"/r{k}/a" for k in range(30)]), base, "files")
    found = tables.read_table(spark, base, "files", roots=["/r3", "/r4"])
    assert rows(found, "path") == [("/r3/a",), ("/r4/a",)]
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().toString()
    assert tables.read_table(spark, base, "files", roots=[]).count() == 0


def test_interrupted_change_is_finished(spark, make, tmp_path, monkeypatch):
    base = str(tmp_path / "catalog")
    tables.write_table(make.files("/r/a", "/s/a"), base, "files")
    finish = tables._finish
    monkeypatch.setattr(tables, "_finish", lambda *a: None)
    tables.replace_roots(make.files("/r/b"), base, "files", ["/r"])
    assert rows(tables.read_table(spark, base, "files"), "path") == [("/r/a",), ("/s/a",)]
    monkeypatch.setattr(tables, "_finish", finish)
    # As after a driver lost half-way: the bucket is gone.
    (bucket,) = tables.buckets_of(make.files("/r/a"), "files")
    for f in list(_stored(base, "files")):
        if f"/bucket={bucket}/" in f:
            os.remove(f)
    assert rows(tables.read_table(spark, base, "files"), "path") == [("/r/b",), ("/s/a",)]
    assert rows(tables.read_table(spark, base, "files"), "path") == [("/r/b",), ("/s/a",)]


def test_writers_claim_numbers(spark, make, tmp_path, monkeypatch):
    base = str(tmp_path / "catalog")
    monkeypatch.setattr(tables, "path_exists", lambda *a: False)
    os.makedirs(f"{base}/files/v000001")
    open(f"{base}/files/v000001/_claim", "w").close()
    assert tables.write_table(make.files("/r/a"), base, "files") == 2


def test_table_filters_reach_the_scan(spark, make, tmp_path):
    base = str(tmp_path / "catalog")
    tables.write_table(make.files("/r/a", "/r/b"), base, "files")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = duplicate_sets(tables.read_table(spark, base, "files"), min_size=5)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in ("IsNotNull(hash_value)", "EqualTo(removed,0)", "IsNull(error_status)", "GreaterThanOrEqual(size,5)"):
        assert pushed in plan
    assert "mtime" not in plan.split("ReadSchema")[1]


def test_materialized_table_keeps_rows_and_types(spark, make):
    files = make.files("/r/a", ("/r/b", dict(hash_value=None)))
    stored = materialize(files, "test")
    assert stored.dtypes == files.dtypes and rows(stored) == rows(files)
    assert shared_dir(spark) in stored.inputFiles()[0]


def test_intermediate_tables_can_be_dropped(spark, make):
    folder = materialize(make.files("/r/a"), "dropped").inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, folder)
    assert drop_intermediate(spark) > 0
    assert not path_exists(spark, folder) and drop_intermediate(spark) == 0


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "yarn", "x"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_scan_all_and_rescan(spark, tree):
    first = scan.scan_all(spark, scan.empty_catalog(spark), tree, now=1000)
    assert rows(first.summary, "folders", "files", "duplicate_sets", "duplicate_files") == [(4, 9, 2, 4)]
    catalog = scan.Catalog(*[materialize(df, "rescan") for df in first.catalog])
    assert rows(catalog.roots, "root_path", "folder_count", "last_scan_date") == [(tree, 4, 1000)]

    with open(f"{tree}/dup/file1.txt", "w") as changed:
        changed.write("other")
    second = scan.scan_all(spark, catalog, tree, now=2000, only_candidates=True)
    assert rows(second.summary, "files", "duplicate_sets") == [(9, 1)]
    row = second.catalog.files.where(F.col("path").endswith("/file1.txt")).first()
    assert (row.first_scanned_at, row.last_scanned_at, row.size) == (1000, 2000, 5)


def test_scan_files_needs_registered_folders(spark, make):
    catalog = scan.empty_catalog(spark)._replace(folders=make.folders("/r", ("/r/x", dict(removed=1))))
    found = make.files("/r/a", "/r/x/b", "/r/y/c").select("path", "size", "mtime", "folder_path", "root_path")
    digests = make.files("/r/a").select("path", "hash_value", "hash_algorithm", "error_status")
    assert rows(scan.scan_files(catalog, found, digests, 5, "/r"), "path", "hash_value") == [("/r/a", "h")]
    with pytest.raises(ValueError, match="no folders"):
        scan.scan_files(catalog, found, digests, 5, "/other")


def test_rescan_reads_only_what_changed(spark, tree):
    first = scan.scan_all(spark, scan.empty_catalog(spark), tree, now=1000)
    catalog = scan.Catalog(*[materialize(df, "rescan") for df in first.catalog])
    # A hash that only an untouched file can keep.
    marked = catalog.files.withColumn("hash_value", F.concat(F.lit("old "), "hash_value"))
    with open(f"{tree}/dup/file1.txt", "w") as changed:
        changed.write("other text")
    os.remove(f"{tree}/dup/deep/file1_copy.txt")
    os.rmdir(f"{tree}/dup/deep")
    with open(f"{tree}/new", "w") as new:
        new.write("n")
    second = scan.rescan(spark, catalog._replace(files=materialize(marked, "rescan")), tree, 2000)
    # A link to a folder cannot be read, so it is tried again each time.
    assert rows(second.summary) == [(9, 3, 1, 0)]
    found = {os.path.basename(r.path): r for r in second.catalog.files.collect()}
    assert found["file1.txt"].hash_value == hashlib.sha512(b"other text").hexdigest()
    assert found["new"].first_scanned_at == 2000 and found["file2.bin"].hash_value.startswith("old ")
    assert {n for n, r in found.items() if r.removed} == {"file1_copy.txt"}
    assert rows(second.catalog.folders.where("removed = 1"), "folder_path") == [(f"{tree}/dup/deep",)]
    assert rows(second.catalog.roots, "folder_count", "file_count", "last_scan_date") == [(3, 9, 2000)]
    with open(f"{tree}/dup/file1.txt", "a"):
        pass
    os.makedirs(f"{tree}/dup/deep")
    with open(f"{tree}/dup/deep/file1_copy.txt", "w") as back:
        back.write("x")
    third = scan.rescan(spark, scan.Catalog(*[materialize(df, "rescan") for df in second.catalog]), tree, 3000)
    assert third.summary.first().restored == 1 and third.catalog.files.where("removed = 1").count() == 0


def test_document_tree_reaches_workers_in_bounded_batches(spark, tmp_path, monkeypatch):
    """Texts come one by one, never as a whole Arrow batch."""
    from filetwin.sources import samples

    rows_of = [(k, "x" * 50, "en", "s") for k in range(300)]
    spark.createDataFrame(rows_of, samples.COLUMNS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda *_: pytest.fail("a whole batch of texts"))
    top = samples.document_tree(spark, str(tmp_path))
    sizes = [os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(top) for name in names]
    assert sorted(sizes) == [0] * 34 + [51] * 266
