import random

import pytest
from pyspark.sql import functions as F

from filetwin.operators import catalog as cat
from filetwin.operators import duplicates as dup
from filetwin.operators import folders as tree
from filetwin.operators import lifecycle as life
from filetwin.operators import mutate as change

from .conftest import rows

SALTED = [dict(), dict(force_salt=True, hot_rows=1)]


@pytest.mark.parametrize("skew", SALTED)
def test_detect_removed_touches_only_listed_roots(make, skew):
    old = make.files("/r/a", "/r/b", "/s/c", ("/r/d", dict(removed=1)))
    found = life.detect_removed(old, make.files("/r/a"), 77, **skew)
    assert rows(found, "path", "removed", "last_scanned_at") == [
        ("/r/a", 0, 2000),
        ("/r/b", 1, 77),
        ("/r/d", 1, 2000),
        ("/s/c", 0, 2000),
    ]
    none_left = life.detect_removed(old, make.files("/q/z"), 77, listed_roots=make.roots("/s"), **skew)
    assert rows(none_left.where("removed = 1"), "path") == [("/r/d",), ("/s/c",)]


@pytest.mark.parametrize("skew", SALTED)
def test_cascade_removed_is_anchored(make, skew):
    folders = make.folders("/r", ("/r/docs", dict(removed=1)), "/r/docs/in", "/r/docs2")
    files = make.files("/r/docs/a", "/r/docs/in/b", "/r/docs2/c")
    new_folders, new_files = life.cascade_removed(folders, files, 9, **skew)
    assert rows(new_folders.where("removed = 1"), "folder_path") == [("/r/docs",), ("/r/docs/in",)]
    assert rows(new_files.where("removed = 1"), "path", "last_scanned_at") == [("/r/docs/a", 9), ("/r/docs/in/b", 9)]


def test_restored_file_is_reported_and_revived(make):
    old, listing = make.files(("/r/a", dict(removed=1)), "/r/b"), make.files("/r/a", "/r/b")
    assert rows(life.restored_files(old, listing), "path", "first_scanned_at") == [("/r/a", 1000)]
    assert rows(change.upsert_files(old, listing), "path", "removed", "first_scanned_at") == [("/r/a", 0, 1000), ("/r/b", 0, 1000)]


def test_rehash_reasons_and_summary(make):
    old = make.files(
        ("/r/none", dict(hash_value=None, hash_algorithm=None)),
        ("/r/error", dict(error_status="x", hash_value=None, hash_algorithm=None)),
        ("/r/algo", dict(hash_algorithm="sha256")),
        "/r/changed",
        "/r/same",
        "/r/unlisted",
    )
    listing = make.files(("/r/changed", dict(mtime=101)), "/r/same")
    found = life.rehash_candidates(old, listing)
    assert rows(found, "path", "reason") == [
        ("/r/algo", "algorithm"),
        ("/r/changed", "changed"),
        ("/r/error", "error"),
        ("/r/none", "unhashed"),
    ]
    assert rows(life.rehash_summary(found)) == [("sha256", "sha512", 1), ("sha512", "sha512", 1), (None, "sha512", 2)]


@pytest.mark.parametrize("skew", SALTED)
def test_moved_files_find_the_next_sight(make, skew):
    files = make.files(
        ("/r/old1", dict(removed=1, first_scanned_at=1)),
        ("/r/old2", dict(removed=1, first_scanned_at=5)),
        ("/r/old3", dict(removed=1, first_scanned_at=9)),
        ("/r/early", dict(first_scanned_at=1)),
        ("/r/new-b", dict(first_scanned_at=5)),
        ("/r/new-a", dict(first_scanned_at=5)),
        ("/r/last", dict(first_scanned_at=8)),
        ("/r/other", dict(first_scanned_at=8, hash_value="x")),
    )
    assert rows(life.moved_files(files, **skew), "from_path", "to_path", "moved_at", "later_copies") == [
        ("/r/old1", "/r/new-a", 5, 3),
        ("/r/old2", "/r/last", 8, 1),
    ]


def test_folder_tree_and_parents(make):
    found = tree.folder_tree(make.files("/r/a/b/1", "/r/c/2", "/r/3"))
    assert rows(found) == [("/r", None, "/r"), ("/r/a", "/r", "/r"), ("/r/a/b", "/r/a", "/r"), ("/r/c", "/r", "/r")]
    resolved = cat.resolve_parent(found, make.folders("/r"))
    assert rows(resolved, "folder_path", "registered_parent") == [("/r", None), ("/r/a", "/r"), ("/r/a/b", None), ("/r/c", "/r")]


def test_hierarchy_counts(make):
    folders = make.folders("/r", "/r/a", "/r/a/b", ("/r/gone", dict(removed=1)))
    files = make.files("/r/a/b/1", "/r/a/2", ("/r/a/3", dict(removed=1)))
    assert rows(tree.folder_hierarchy(folders, files), "folder_path", "depth", "folders_below", "files_below", "bytes_below") == [
        ("/r", 0, 2, 2, 20),
        ("/r/a", 1, 1, 2, 20),
        ("/r/a/b", 2, 0, 1, 10),
    ]


def test_folder_states(spark):
    folders = spark.createDataFrame(
        [("/r", None, 6), ("/r/a", "/r", 7), ("/r/b", "/r", 6), ("/r/del", "/r", 9), ("/r/full", "/r", 9)],
        "folder_path string, parent_path string, status int",
    )
    files = spark.createDataFrame([("/r/b", 7), ("/r/b", 7), ("/r/full", 7)], "folder_path string, status int")
    assert rows(tree.folder_states(folders, files), "folder_path", "new_status") == [
        ("/r", 6),
        ("/r/a", 7),
        ("/r/b", 7),
        ("/r/del", 10),
        ("/r/full", 9),
    ]


DEEP = "folder_path string, parent_path string, root_path string, status int"


def test_folder_states_settle_in_one_call(spark):
    folders = spark.createDataFrame([("/r", None, "/r", 6), ("/r/a", "/r", "/r", 5), ("/r/a/b", "/r/a", "/r", 6)], DEEP)
    files = spark.createDataFrame([("/r/a/b", 7), ("/r/a", 7)], "folder_path string, status int")
    assert rows(tree.settle_folders(folders, files), "folder_path", "new_status") == [("/r", 7), ("/r/a", 7), ("/r/a/b", 7)]


@pytest.mark.parametrize("seed", range(6))
def test_settled_states_equal_repeated_steps(spark, seed):
    dice = random.Random(seed)
    states, parents = {"/r": 6, "/q": 5}, {"/r": None, "/q": None}
    for k in range(60):
        parent = dice.choice(sorted(states))
        states[f"{parent}/f{k}"] = dice.choice([5, 5, 6, 6, 6, 7, 9, 11, 4] if seed % 2 else [5, 6, 6, 6, 7])
        parents[f"{parent}/f{k}"] = parent
    files = [(dice.choice(sorted(states)), 7 if dice.random() < 0.9 else dice.choice([6, 9])) for _ in range(80)]
    gone = [p for p in states if dice.random() < 0.05]
    now = {p: {5: 8, 6: 8, 7: 8, 11: 12}.get(s, s) if p in gone else s for p, s in states.items()}
    children = {p: [now_ for f, now_ in files if f == p] for p in states}
    while True:
        after = {}
        for p, s in now.items():
            below = children[p] + [now[c] for c in states if parents[c] == p]
            if s == 5:
                s = 6 if below else 7
            elif s == 6 and below and set(below) == {7}:
                s = 7
            elif s == 9 and not below:
                s = 10
            after[p] = s
        if after == now:
            break
        now = after
    told = spark.createDataFrame([(p, parents[p], "/" + p.split("/")[1], s) for p, s in states.items()], DEEP)
    found = tree.settle_folders(
        told,
        spark.createDataFrame(files, "folder_path string, status int"),
        spark.createDataFrame([(p,) for p in gone], "folder_path string"),
    )
    assert {r.folder_path: (r.old_status, r.new_status) for r in found.collect()} == {p: (states[p], now[p]) for p in states}


@pytest.mark.parametrize("skew", SALTED)
def test_labels_come_from_the_nearest_folder(make, spark, skew):
    labels = spark.createDataFrame(
        [("/r", "ann", None, "keep"), ("/r/a", None, "work", "drop"), ("/r/a2", "bob", None, None)],
        "folder_path string, owner string, purpose string, policy string",
    )
    folders = make.folders("/r", "/r/a", "/r/a/b", "/r/a2", "/s")
    found = tree.folder_labels(folders, labels, **skew)
    assert rows(found) == [
        ("/r", "ann", None, "keep"),
        ("/r/a", "ann", "work", "drop"),
        ("/r/a/b", "ann", "work", "drop"),
        ("/r/a2", "bob", None, "keep"),
        ("/s", None, None, None),
    ]
    files = tree.file_labels(make.files("/r/a/b/x", "/q/y"), found, **skew)
    assert rows(files, "path", "owner") == [("/q/y", None), ("/r/a/b/x", "ann")]


def test_listings(make, spark):
    roots = make.roots(("/b", dict(last_scan_date=0, total_size=2048, file_count=1234)), "/a")
    assert [r.root_path for r in cat.roots_listing(roots).collect()] == ["/a", "/b"]
    assert rows(cat.roots_listing(roots), "files_text", "size_text", "last_scan_text") == [
        ("0", "0 B", "Never scanned"),
        ("1,234", "2.0 KB", "1970-01-01 00:00:00 UTC"),
    ]
    assert rows(cat.roots_json(roots), "document")[0] == (
        '{"path":"/a","folder_count":0,"file_count":0,"total_size_bytes":0,"last_scan_date":null}',
    )
    assert rows(cat.root_by_path(roots, "/a"), "root_path") == [("/a",)]
    found = cat.removed_candidates(make.folders(("/r/x", dict(removed=1))), make.files(("/r/a", dict(removed=1)), "/r/b"))
    assert rows(found) == [("/r", 1, "files"), ("/r", 1, "folders")]


def test_active_scan_is_the_latest_unfinished(spark):
    from filetwin import schemas

    scans = spark.createDataFrame(
        [
            (1, "/r", "all", None, None, 5, 5, 0),
            (2, "/r", "files", "/r/x", None, 9, 9, 0),
            (3, "/r", "all", None, None, 11, 11, 1),
        ],
        schemas.SCANS,
    )
    assert rows(cat.active_scan(scans), "scan_id", "current_folder_path") == [(2, "/r/x")]


@pytest.mark.parametrize("skew", SALTED)
def test_first_rule_wins(spark, skew):
    dice = random.Random(4)
    pick = lambda *values: dice.choice([None, *values])
    folders = [(f"/r/{k}", pick("ann", "bob"), pick("work", "x"), pick("keep", "drop")) for k in range(80)]
    rules = [(k // 2, pick("ann", "bob"), pick("work", "x"), pick("keep", "drop"), dice.randrange(9)) for k in range(10)]
    rules = [r for r in rules if any(r[1:4])]
    wanted = []
    for path, *labels in folders:
        met = [(r[0], r[4]) for r in rules if all(want is None or want == have for want, have in zip(r[1:4], labels))]
        if met:
            wanted.append((path, min(met)[1]))
    told = spark.createDataFrame(folders, "folder_path string, owner string, purpose string, policy string")
    ruled = spark.createDataFrame(rules, "rule_no int, owner string, purpose string, policy string, rank int")
    assert 5 < len(wanted) < 80 and rows(tree.rule_ranks(told, ruled, **skew)) == sorted(wanted)
    assert tree.rule_ranks(told, ruled.limit(0), **skew).count() == 0


def test_primary_follows_inherited_labels(make, spark):
    files = make.files("/r/a/old/x", ("/r/b/y", dict(first_scanned_at=5)), ("/s/z", dict(first_scanned_at=1)))
    folders = make.folders("/r", "/r/a", "/r/a/old", "/r/b", "/s")
    labels = spark.createDataFrame([("/r/a", "ann", None, None)], "folder_path string, owner string, purpose string, policy string")
    rules = spark.createDataFrame([(1, "ann", None, None, 1)], "rule_no int, owner string, purpose string, policy string, rank int")
    found = dup.keep_primary_by_labels(files, folders, labels, rules)
    assert rows(found, "path", "primary_path", "status") == [
        ("/r/a/old/x", "/r/a/old/x", 7),
        ("/r/b/y", "/r/a/old/x", 9),
        ("/s/z", "/r/a/old/x", 9),
    ]
