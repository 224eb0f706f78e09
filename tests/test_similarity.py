import os
import random
from collections import Counter, defaultdict

import pytest

from filetwin.operators import similarity as sim
from filetwin.operators import skew

from .conftest import rows

SALTED = [dict(), dict(force_salt=True, hot_rows=1)]


def _random_catalog(seed, folders=40, contents=25):
    """(path, values) of folders of mixed sizes; content 0 lies in every second folder."""
    pick = random.Random(seed)
    specs = []
    for f in range(folders):
        home = f"/r{f % 2}/" + pick.choice(["", "a/", "a/b/", "c/"]) + f"d{f}"
        names = pick.sample(range(contents), pick.randint(1, 8)) + ([0] if f % 2 else [])
        if f % 5 == 0 and specs:
            home += "/sub"
        for i, c in enumerate(names):
            specs.append((f"{home}/f{i}", dict(hash_value=f"c{c:02d}", size=c + 1)))
        if f % 4 == 0:
            for i, c in enumerate(names):
                specs.append((f"/r{f % 2}/copy{f}/f{i}", dict(hash_value=f"c{c:02d}", size=c + 1)))
    return specs


def _contents(specs, scope):
    """Content lists per folder, computed row by row."""
    held = defaultdict(list)
    for path, values in specs:
        parts = path.split("/")[1:-1]
        tops = [len(parts)] if scope == "direct" else range(1, len(parts) + 1)
        for depth in tops:
            held["/" + "/".join(parts[:depth])].append((values["hash_value"], values["size"]))
    return held


def _below(child, parent):
    return child.startswith(parent + "/")


def _expected_pairs(specs, threshold, scope):
    """All similar folder pairs by comparing every two folders."""
    held = {f: set(c) for f, c in _contents(specs, scope).items()}
    names = sorted(held)
    found = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if scope == "subtree" and (_below(b, a) or _below(a, b)):
                continue
            common, whole = len(held[a] & held[b]), len(held[a] | held[b])
            if common and common * 100 >= threshold * whole:
                found[(a, b)] = (common, whole)
    return held, found


def _classes(specs, scope):
    """The class of each folder and how many of its contents are shared.

    A class is named by its first folder: as many contents, and the same shared ones. Shared: in another set too, and not only in
    folders that lie within each other.
    """
    held = {f: frozenset(c) for f, c in _contents(specs, scope).items()}
    often = Counter(c for shape in set(held.values()) for c in shape)
    if scope == "subtree":
        holders = defaultdict(set)
        for folder, content in _contents(specs, "direct").items():
            for c in content:
                holders[c].add((held[folder], folder.rsplit("/", 1)[0]))
        often = {c: n if len(holders[c]) > 1 else 0 for c, n in often.items()}
    key = {}
    for folder, content in held.items():
        core = frozenset(c for c in content if often[c] > 1)
        key[folder] = (len(content), core or frozenset(content))
    first = {}
    for folder in sorted(held):
        first.setdefault(key[folder], folder)
    return {folder: first[key[folder]] for folder in held}, {f: sum(often[c] > 1 for c in held[f]) for f in held}


@pytest.mark.parametrize("scope", ["direct", "subtree"])
@pytest.mark.parametrize("threshold", [20, 50, 80, 100])
def test_similar_folders_equal_brute_force(make, monkeypatch, scope, threshold):
    monkeypatch.setattr(sim, "SMALL_SHAPE", 4)
    specs = _random_catalog(threshold)
    held, wanted = _expected_pairs(specs, threshold, scope)
    name, _ = _classes(specs, scope)
    by_class, size = defaultdict(int), Counter(name.values())
    for (a, b), (common, whole) in wanted.items():
        left, right = sorted((name[a], name[b]))
        if left == right and common < whole:
            right = min(f for f in name if name[f] == left and held[f] != held[left])
        by_class[(left, right, common, whole)] += 1
    got = sim.similar_folders(make.files(*specs), threshold, scope).collect()
    assert {(r.left_folder, r.right_folder, r.common, r.distinct_contents): r.folder_pairs for r in got} == by_class
    assert len(got) == len(by_class)
    assert all(r.similarity == round(100 * r.common / r.distinct_contents, 2) for r in got)
    assert all((r.left_copies, r.right_copies) == (size[name[r.left_folder]], size[name[r.right_folder]]) for r in got)


def test_salted_similarity_equals_brute_force(make):
    specs = _random_catalog(7)
    files = make.files(*specs)
    plain = rows(sim.similar_folders(files, 40))
    assert plain and rows(sim.similar_folders(files, 40, force_salt=True, hot_rows=3)) == plain


def test_content_shared_by_most_folders(make):
    specs = []
    for f in range(120):
        specs += [(f"/r/d{f}/own", dict(hash_value=f"own{f}")), (f"/r/d{f}/license", dict(hash_value="license"))]
    specs.append(("/r/only/license", dict(hash_value="license")))
    got = rows(sim.similar_folders(make.files(*specs), 50), "left_folder", "right_folder", "folder_pairs")
    assert got == [("/r/d0", "/r/only", 120)]


@pytest.mark.parametrize("scope", ["direct", "subtree"])
def test_rows_do_not_grow_with_folders_around_a_common_core(make, scope):
    """N folders with a common core and contents of their own, some of them in several copies."""
    found = {}
    for folders in (30, 150):
        specs = []
        for f in range(folders):
            for copy in range(1 + (f % 3 == 0)):
                home = f"/r/d{f}/v{copy}" if scope == "direct" else f"/r/d{f}-v{copy}"
                specs += [(f"{home}/core{c}", dict(hash_value=f"core{c}", size=9)) for c in range(6)]
                specs += [(f"{home}/own{c}", dict(hash_value=f"own{f}-{c}", size=9)) for c in range(2)]
        held, wanted = _expected_pairs(specs, 50, scope)
        got = sim.similar_folders(make.files(*specs), 50, scope).collect()
        assert sum(r.folder_pairs for r in got) == len(wanted)
        found[folders] = len(got)
    assert found[30] == found[150] == 2


@pytest.mark.parametrize("scope", ["direct", "subtree"])
def test_members_of_classes(make, scope):
    specs = _random_catalog(11)
    held, _ = _expected_pairs(specs, 50, scope)
    sets = {folder: frozenset(content) for folder, content in held.items()}
    first, (name, shared) = {}, _classes(specs, scope)
    size = Counter(name.values())
    for folder in sorted(sets):
        first.setdefault(sets[folder], folder)
    copies = Counter(sets.values())
    wanted = [(name[f], f, first[c], copies[c], size[name[f]], len(c), shared[f]) for f, c in sets.items()]
    got = sim.similar_members(make.files(*specs), scope)
    assert got.columns == ["class_folder", "folder_path", "shape_folder", "copies", "folders", "contents", "shared"]
    assert rows(got) == sorted(wanted, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_different_contents_behind_a_class_signature_are_refused(make, monkeypatch):
    monkeypatch.setattr(sim, "_masked", lambda names: [sim.F.lit(0).cast("long").alias(n) for n in names])
    specs = [(f"/r/{f}/{c}", dict(hash_value=c)) for f, held in enumerate(("abx", "cdy", "abz", "cdw")) for c in held]
    contents = sim.folder_contents(make.files(*specs))
    with pytest.raises(ValueError, match="signature"):
        sim.folder_classes(contents.withColumn("k", sim.F.lit(1)), verify=True)


@pytest.mark.parametrize("scope", ["direct", "subtree"])
@pytest.mark.parametrize("skew", SALTED)
def test_duplicate_folders_equal_brute_force(make, scope, skew):
    specs = _random_catalog(3)
    held = {f: Counter(c) for f, c in _contents(specs, scope).items()}
    groups = defaultdict(list)
    for folder, content in held.items():
        chain = scope == "subtree" and any(_below(folder, g) and held[g] == content for g in held)
        if not chain:
            groups[frozenset(content.items())].append(folder)
    wanted = sorted((min(g), f, len(g)) for g in groups.values() if len(g) > 1 for f in g)
    got = sim.duplicate_folders(make.files(*specs), scope, **skew)
    assert wanted and rows(got, "group_folder", "folder_path", "copies") == wanted


def test_scenario_folders(make):
    doc = lambda folder, n: (f"/t/{folder}/doc{n}.txt", dict(hash_value=f"doc{n}"))
    files = make.files(doc("folder_a", 1), doc("folder_a", 2), doc("folder_b", 1), doc("folder_b", 2))
    assert rows(sim.duplicate_folders(files), "folder_path") == [("/t/folder_a",), ("/t/folder_b",)]


def test_multiset_matters_for_identity_but_not_for_similarity(make):
    files = make.files(
        ("/r/a/1", dict(hash_value="x")), ("/r/a/2", dict(hash_value="x")), ("/r/b/1", dict(hash_value="x"))
    )
    assert sim.duplicate_folders(files, "direct").count() == 0
    assert rows(sim.similar_folders(files), "left_copies", "similarity") == [(2, 100.0)]


def test_unhashed_files_disqualify_and_removed_ones_do_not_count(make):
    files = make.files(
        ("/r/a/1", dict(hash_value="x")),
        ("/r/b/1", dict(hash_value="x")),
        ("/r/b/2", dict(hash_value=None)),
        ("/r/c/1", dict(hash_value="x")),
        ("/r/c/2", dict(hash_value="y", removed=1)),
    )
    assert rows(sim.duplicate_folders(files, "direct"), "folder_path") == [("/r/a",), ("/r/c",)]


def test_partial_scenario_thresholds_and_differences(make):
    def files():
        specs = [(f"/t/partial_{s}/common{n}", dict(hash_value=f"common{n}", mtime=1)) for s in "ab" for n in (1, 2)]
        specs += [("/t/partial_a/ua", dict(hash_value="ua")), ("/t/partial_b/ub", dict(hash_value="ub"))]
        specs.append(("/t/partial_b/same", dict(hash_value="s", mtime=5)))
        specs.append(("/t/partial_a/same", dict(hash_value="s", mtime=4)))
        return make.files(*specs)

    found = sim.similar_folders(files(), 60)
    assert rows(found, "common", "distinct_contents", "similarity") == [(3, 5, 60.0)]
    assert sim.similar_folders(files(), 61).count() == 0
    wanted = [
        ("different_date", None, "same", 4, 5),
        ("missing_left", "ub", None, None, None),
        ("missing_right", "ua", None, None, None),
    ]
    columns = ["difference", "hash_value", "name", "left_mtime", "right_mtime"]
    assert rows(sim.folder_differences(files(), found), *columns) == wanted
    assert rows(sim.folder_differences(files(), found, force_salt=True, hot_rows=1), *columns) == wanted


def test_differences_in_subtrees_compare_names_below_the_folder(make):
    files = make.files(
        ("/t/a/x/f", dict(hash_value="1", mtime=1)),
        ("/t/b/x/f", dict(hash_value="1", mtime=2)),
        ("/t/b/y/f", dict(hash_value="2")),
    )
    pairs = files.sparkSession.createDataFrame([("/t/a", "/t/b")], "left_folder string, right_folder string")
    found = sim.folder_differences(files, pairs, "subtree")
    assert rows(found, "difference", "hash_value", "name") == [
        ("different_date", None, "x/f"),
        ("missing_left", "2", None),
    ]


def test_equal_signatures_of_different_folders_are_refused(make, monkeypatch):
    monkeypatch.setattr(sim, "LANE_MASK", 0)
    files = make.files(("/r/a/1", dict(hash_value="x")), ("/r/b/1", dict(hash_value="y")))
    with pytest.raises(ValueError, match="signature"):
        sim.duplicate_folders(files, "direct")


@pytest.mark.parametrize("scope", ["direct", "subtree"])
def test_folders_cut_into_parts_equal_brute_force(make, monkeypatch, scope):
    monkeypatch.setattr(sim, "PART_CONTENTS", 3)
    monkeypatch.setattr(sim, "SMALL_SHAPE", 4)
    specs = _random_catalog(5) + [(f"/r0/many/f{i}", dict(hash_value="c03", size=4)) for i in range(9)]
    _, wanted = _expected_pairs(specs, 40, scope)
    got = sim.similar_folders(make.files(*specs), 40, scope).collect()
    assert sum(r.folder_pairs for r in got) == len(wanted)


def test_a_seed_that_gives_two_contents_one_key_is_left_out(make, monkeypatch):
    real, zero = sim.F.xxhash64, sim.F.lit(0).cast("bigint")
    monkeypatch.setattr(sim, "_content_hash", lambda seed: zero if seed == 0 else real(sim.F.lit(seed), *sim.CONTENT))
    files = make.files(("/r/a/1", dict(hash_value="x")), ("/r/b/1", dict(hash_value="y")))
    assert files.select(sim._content_key(files)).distinct().count() == 2


def _stored(spark, monkeypatch, run):
    """Bytes that the steps of `run` write, without broadcast joins."""
    folders, real = [], sim.materialize

    def kept(df, label):
        out = real(df, label)
        folders.append(sum(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(sim, "materialize", kept)
    monkeypatch.setattr(skew, "materialize", kept)
    run()
    return sum(folders)


@pytest.mark.parametrize("scope", ["direct", "subtree"])
def test_written_bytes_per_file_are_bounded(spark, monkeypatch, scope):
    n = 60_000
    files = spark.range(n).selectExpr(
        "concat('/r', id % 4, '/d', id div 4, '/f', id % 4) as path",
        "concat('/r', id % 4, '/d', id div 16) as folder_path",
        "concat('/r', id % 4) as root_path",
        "sha2(cast(cast(xxhash64(id) % 9000 as string) as binary), 256) as hash_value",
        *["9L as size", "0 as removed", "cast(null as string) as error_status", "1L as mtime"],
    )
    assert _stored(spark, monkeypatch, lambda: sim.similar_folders(files, scope=scope).count()) < 150 * n


@pytest.mark.parametrize("value", ["00ff", "abc", "AB", "", "zz", "\u00e9", None])
def test_hashes_of_differences_come_back_as_they_were(make, value):
    files = make.files(("/t/a/1", dict(hash_value=value)), ("/t/a/2", dict(hash_value="x")), ("/t/b/2", dict(hash_value="x")))
    pairs = files.sparkSession.createDataFrame([("/t/a", "/t/b")], "left_folder string, right_folder string")
    got = [r.hash_value for r in sim.folder_differences(files, pairs).collect()]
    assert got == ([] if value is None else [value])


def test_bad_parameters(make):
    files = make.files("/r/a/1")
    with pytest.raises(ValueError):
        sim.similar_folders(files, 0)
    with pytest.raises(ValueError):
        sim.duplicate_folders(files, "sideways")
