"""Numbers and running values over ranges: one group spreads over many tasks and nothing changes."""

import random

import pytest
from pyspark.sql import functions as F

from filetwin.operators import duplicates as dup
from filetwin.operators import lifecycle as life
from filetwin.operators import ordered

from .conftest import rows


@pytest.fixture
def many_ranges(spark):
    """Ranges stay apart although the tables are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def seen(monkeypatch):
    """How many ranges each written order had."""
    counts, plain = [], ordered.ranged

    def watched(*args, **kwargs):
        found = plain(*args, **kwargs)
        counts.append(found.select("_part").distinct().count())
        return found

    monkeypatch.setattr(ordered, "ranged", watched)
    monkeypatch.setattr(life, "ranged", watched)
    return counts


def test_numbers_and_running_sums(spark, many_ranges, seen):
    dice = random.Random(1)
    values = [(dice.choice("abc"), dice.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(values, "g string, v long, k long").repartition(3)
    order = [F.col("g").desc(), F.col("v"), F.col("k")]
    wanted = sorted(values, key=lambda r: (-ord(r[0]), r[1], r[2]))
    assert sorted(ordered.numbered(df, order, "n").collect(), key=lambda r: r.n) == [(*r, n) for n, r in enumerate(wanted)]
    total, sums = 0, {}
    for r in wanted:
        sums[r[2]], total = total, total + r[1]
    assert {r.k: r.before for r in ordered.running_sum(df, order, "v", "before").collect()} == sums
    assert min(seen) >= 3
    assert ordered.numbered(df.limit(0), order, "n").collect() == []


def test_sets_of_one_size_spread_over_tasks(make, many_ranges, seen):
    """One size band, even one size: numbers go on over the ranges."""
    specs = [(f"/r/{c}-{k}", dict(hash_value=f"h{c:03d}", size=77)) for c in range(200) for k in range(2)]
    specs += [(f"/r/big{k}", dict(hash_value="h500", size=78)) for k in range(3)]
    found = dup.numbered_sets(make.files(*specs)).collect()
    wanted = {"h500": 1} | {f"h{c:03d}": c + 2 for c in range(200)}
    assert {(r.short_hash, r.set_no) for r in found} == set(wanted.items()) and len(found) == 403
    assert max(seen) >= 3


@pytest.mark.parametrize("seed", range(3))
def test_one_content_at_many_times_spreads_over_tasks(make, many_ranges, seen, seed):
    dice = random.Random(seed)
    specs = []
    for k in range(300):
        content = dice.choice(["hot"] * 8 + ["b", "c"])
        gone, at = int(dice.random() < (0.5, 0.9, 0.1)[seed]), dice.randrange(1, 400)
        specs.append((f"/r/f{k:03d}", dict(hash_value=content, removed=gone, first_scanned_at=at)))
    wanted = []
    for path, old in specs:
        later = sorted(
            (v["first_scanned_at"], p)
            for p, v in specs
            if not v["removed"] and v["hash_value"] == old["hash_value"] and v["first_scanned_at"] > old["first_scanned_at"]
        )
        if old["removed"] and later:
            wanted.append((path, later[0][1], later[0][0], len(later)))
    got = life.moved_files(make.files(*specs))
    assert rows(got, "from_path", "to_path", "moved_at", "later_copies") == sorted(wanted)
    assert max(seen) >= 3
