"""Centroid clustering against a plain recomputation and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from filetwin.llm import queries
from filetwin.llm.centroids import VantageTree, cluster

LONG = 1 << 63


def wanted(rows, k, dims, rounds=3):
    kept = []
    for number, vector in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((number, [math.floor(64 * x) for x in vector]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in first[:k]]

    def nearest(vector):
        distance, number = min((sum((a - b) ** 2 for a, b in zip(vector, c)), n) for n, c in enumerate(centres))
        return number, distance

    for _ in range(rounds):
        groups = {}
        for _, vector in kept:
            groups.setdefault(nearest(vector)[0], []).append(vector)
        for number, members in groups.items():
            centres[number] = [sum(column) // len(members) for column in zip(*members)]
    found = [(number, *nearest(vector)) for number, vector in kept]
    sums = {}
    for _, number, distance in found:
        sums[number] = sums.get(number, 0) + distance
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    exact = [(i, n, d, sums[n], total, digests[n]) for i, n, d in found]
    return [tuple(None if isinstance(x, int) and x >= LONG else x for x in row) for row in exact]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def odd(spark):
    dice = random.Random(3)
    rows = [(k % 40 if k % 17 else None, [float(dice.randrange(3)) for _ in range(4)]) for k in range(300)]
    rows += [(1, None), (2, [1.0]), (3, [1.0, None, 2.0, 1.0]), (4, [math.nan] * 4), (5, [math.inf] * 4), (6, [])]
    return rows


def frame(spark, rows):
    told = [(*row, "clash", 1, "clash") for row in rows]
    return spark.createDataFrame(told, "vec_id long, embedding array<double>, v string, cluster int, own string").repartition(3)


@pytest.mark.parametrize("k", [1, 2, 5, 16, 120, 400])
def test_ties_nulls_and_repeats(spark, odd, k):
    got = cluster(frame(spark, odd), k=k, dims=4).collect()
    assert ordered(map(tuple, got)) == ordered(wanted(odd, k, 4))


def test_large_components_stay_exact(spark, odd):
    dice = random.Random(4)
    rows = odd + [(900 + k, [dice.choice([1e14, -1e15, 3.0, 2e6]) for _ in range(4)]) for k in range(60)]
    got = cluster(frame(spark, rows), k=16, dims=4).collect()
    assert ordered(map(tuple, got)) == ordered(wanted(rows, 16, 4))
    assert any(r.inertia is None for r in got) and any(r.distance is not None for r in got)


def test_search_equals_all_distances():
    rng = np.random.default_rng(1)
    for dims, spread, k in ((3, 4, 50), (8, 2, 200), (64, 100, 333)):
        centres, vectors = rng.integers(-spread, spread, (k, dims)), rng.integers(-spread, spread, (2000, dims))
        numbers, found = VantageTree.build(centres).search(vectors)
        every = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (numbers == every.argmin(axis=1)).all() and (found == every.min(axis=1)).all()


def test_the_tree_prunes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-10_000, 10_000, (500, 2))
    tree, vectors, looked = VantageTree.build(centres), rng.integers(-10_000, 10_000, (400, 2)), []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    VantageTree(centres.view(Counted), tree.vantage, tree.members, tree.branches).nearest(vectors[:1])
    assert len(looked) < 100


def test_fewer_vectors_than_centroids_and_none(spark):
    few = [(1, [0.0] * 4), (2, [1.0] * 4)]
    assert ordered(map(tuple, cluster(frame(spark, few), dims=4).collect())) == ordered(wanted(few, 16, 4))
    nothing = cluster(frame(spark, few).limit(0), dims=4)
    assert nothing.collect() == [] and nothing.columns[0] == "vec_id"


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    told = connection.sql(queries.SQL["op12_vantage_clusters"])
    found = queries.op12_vantage_clusters(spark, folder)
    assert told.columns == found.columns
    assert ordered(told.fetchall()) == ordered(tuple(r) for r in found.collect())
