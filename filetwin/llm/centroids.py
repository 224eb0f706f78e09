"""Clustering of integer vectors around centroids, with exact distances and ties.

Every component x becomes floor(64 x) of its double value. In each round the centroids are put into a
vantage-point tree, which is broadcast (`k` centroids, `k` being a parameter), and every vector looks for its nearest
centroid in it best first: of all open branches of a vector the one with the smallest lower bound is taken
next, until no bound is at or below the best distance found. The bound is inclusive and rounded down, so an equally near centroid
of a smaller number is never cut off. A task searches a block of vectors in step: each vector has its own
bounds and its own order of branches, and the vectors that visit the same node at that step share one
product. Distances to vantage points and leaf members are exact integers.

A round sums the vectors of each centroid in the tasks first (at most `k` rows a task leave it); sums are exact
decimals and the new centroids are exact floors. An empty centroid stays where it is.

Rows whose vector is null, has another length than `dims`, or has a null or non-finite component take no part;
nor do vectors with a component of 2^56 or more, whose integers no long holds. Distances and sums that a long
does not hold are null. Repeated rows and repeated `vec_id` each count; a null `vec_id` is clustered, but
starts no centroid unless too few others do. Starting vectors that share a `vec_id` are taken in order of
their components. With fewer vectors than `k` there are fewer centroids, with none there are no rows. Columns
other than `vec_id` and `embedding` are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SCALE = 64
_LARGEST = 2.0**56
_MOST = (1 << 63) - 1
#: How many bounds (vectors times nodes) a block of vectors may have.
_BOUNDS = 1 << 21


def _fitting(vectors: np.ndarray, *others: np.ndarray) -> bool:
    """Whether all squared distances among the integers of these arrays fit a long."""
    if any(x.dtype == object for x in (vectors, *others)):
        return False
    top = max(int(np.abs(x).max(initial=0)) for x in (vectors, *others))
    return 4 * top * top * vectors.shape[1] < 1 << 63


def _squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances to one centre: longs, or Python integers for arrays of these."""
    difference = vectors - centre
    if difference.dtype == object:
        return (difference * difference).sum(axis=1)
    return np.einsum("ij,ij->i", difference, difference)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass(frozen=True)
class VantageTree:
    """Nodes in arrays: a vantage point each, or the members of a leaf; branches with their range of distances."""

    centres: np.ndarray
    vantage: list[int]
    members: list[list[int]]
    branches: list[list[tuple[int, float, float]]]

    @staticmethod
    def build(centres: np.ndarray, leaf: int = 3) -> VantageTree:
        vantage, members, branches = [], [], []
        if not _fitting(centres):
            centres = centres.astype(object)

        def node(numbers: np.ndarray) -> int:
            place = len(vantage)
            vantage.append(-1)
            members.append([])
            branches.append([])
            if len(numbers) <= leaf:
                members[place] = numbers.tolist()
                return place
            # The member farthest from the first one: vantage points at the rim split best.
            point = numbers[int(np.argmax(_root(_squared(centres[numbers], centres[numbers[0]]))))]
            rest = numbers[numbers != point]
            far = _root(_squared(centres[rest], centres[point]))
            order = np.argsort(far, kind="stable")
            half = len(order) // 2
            vantage[place] = int(point)
            for part in (order[:half], order[half:]):
                low, high = float(far[part].min()), float(far[part].max())
                branches[place].append((node(np.sort(rest[part])), low, high))
            return place

        node(np.arange(len(centres)))
        return VantageTree(centres, vantage, members, branches)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centre of each vector (the smaller one of equals) and its squared distance."""
        count, nodes = len(vectors), len(self.vantage)
        numbers = np.full(count, -1, np.int64)
        best = np.zeros(count, vectors.dtype)
        reach = np.full(count, np.inf)
        open_ = np.full((count, nodes), np.inf)
        open_[:, 0] = 0.0

        def consider(rows: np.ndarray, centre: int) -> np.ndarray:
            found = _squared(vectors[rows], self.centres[centre])
            old, chosen = best[rows], numbers[rows]
            better = (chosen < 0) | (found < old) | ((found == old) & (centre < chosen))
            won = rows[better]
            best[won], numbers[won] = found[better], centre
            far = _root(found)
            reach[won] = far[better]
            return far

        active = np.arange(count)
        while len(active):
            turn = open_[active].argmin(axis=1)
            bounds = open_[active, turn]
            # Inclusive, and a little beyond for the rounding of the roots: an equal distance is always visited.
            going = np.isfinite(bounds) & (bounds <= reach[active] * (1 + 1e-12))
            active, turn = active[going], turn[going]
            open_[active, turn] = np.inf
            for place in np.unique(turn):
                rows = active[turn == place]
                for centre in self.members[place]:
                    consider(rows, centre)
                if self.vantage[place] < 0:
                    continue
                far = consider(rows, self.vantage[place])
                for child, low, high in self.branches[place]:
                    slack = 1e-12 * (far + high)
                    open_[rows, child] = np.maximum(0.0, np.maximum(far - high, low - far) - slack)
        return numbers, best

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`nearest` in blocks of bounded size, in Python integers where a long would not do."""
        tree = self
        if not _fitting(vectors, self.centres):
            vectors = vectors.astype(object)
            tree = VantageTree(self.centres.astype(object), self.vantage, self.members, self.branches)
        step = max(1, _BOUNDS // len(self.vantage))
        parts = [tree.nearest(vectors[k : k + step]) for k in range(0, len(vectors), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def integer_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST))
    kept = vectors.where(F.col("embedding").isNotNull()).where((F.size("embedding") == dims) & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def _sums(rows: DataFrame, tree, dims: int) -> DataFrame:
    """(cluster, part, total): the members of each centroid and, for each component, their sum."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = len(tree.value.centres)
        sizes = np.zeros(centres, np.int64)
        # Two halves of 32 bits each, so that no sum within a task leaves a long.
        low, high = np.zeros((centres, dims), np.int64), np.zeros((centres, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                block = _matrix(batch.column(0), dims)
                numbers, _ = tree.value.search(block)
                sizes += np.bincount(numbers, minlength=centres)
                np.add.at(low, numbers, block & 0xFFFFFFFF)
                np.add.at(high, numbers, block >> 32)
        for number in np.flatnonzero(sizes):
            totals = [int(sizes[number]), *((int(h) << 32) + int(w) for h, w in zip(high[number], low[number], strict=True))]
            columns = [
                pa.array([int(number)] * (dims + 1), pa.int32()),
                pa.array(range(-1, dims), pa.int32()),
                pa.array([str(t) for t in totals]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "part", "total"])

    found = rows.select("v").mapInArrow(run, "cluster int, part int, total string")
    return found.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _assigned(rows: DataFrame, tree, dims: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers, found = tree.value.search(_matrix(batch.column(1), dims))
                if found.dtype == object:
                    found = [d if d <= _MOST else None for d in found]
                columns = [batch.column(0), pa.array(numbers.astype(np.int32)), pa.array(found, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of `vectors` that takes part.

    The vectors whose hash of `<seed>:<vec_id>` is smallest are the first centroids. `k` rows of `dims` integers go to the
    driver after each round, and from there to the tasks as a tree.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, dims), "centroid-vectors")
    ranked = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(ranked.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame(
            [],
            "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
        )
    centres = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree.build(centres))
        found: dict[int, dict[int, int]] = {}
        for number, part, total in _sums(rows, tree, dims).collect():  # at most k x (dims + 1)
            found.setdefault(number, {})[part] = int(total)
        tree.destroy()
        centres = centres.copy()
        for number, totals in found.items():
            centres[number] = [totals[part] // totals[-1] for part in range(dims)]

    tree = spark.sparkContext.broadcast(VantageTree.build(centres))
    assigned = materialize(_assigned(rows, tree, dims), "centroid-members")
    tree.destroy()
    # A null distance makes its sums null: they are beyond a long as well.
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertias = {n: None if own is None else int(own) for n, own in assigned.groupBy("cluster").agg(whole).collect()}
    inertia = None if None in inertias.values() else sum(inertias.values())

    def fits(total: int | None) -> int | None:
        return total if total is not None and total <= _MOST else None

    told = [
        (n, fits(own), fits(inertia), hashlib.sha256(",".join(map(str, centres[n].tolist())).encode()).hexdigest())
        for n, own in inertias.items()
    ]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
