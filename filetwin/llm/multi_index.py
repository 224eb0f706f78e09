"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut in two halves and each half is quantised by its own k-means centroids, fitted on a
bounded sample (`sample_rows`). A row's cell is its pair of centroids; the index is a written table of all
rows. A query walks pairs of centroids by the sum of their distances, with a heap over the two sorted
lists, until the cells it has met hold `visit` of all rows (at least `min_visit` rows). Rows of those cells
are reranked by the exact cosine.

Cells are cut into blocks of about BLOCK rows, so copies of one vector don't meet in one task, and blocks are dealt to
groups of about GROUP rows. A query goes once to every group that holds rows of its cells, with its list of cells, and is
streamed past the group's rows; rows of other cells are not looked at. The number of centroids follows the number of
rows; the table of cell sizes is bounded by MAX_CENTROIDS squared.

Components are scaled by a power of two before they are multiplied, so large and small finite vectors keep their exact cosines.
Vectors that are null, zero, not finite, or not of the most frequent length take no part. Rows that share a
`vec_id` are never each other's neighbours and count once, with the best score. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow_map

BLOCK = 4096
GROUP = 32_768
MAX_CENTROIDS = 1024
ROWS_PER_CELL = 20
SAMPLE_BYTES = 64 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, as `vec_id` and `vector` (float array)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.coalesce(finite, F.lit(False)))
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vector") == sizes[0]["size"]) if sizes else rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: no product overflows, no digit changes."""
    _, exponent = np.frexp(np.abs(matrix).max(axis=1, keepdims=True))
    return np.ldexp(matrix, -exponent)


def _kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    dice = np.random.default_rng(3)
    distinct = np.unique(points, axis=0)
    centroids = distinct[dice.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        nearest = _distances(points, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centroids))
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    return centroids


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)[None]


def nearest_cells(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Non-empty cells by summed distance of their centroids until they hold `wanted` rows."""
    order_a, order_b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[order_a], second[order_b]
    heap, seen, out, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(order_a[i]) * len(second) + int(order_b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return out


def _group(cell, block, groups: int):
    """The group of a block of a cell, alike for columns and arrays: a cell's blocks go to different groups."""
    return (cell * 7919 + block) % groups


def _best(queries, query_ids, cells, rows, row_ids, row_cells, k):
    """The k best rows of a group for each query among those of its cells: exact cosines, ties to smaller ids."""
    near = _unit(queries) @ _unit(rows).T
    near[query_ids[:, None] == row_ids[None]] = -np.inf
    there, place = np.unique(row_cells, return_inverse=True)
    visited = np.zeros((len(queries), len(there)), bool)
    for q, own in enumerate(cells):
        found = np.searchsorted(there, own)
        found[found == len(there)] = 0
        visited[q, found[there[found] == own]] = True
    near[~visited[:, place]] = -np.inf
    queries, rows = _scaled(queries), _scaled(rows)
    lengths = np.sqrt((rows * rows).sum(axis=1))
    for q in range(len(queries)):
        line = near[q]
        floor = np.partition(line, -k)[-k] if len(line) > k else -np.inf
        found = np.flatnonzero((line >= floor - 1e-9) & (line > -np.inf))
        own = queries[q]
        scores = (rows[found] * own).sum(axis=1) / (lengths[found] * np.sqrt((own * own).sum()))
        top = np.lexsort((row_ids[found], -scores))[:k]
        yield from ((int(query_ids[q]), int(row_ids[found][t]), float(scores[t])) for t in top)


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, visit: float = 0.5, min_visit: int = 2000, sample_rows: int = 20_000
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k nearest rows found for each query row of `vectors`."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialize(usable(vectors), "index-rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    size = rows.select(F.size("vector")).first()[0]
    half = size // 2
    sample_rows = max(256, min(sample_rows, SAMPLE_BYTES // (8 * size)))
    steps = 1 << 30
    sampled = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(steps)) < max(1, steps * sample_rows // total))
    points = np.array([r[0] for r in sampled.select("vector").collect()], float).reshape(-1, size)
    if not len(points):
        points = np.array([r[0] for r in rows.select("vector").limit(256).collect()], float)
    points = _unit(points)
    count = min(MAX_CENTROIDS, max(2, math.ceil(math.sqrt(total / ROWS_PER_CELL))))
    books = spark.sparkContext.broadcast((_kmeans(points[:, :half], count), _kmeans(points[:, half:], count)))
    width = len(books.value[1])

    def assign():
        first, second = books.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            matrix = _matrix(batch.column("vector"))
            unit = _unit(matrix)
            cell = _distances(unit[:, :half], first).argmin(axis=1) * width + _distances(unit[:, half:], second).argmin(axis=1)
            return batch.append_column("cell", pa.array(cell, pa.int32()))

        return step

    index = materialize(arrow_map(rows, assign, "vec_id long, vector array<double>, cell int"), "index-cells")
    counts = index.groupBy("cell").count()
    sizes = np.zeros(len(books.value[0]) * width, np.int64)
    for cell, n in counts.collect():  # at most MAX_CENTROIDS squared
        sizes[cell] = n
    shared = spark.sparkContext.broadcast(sizes)
    wanted = max(min_visit, math.ceil(visit * total))

    groups = max(1, math.ceil(total / GROUP))

    def probe():
        first, second = books.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            unit = _unit(_matrix(batch.column("vector")))
            a, b = _distances(unit[:, :half], first), _distances(unit[:, half:], second)
            source, homes, lists = [], [], []
            for q in range(len(unit)):
                cells = np.array(nearest_cells(a[q], b[q], shared.value, wanted), np.int64)
                # All blocks of all cells, and then the cells of each group.
                blocks = -(-shared.value[cells] // BLOCK)
                block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                cells = np.repeat(cells, blocks)
                pairs = np.unique(np.stack((_group(cells, block, groups), cells), axis=1), axis=0)
                starts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
                for home, own in zip(pairs[starts, 0].tolist(), np.split(pairs[:, 1], starts[1:]), strict=True):
                    source.append(q)
                    homes.append(home)
                    lists.append(own)
            sent = batch.take(pa.array(source, pa.int64()))
            sent = sent.append_column("group", pa.array(homes, pa.int64()))
            return sent.append_column("cells", pa.array(lists, pa.list_(pa.int64())))

        return step

    asked = rows.where(is_query)
    sent = arrow_map(asked, probe, "vec_id long, vector array<double>, group long, cells array<long>")
    sent = sent.withColumn("asks", F.lit(1))
    blocks = counts.select("cell", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    stored = index.join(blocks, "cell").select(
        "vec_id",
        "vector",
        _group(F.col("cell").cast("long"), block, groups).alias("group"),
        F.array(F.col("cell").cast("long")).alias("cells"),
        F.lit(0).alias("asks"),
    )

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, asks, vec = (batch.column(c).to_numpy() for c in ("group", "asks", "vec_id"))
            matrix, cells = _matrix(batch.column("vector")), batch.column("cells")
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            edges = [0, *change.tolist(), len(keys)]
            out = []
            for begin, end in zip(edges, edges[1:], strict=False):
                if key != keys[begin]:
                    key, held = keys[begin], []
                own = cells.slice(begin, end - begin)
                if not asks[begin]:
                    held.append((matrix[begin:end], vec[begin:end], own.flatten().to_numpy()))
                elif held:
                    held = [tuple(np.concatenate(parts) for parts in zip(*held, strict=True))]
                    for at in range(begin, end, 256):
                        upto = min(end, at + 256)
                        lists = [np.asarray(c) for c in cells.slice(at, upto - at).to_pylist()]
                        out.extend(_best(matrix[at:upto], vec[at:upto], lists, *held[0], k))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"]
                )

    found = (
        stored.unionByName(sent)
        .repartition("group")
        .sortWithinPartitions("group", "asks")
        .mapInArrow(rerank, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
