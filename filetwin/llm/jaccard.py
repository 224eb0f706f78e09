"""Exact Jaccard self-join of documents' word shingles, as components and links.

A document's set holds the hashes of its distinct runs of `width` lower-cased words (all words, if there
are fewer). Documents link when |A and B| / |A or B| >= percent / 100, computed in whole numbers.

1. Sets. Rows of one task with equal sets are tied to the first of them, which alone is a node.
2. Tiles. Linked sets share one of their first |A| - ceil(percent |A| / 100) + 1 shingles in any common
   order. The order puts first those of the lowest COUNTED part of all hashes that only one set has, puts
   last those frequent in some task's rows, and goes by hash otherwise. So sets post their counted shingles
   and, once shingles of a single set are gone, drop as many of their last as they posted too many: a set
   without near copies mostly keeps none. A tile is a shingle that is left and a size band: sizes that may
   link differ by one band at most.
3. Hubs. Each member of a tile is paired with the smallest id of its band and of the band below, so a group
   of N near copies gives some N pairs, not N squared. Members are sorted by shingle once, and pairs are read off that order. The most promising pair of each member is settled
   first. What links is one component from now on; other pairs are settled if their ends are still apart.
4. Leftovers. Tiles with members of several components are cut into blocks of at most BLOCK members and
   pairs of blocks are dealt out; members of different components are compared by bitmap. Of two components
   with more than FEW promising pairs in a tile, the best pair is settled first, and then, with the components
   that result, all that are left. No pair that could join two components stays unseen: components are exact.
5. Bitmaps have two bits an element or more; a bit tells whether an odd number of elements hash to it. Common
   elements cancel out in the difference of two bitmaps, and each bit that differs stands for an element that
   only one set has, so bit counts bound the overlap from above, and closely: only elements in which the sets differ can hide
   one another. Pairs that pass have their sorted arrays intersected, rebuilt from the texts.

`frequent` shingles only steer the order: they are a bounded list (MAX_FREQUENT) and leaving some out
changes cost, not results. Shingles are compared by 64-bit hashes. Null or blank texts have no shingles and
link with nothing. Rows that share a `doc_id` are one node but stay rows of their own; rows without a
`doc_id` link with nothing and get no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import discard, materialize
from .common import arrow_map, arrow_runs, key_bits, key_groups, may_hold, mix, rolling
from .components import connected

MAX_FREQUENT = 200_000
COUNTED = 0.28
BLOCK = 1024
FEW = 4
_LOCAL_FREQUENT = 4
_FREQUENT = 16
_COUNTED_AT_ONCE = 2_000_000
_SETS_AT_ONCE = 100_000


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
EXACT = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE = EXACT.copy()
_BYTE[65:91] = _BYTE[97:123]
_SHORT = 1024


def _places(count: int) -> np.ndarray:
    return mix(np.arange(1000, 1000 + count, dtype=np.uint64))


_PLACE = _places(_SHORT)


def word_hashes(text: str | None, marks: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' marks, weighted by their places in the word. A-Z count as a-z, but not with EXACT."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.flatnonzero(~_SPACE[raw])
    if not len(inside):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    lengths = np.diff(starts, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    weights = (_PLACE if longest <= _SHORT else _places(longest))[place]
    return mix(np.add.reduceat(marks[raw[inside]] * weights, starts) + lengths.astype(np.uint64))


class Shingler:
    def __init__(self, width: int) -> None:
        self.width = width

    def runs(self, text: str | None) -> np.ndarray:
        """The shingle hashes of a text as they come."""
        hashes = word_hashes(text)
        if not len(hashes):
            return hashes
        if len(hashes) < self.width:
            return mix(rolling(hashes, len(hashes)) + np.uint64(len(hashes)))
        return rolling(hashes, self.width)

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        return np.unique(self.runs(text))


def bitmap(values: np.ndarray) -> np.ndarray:
    """The parity of hashed elements per bit, in 64-bit words; the length is a power of two."""
    bits = max(64, 1 << (2 * len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _folded(marks: np.ndarray, words: int) -> np.ndarray:
    while len(marks) > words:
        half = len(marks) // 2
        marks = marks[:half] ^ marks[half:]
    return marks


def overlap_bound(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """An upper bound of the overlap of two sets from their bitmaps."""
    words = min(len(a), len(b))
    differ = int(np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum())
    return (n_a + n_b - differ) // 2


def _band(n: int, percent: int) -> int:
    return int(math.log(n) / math.log(100 / percent) + 1e-9) if percent < 100 else n


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that many sets share, as far as single tasks can tell: a bounded list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size, seen = Shingler(width), [], 0, set()

        def counts() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= _LOCAL_FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many])], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                values = shingles.runs(text)
                digest = hash(values.tobytes())
                if len(values) and digest not in seen:
                    if len(seen) >= _SETS_AT_ONCE:
                        seen.clear()
                    seen.add(digest)
                    held.append(values)
                    size += len(values)
                if size >= _COUNTED_AT_ONCE:
                    yield counts()
                    held, size, seen = [], 0, set()
        if held:
            yield counts()

    local = arrow_runs(docs.select("text"), run, "token long, n long")
    top = (
        local.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= _FREQUENT)
        .orderBy(F.desc("n"), "token").limit(MAX_FREQUENT)
    )
    return np.sort(np.array([r[0] for r in top.select("token").collect()], np.int64).view(np.uint64))


_DOC = "struct<n: long, tied_to: long, marks: binary, sure: array<long>, spare: long>"


def _prepared(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of documents and the postings that others share, in one table: `key`, `doc_id`, `band`, `doc`.

    A document's `doc` has its set's size, the row it is tied to, and for nodes the bitmap, the surplus and
    the `sure` shingles of its prefix, which are known to be frequent. Rows without `doc` are postings of the
    others: `key` is the shingle; they are dealt by it and stay if their neighbours by shingle have it too.
    No frequent shingle is dealt, so none brings many rows to a task.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))
    doc_type = pa.struct(
        {"n": pa.int64(), "tied_to": pa.int64(), "marks": pa.binary(), "sure": pa.list_(pa.int64()), "spare": pa.int64()}
    )
    # Below half of the range, so that signed and unsigned order agree for counted shingles.
    counted = np.uint64(int(COUNTED * 2**64))

    def make():
        shingles, first, known = Shingler(width), {}, frequent.value
        task, done = TaskContext.get().partitionId() << 32, 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal done
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, posted, owners, bands = [], [], [], []
            for doc_id, text in zip(ids, texts, strict=True):
                values = shingles(text)
                n = len(values)
                if not n or doc_id is None:
                    rows.append({"n": n})
                    continue
                digest = (n, int(values.sum()), int(np.bitwise_xor.reduce(mix(values))))
                if len(first) >= _SETS_AT_ONCE:
                    first.clear()  # later rows with an equal set meet the earlier ones in the tiles
                node = first.setdefault(digest, doc_id)
                if node != doc_id:
                    rows.append({"n": n, "tied_to": node})
                    continue
                length = n - (percent * n + 99) // 100 + 1
                often = values[:0]
                if len(known):
                    found = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
                    values_left, often = values[~found], values[found]
                else:
                    values_left = values
                spare = max(0, int(np.searchsorted(values_left, counted)) - length)
                prefix = values_left[: length + spare]
                sure = often[: max(0, length - len(prefix))].view(np.int64)
                rows.append({"n": n, "marks": bitmap(values).tobytes(), "sure": sure, "spare": spare})
                posted.append(prefix.view(np.int64))
                owners.append(np.full(len(prefix), doc_id, np.int64))
                bands.append(np.full(len(prefix), _band(n, percent), np.int32))
            # A document's own row goes to any task, the same one whenever it is computed.
            own = mix(np.arange(task + done, task + done + len(ids), dtype=np.uint64)).view(np.int64)
            done += len(ids)
            count = sum(map(len, posted))
            columns = [
                pa.array(np.concatenate((own, *posted))),
                pa.concat_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate((own[:0], *owners)))]),
                pa.concat_arrays([pa.nulls(len(ids), pa.int32()), pa.array(np.concatenate((np.zeros(0, np.int32), *bands)))]),
                pa.concat_arrays([pa.array(rows, doc_type), pa.nulls(count, doc_type)]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "band", "doc"])

        return step

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        before: int | None = None

        def kept(table: pa.Table, after: int | None) -> pa.Table:
            key = table.column("key").to_numpy()
            same = key[1:] == key[:-1]
            first, last = key[0] == before, key[-1] == after
            return table.filter(pa.array(np.append(first, same) | np.append(same, last)))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            posting = pc.is_valid(table.column("band"))
            yield from table.filter(pc.invert(posting)).to_batches()
            table = table.filter(posting)
            if not table.num_rows:
                continue
            if held is not None:
                yield from kept(held, table.column("key")[0].as_py()).to_batches()
                before = held.column("key")[-1].as_py()
            held = table
        if held is not None:
            yield from kept(held, None).to_batches()

    source = docs.select(F.col("doc_id").cast("long"), "text")
    schema = f"key long, doc_id long, band int, doc {_DOC}"
    dealt = arrow_map(source, make, schema).repartition("key").sortWithinPartitions("key")
    return materialize(arrow_runs(dealt, shared, schema), "jaccard-sets")


def _members(prepared: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The tiles' members, a row for the `tokens` of one `doc_id` and `band`: a list takes half the room of a row for each."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    sure = rows.where(F.size("sure") > 0).select(F.col("sure").alias("tokens"), "doc_id", band.cast("int").alias("band"))
    postings = prepared.where(F.col("band").isNotNull()).select(F.col("key").alias("token"), "doc_id", "band")
    # Rows that share a `doc_id` can't be told apart here; their surplus stays, which is never wrong.
    spare = (
        rows.where(F.col("marks").isNotNull()).groupBy("doc_id")
        .agg(F.when(F.count(F.lit(1)) == 1, F.max("spare")).otherwise(0).alias("spare"))
    )
    # A row that posted a surplus posted counted shingles alone; those that are shared go by hash.
    kept = F.slice(F.sort_array("tokens"), F.lit(1), F.greatest(F.lit(0), F.size("tokens") - F.col("spare")).cast("int"))
    return (
        postings.groupBy("doc_id", "band").agg(F.collect_set("token").alias("tokens"))
        .join(spare, "doc_id").select(kept.alias("tokens"), "doc_id", "band").where(F.size("tokens") > 0)
        .unionByName(sure)
    )


def _hub_pairs(sets: DataFrame) -> DataFrame:
    """Each member with the smallest id of its tile's band, and of the band below: `a`, `b`, other than itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # token, band and hub of the last run of rows, whether there is a band below, its hub
        for batch in batches:
            if not batch.num_rows:
                continue
            token, band, doc = (batch.column(c).to_numpy() for c in ("token", "band", "doc_id"))
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (band[1:] != band[:-1])))
            t, b, hub = token[new], band[new], doc[new].copy()
            has, below = np.zeros(len(t), bool), np.zeros(len(t), np.int64)
            if last and last[0] == t[0] and last[1] == b[0]:
                hub[0], has[0], below[0] = last[2:]
            elif last and last[0] == t[0] and last[1] == b[0] - 1:
                has[0], below[0] = True, last[2]
            has[1:] = (t[1:] == t[:-1]) & (b[1:] == b[:-1] + 1)
            below[1:] = hub[:-1]
            last = (t[-1], b[-1], hub[-1], has[-1], below[-1])
            run_of = np.cumsum(new) - 1
            lower = has[run_of]
            x = np.concatenate((hub[run_of], below[run_of][lower]))
            y = np.concatenate((doc, doc[lower]))
            other = x != y
            x, y = x[other], y[other]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    rows = sets.select(F.explode("tokens").alias("token"), "doc_id", "band")
    rows = rows.repartition("token").sortWithinPartitions("token", "band", "doc_id")
    return arrow_runs(rows, run, "a long, b long").distinct()


def _passing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps allow a link."""
    side = lambda end: nodes.select(
        F.col("doc_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("marks").alias(f"marks_{end}")
    )
    sizes_allow = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes_allow)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_a, n_b, marks_a, marks_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "marks_a", "marks_b"))
            keep, share = [], []
            for x, y, p, q in zip(n_a, n_b, marks_a, marks_b, strict=True):
                bound = overlap_bound(np.frombuffer(p, np.uint64), x, np.frombuffer(q, np.uint64), y)
                keep.append((100 + percent) * bound >= percent * (x + y))
                share.append(bound / (x + y))
            table = batch.select(["a", "b"]).append_column("share", pa.array(share, pa.float64()))
            return table.filter(pa.array(keep, pa.bool_()))

        return step

    return arrow_map(joined.select("a", "b", "n_a", "n_b", "marks_a", "marks_b"), make, "a long, b long, share double")


class _Texts:
    """Texts of documents that occur in pairs, fetched once each into the shared folder."""

    def __init__(self, docs: DataFrame, nodes: DataFrame) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long"), "text")
        self.table: DataFrame | None = None
        repeated = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id")
        self.repeated = materialize(repeated, "jaccard-repeated")
        self.any_repeated = not self.repeated.isEmpty()

    def of(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        if self.table is not None:
            wanted = wanted.join(self.table.select("doc_id"), "doc_id", "left_anti")
        wanted = materialize(wanted, "jaccard-candidates")
        found = self.docs.join(wanted, "doc_id", "left_semi")
        if self.any_repeated:
            # Only rows that share a `doc_id` can be equal.
            found = found.join(self.repeated, "doc_id", "left_anti").unionByName(
                found.join(self.repeated, "doc_id", "left_semi").distinct()
            )
        fetched = materialize(found, "jaccard-texts")
        self.table = fetched if self.table is None else self.table.unionByName(fetched)
        return self.table


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose sets do reach the similarity: each pair meets the texts of its two ends in one task."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    met = (
        ends.join(texts, "doc_id").select("a", "b", "doc_id", "text")
        .repartition("a", "b").sortWithinPartitions("a", "b", "doc_id")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last = Shingler(width), {}

        def of(text: str) -> np.ndarray:
            if text not in last:
                if len(last) >= 64:
                    last.clear()
                last[text] = shingles(text)
            return last[text]

        def similar(x: np.ndarray, y: np.ndarray) -> bool:
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both > 0 and (100 + percent) * both >= percent * (len(x) + len(y))

        for group in key_groups(batches, 2):
            a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
            of_a, of_b = [], []
            for doc_id, text in zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), strict=True):
                (of_a if doc_id == a else of_b).append(of(text))
            if any(similar(x, y) for x in of_a for y in of_b):
                yield pa.RecordBatch.from_pydict({"a": pa.array([a], pa.int64()), "b": pa.array([b], pa.int64())})

    return materialize(arrow_runs(met, run, "a long, b long"), "jaccard-links")


def _leftover_pairs(sets: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, few: int | None):
    """Pairs of different components in one tile that their bitmaps allow: `a`, `b`, `token`, `more`.

    Where two components of a tile have more than `few` such pairs, only the most promising one is given,
    with `more` set.
    """
    own_component = F.coalesce("component", "doc_id").alias("component")
    labelled_sets = sets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled_sets = materialize(labelled_sets.select("tokens", "doc_id", own_component, "band"), "jaccard-labelled")
    labelled = labelled_sets.select(F.explode("tokens").alias("token"), "doc_id", "component", "band")
    # Most shingles have members of one component only, and are done with: only the others' rows are shuffled.
    ends = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_tokens = materialize(ends.where(F.col("low") != F.col("high")).select("token"), "jaccard-open-tokens")
    near_open = labelled.where(may_hold(key_bits(open_tokens, "token"), "token"))
    labelled = materialize(near_open.join(open_tokens, "token", "left_semi"), "jaccard-open")
    discard(labelled_sets)
    # A tile of a band holds the band's own members and, to compare with them, those of the band below.
    labelled = labelled.withColumn("tile", F.explode(F.array("band", F.col("band") + 1)))
    mark = F.xxhash64("doc_id", "band")
    open_tiles = (
        labelled.groupBy("token", "tile")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.max("band").alias("top"),
            F.bit_xor(mark).alias("x"),
            F.sum(mark.cast("decimal(38,0)")).alias("y"),
        )
        # Two members have met already, one of them being the hub.
        .where((F.col("low") != F.col("high")) & (F.col("size") >= 3) & (F.col("top") == F.col("tile")))
        # A passage gives many tiles with the same members; one of them will do.
        .groupBy("tile", "size", "x", "y")
        .agg(F.min("token").alias("token"))
        .select("token", "tile", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = (
        labelled.join(open_tiles, ["token", "tile"])
        .withColumn("block", block)
        .withColumn("other", other)
        .withColumn("own", (F.col("band") == F.col("tile")).cast("int"))
        .withColumn("p", F.least("block", "other"))
        .withColumn("q", F.greatest("block", "other"))
        .join(nodes.select("doc_id", "n", "marks"), "doc_id")
        .select("token", "tile", "p", "q", "block", "own", "doc_id", "component", "n", "marks")
        .repartition("token", "tile", "p", "q")
        .sortWithinPartitions("token", "tile", "p", "q", "n")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, 4):
            if group.num_rows < 2:
                continue
            p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
            block, own, ids, component, n = (
                group.column(c).to_numpy() for c in ("block", "own", "doc_id", "component", "n")
            )
            if component.min() == component.max():
                continue
            marks = [np.frombuffer(m, np.uint64) for m in group.column("marks").to_pylist()]
            # Within a group sizes ascend, so a row's candidates are the next rows of up to its size's share.
            upto = np.searchsorted(n * percent, n * 100, side="right")
            token = int(group.column("token")[0].as_py())
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            found: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for i in range(len(ids)):
                near = np.arange(i + 1, upto[i])
                near = near[(component[near] != component[i]) & (own[near] | own[i] > 0)]
                if p != q:
                    near = near[block[near] != block[i]]
                by_width: dict[int, list[int]] = {}
                for j in near.tolist():
                    by_width.setdefault(len(marks[j]), []).append(j)
                for words, places in by_width.items():
                    words = min(words, len(marks[i]))
                    mine = _folded(marks[i], words)
                    for begin in range(0, len(places), 256):
                        part = places[begin : begin + 256]
                        table = np.stack([_folded(marks[j], words) for j in part])
                        bound = (n[i] + n[part] - np.bitwise_count(table ^ mine).sum(axis=1)) // 2
                        good = (100 + percent) * bound >= percent * (n[i] + n[part])
                        for j, b in zip(np.asarray(part)[good].tolist(), bound[good].tolist(), strict=True):
                            x, y = sorted((int(ids[i]), int(ids[j])))
                            key = tuple(sorted((int(component[i]), int(component[j]))))
                            best[key] = max(best.get(key, (-1, 0, 0)), (int(b), x, y))
                            own_pairs = found.setdefault(key, [])
                            if few is None or len(own_pairs) <= few:
                                own_pairs.append((x, y))
            out = []
            for key, own_pairs in found.items():
                more = few is not None and len(own_pairs) > few
                out.extend((x, y, token, more) for x, y in ([best[key][1:]] if more else own_pairs))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "token", "more"]
                )

    return arrow_runs(rows, run, "a long, b long, token long, more boolean")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (`doc_id`, `text`): `doc_id`, `n_shingles`, `component_id`."""
    rows, labels = _components(docs.select("doc_id", "text"), width, percent)
    return rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    prepared = _prepared(docs, width, percent)
    rows = prepared.where(F.col("doc").isNotNull()).select("doc_id", "doc.*")
    nodes = rows.where(F.col("marks").isNotNull()).select("doc_id", "n", "marks")
    ties = rows.where(F.col("tied_to").isNotNull()).select(F.col("doc_id").alias("a"), F.col("tied_to").alias("b"))
    sets = materialize(_members(prepared, rows, percent), "jaccard-members")

    pairs = _hub_pairs(sets)
    checked = materialize(_passing(pairs, nodes, percent), "jaccard-pairs")
    texts = _Texts(docs, nodes)
    held = texts.of(checked)

    # Each node's most promising hub first; other hubs only where that leaves two components.
    nearest = checked.groupBy("b").agg(F.max(F.struct("share", "a"))["a"].alias("a"))
    edges = ties.unionByName(_linked(nearest, held, width, percent))
    labels = materialize(connected(edges), "jaccard-labels")
    others = materialize(_apart(checked, labels).join(nearest, ["a", "b"], "left_anti"), "jaccard-pairs")
    edges, labels = _joined_by(others, held, edges, labels, width, percent)

    for few in (FEW, None):
        left = materialize(_leftover_pairs(sets, labels, nodes, percent, few), "jaccard-pairs")
        new = left.select("a", "b").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
        new = materialize(new, "jaccard-pairs")
        checked = checked.select("a", "b").unionByName(new)
        edges, labels = _joined_by(new, texts.of(new), edges, labels, width, percent)
        # Only tiles that held back pairs are looked at again, with the components as they are now.
        again = left.where("more").select("token").distinct()
        if again.isEmpty():
            break
        held_back = sets.select(F.explode("tokens").alias("token"), "doc_id", "band").join(again, "token", "left_semi")
        sets = held_back.groupBy("doc_id", "band").agg(F.collect_list("token").alias("tokens"))
    return rows, labels


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    component = lambda end: F.coalesce(f"c_{end}", end)
    return (
        pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
        .where(component("a") != component("b")).select("a", "b")
    )


def _joined_by(pairs: DataFrame, texts: DataFrame, edges: DataFrame, labels: DataFrame, width: int, percent: int):
    """Edges and labels with the links among `pairs`."""
    if pairs.isEmpty():
        return edges, labels
    found = _linked(pairs, texts, width, percent)
    if found.isEmpty():
        return edges, labels
    edges = edges.unionByName(found)
    return edges, materialize(connected(edges), "jaccard-labels")


def keep_first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest `doc_id`.

    Rows without a `doc_id` all stay. Rows that share a `doc_id` are judged by their own texts: of equal texts one row stays, the
    smallest by its other columns, and of different ones those that nothing kept is linked with.
    """
    text = F.xxhash64("text")
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.min(text).alias("_first"))
    repeated = materialize(ids.where(F.col("_rows") > 1).select("doc_id", "_first"), "jaccard-repeated")
    number = F.col("doc_id").cast("long")
    # Further texts of an id get numbers of their own, behind all usual ids.
    own = F.shiftrightunsigned(F.xxhash64("doc_id", text, F.lit("row")), 2).bitwiseOR(F.lit(1 << 62))
    node = F.when(F.col("_first").isNull() | (F.col("_first") == text), number).otherwise(own)
    keyed = lookup(docs, repeated, ["doc_id"], "left", spread="text", measure=False).withColumn("_node", node)

    _, labels = _components(keyed.select(F.col("_node").alias("doc_id"), "text"), width, percent)
    others = labels.where(F.col("node") != F.col("component")).select(F.col("node").alias("_node"))
    # Most rows are dropped by nobody: their texts are not shuffled to find that out.
    others = materialize(others, "jaccard-others")
    bits = key_bits(others, "_node")
    left = keyed.where(~may_hold(bits, "_node"))
    kept = left.unionByName(keyed.where(may_hold(bits, "_node")).join(others, "_node", "left_anti"))
    alone, several = kept.where(F.col("_first").isNull()), kept.where(F.col("_first").isNotNull())
    if repeated.isEmpty():
        return alone.select(*docs.columns)
    one = several.groupBy("_node").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_row")).select("_row.*")
    return alone.select(*docs.columns).unionByName(one)
