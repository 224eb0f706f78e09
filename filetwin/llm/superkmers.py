"""Super-k-mers: consecutive windows that share a minimiser, as one segment.

Equal windows have equal minimisers at equal places, so whatever is to meet is found at one key. Before
segments travel, a first pass counts the minimisers alone and leaves a bitmap of fixed size (BITS) of those
that occur again; segments without such a minimiser stay home. Clashes in the bitmap let more segments
through and change no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
_CHUNK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_HELD = 1_000_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimiser and its place of each segment, for windows of `width` hashes."""
    count = len(hashes) - width + 1
    if count < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    parts = []
    for begin in range(0, count, _CHUNK):
        part = hashes[begin : begin + _CHUNK + width - 1]
        marked = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)  # ties go to the leftmost
        parts.append((sliding_min(marked, width) & _PLACE).astype(np.int64) + begin)
    place = np.concatenate(parts)
    starts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    counts = np.diff(np.concatenate((starts, [count])))
    place = place[starts]
    return starts, counts, hashes[place] >> np.uint64(20), place


def repeated_minimisers(docs: DataFrame, cut: Callable, repeated: Column) -> np.ndarray:
    """A bitmap of minimisers for which `repeated`, a condition on `lo`, `hi` (ids) and `n`, holds.

    `cut` makes, once a task, a function from a text to the text's segments.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, ids, size = cut(), [], [], 0

        def counts() -> pa.RecordBatch:
            keys, owners = np.concatenate(held), np.concatenate(ids)
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[first].astype(np.int64)),
                    pa.array(np.minimum.reduceat(owners, first)),
                    pa.array(np.maximum.reduceat(owners, first)),
                    pa.array(np.diff(np.concatenate((first, [len(keys)])))),
                ],
                ["key", "lo", "hi", "n"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = of(text)[2]
                if len(keys):
                    held.append(keys)
                    ids.append(np.full(len(keys), doc_id, np.int64))
                    size += len(keys)
                if size >= _HELD:
                    yield counts()
                    held, ids, size = [], [], 0
        if held:
            yield counts()

    rows = docs.select("doc_id", "text").mapInArrow(run, "key long, lo long, hi long, n long")
    again = rows.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where(repeated)
    return bitmap_of(again)


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """The bits of the column `key`: BITS bits, whatever the number of keys."""
    bit = F.col("key").bitwiseAND(F.lit(BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = (
        keys.select(F.call_function("shiftright", bit, F.lit(6)).alias("word"), one.alias("bits"))
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    out = np.zeros(BITS // 64, np.int64)  # at most BITS / 64 rows were fetched
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def known(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(BITS - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def whole_keys(batches: Iterable[pa.RecordBatch], least: int = 1) -> Iterator[pa.Table]:
    """Tables of at least `least` rows (but for the last) in which every key of column 0 is complete.

    The batches are sorted by key.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows < least:
            continue
        keys = rest.column(0).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if len(change):
            yield rest.slice(0, int(change[-1]) + 1)
            rest = rest.slice(int(change[-1]) + 1)
    if rest is not None and rest.num_rows:
        yield rest


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its values."""
    array = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
