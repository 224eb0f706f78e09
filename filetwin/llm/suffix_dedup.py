"""Byte-level deduplication: every byte covered by a repeated string of `length` bytes goes.

A string is repeated when it starts at two places, in two documents or one. Matches stay within documents
and are judged on the input.

1. `superkmers` cuts texts (UTF-8) into segments by minimisers of K bytes, and only segments whose minimiser
   occurs again travel. A task sends equal segments once, with their number. A segment that occurs twice
   is repeated as a whole.
2. Other segments of a minimiser differ somewhere. A string that two of them share holds the minimiser at the
   same place, and so half of its other bytes or more on one side of it. Segments that agree with another
   on neither side so far are done with. The others are put, by minimiser, into shards of about SHARD
   bytes with marks between them, which are suffix-sorted by induced sorting (`suffix_array`). A string
   is repeated if and only if it shares `length` bytes with a neighbour in the suffix array, which the
   permuted common prefixes tell, place by place.
3. The runs of repeated starts go back to the segments' occurrences and from there to the documents.

Segments are told apart by 64-bit hashes, strings byte by byte. Null texts are empty. Rows are documents of
their own, whatever their `doc_id`, so a repeated row loses what its copy loses.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix
from .suffix_array import permuted_common_prefixes, suffix_array
from .superkmers import bytes_of, known, repeated_minimisers, segments, whole_keys

K = 32
SHARD = 1 << 21
_HELD = 200_000
_PIECE = 1 << 19


def _run_hashes(data: bytes) -> np.ndarray:
    """A hash of every run of K bytes."""
    # Of 8 bytes, then of 16 and of 32, each from two of half the size.
    out = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    for size, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        out = out[:-size] * np.uint64(factor) + out[size:]
        out ^= out >> np.uint64(29)
    return mix(out)


def _cutter(length: int):
    def make():
        def of(text: str | None):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            if len(data) < length:
                none = np.zeros(0, np.int64)
                return none, none, none.astype(np.uint64), none, data
            # Long texts piece by piece, so that memory stays a multiple of a piece.
            parts = []
            for begin in range(0, len(data) - length + 1, _PIECE):
                starts, counts, keys, places = segments(_run_hashes(data[begin : begin + _PIECE + length - 1]), length - K + 1)
                parts.append((starts + begin, counts, keys, places + begin))
            return *(np.concatenate(p) for p in zip(*parts, strict=True)), data

        return of

    return make


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"at": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _alike(segs: list[tuple[bytes, int]], length: int) -> list[bool]:
    """Which of a minimiser's segments, with its places, may share `length` bytes with another.

    The string holds the K bytes of the minimiser, and on one side of them half of the rest or more.
    """
    half = (length - K + 1) // 2
    sides = [
        [part[place - half : place + K] if place >= half else None for part, place in segs],
        [part[place : place + K + half] if len(part) >= place + K + half else None for part, place in segs],
    ]
    out = [False] * len(segs)
    for side in sides:
        times = Counter(side)
        out = [yes or (part is not None and times[part] > 1) for yes, part in zip(out, side, strict=True)]
    return out


def _verdicts(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Per distinct segment with repeated strings: the runs of their starts."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
    shard: list[tuple[int, np.ndarray, bool]] = []
    held = 0

    def sort_shard() -> pa.RecordBatch | None:
        nonlocal shard, held
        line = np.concatenate([np.append(data.astype(np.int16) + 1, np.int16(0)) for _, data, _ in shard])
        # Only starts with `length` bytes before their segment's end can repeat, and so can only their like.
        starts = np.concatenate([np.arange(len(data) + 1) <= len(data) - length for _, data, _ in shard])
        repeated = permuted_common_prefixes(line, suffix_array(line), length, starts) >= length
        out, at = [], 0
        for seg, data, whole in shard:
            flags = repeated[at : at + len(data) - length + 1]
            at += len(data) + 1
            if not whole and flags.any():
                out.append((seg, _runs(flags)))
        shard, held = [], 0
        return batch(out)

    def batch(rows: list) -> pa.RecordBatch | None:
        if not rows:
            return None
        segs, runs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(runs, kind)], ["seg", "runs"])

    for table in whole_keys(batches, 20_000):
        key, seg, n, place = (table.column(c).to_numpy() for c in ("key", "seg", "n", "place"))
        data, offsets = bytes_of(table.column("packed"))
        distinct, first, inverse = np.unique(seg, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=n) >= 2
        rows = [
            (int(s), [{"at": 0, "n": int(offsets[f + 1] - offsets[f] - length + 1)}])
            for s, f in zip(distinct[total], first[total], strict=True)
        ]
        if found := batch(rows):
            yield found
        # Segments of a minimiser that has several, where one at least isn't settled.
        order = np.argsort(key[first], kind="stable")
        keys, firsts, whole = key[first][order], first[order], total[order]
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if end - begin < 2 or whole[begin:end].all():
                continue
            alike = _alike([(data[offsets[f] : offsets[f + 1]].tobytes(), int(place[f])) for f in firsts[begin:end]], length)
            if whole[begin:end][alike].all():
                continue
            for f, settled in zip(firsts[begin:end][alike], whole[begin:end][alike], strict=True):
                shard.append((int(seg[f]), data[offsets[f] : offsets[f + 1]], bool(settled)))
                held += int(offsets[f + 1] - offsets[f])
            if held >= SHARD:
                if found := sort_shard():
                    yield found
    if shard and (found := sort_shard()):
        yield found


def drop_repeated_strings(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `kept` (bytes that are left)."""
    if length < K:
        raise ValueError(f"length is at least {K}")
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row"))
    named = docs.where(F.col("text").isNotNull())
    cut = _cutter(length)
    owners = named.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_minimisers(owners, cut, F.col("n") >= 2))

    def walk(text, of):
        starts, counts, keys, places, data = of(text)
        if len(keys):
            for k in np.flatnonzero(known(bitmap.value, keys)).tolist():
                start, count = int(starts[k]), int(counts[k])
                part = data[start : start + count + length - 1]
                yield int(keys[k]), xxhash.xxh64_intdigest(part) - (1 << 63), start, int(places[k]) - start, part

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = cut(), {}

        def flush() -> pa.RecordBatch:
            rows = [(key, seg, n, place, part) for seg, (key, n, place, part) in held.items()]
            held.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "seg", "n", "place", "packed"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for key, seg, _, place, part in walk(text, of):
                    old = held.get(seg)
                    held[seg] = (key, old[1] + 1 if old else 1, place, part)
                if len(held) >= _HELD:
                    yield flush()
        if held:
            yield flush()

    verdicts = (
        named.select("text")
        .mapInArrow(send, "key long, seg long, n long, place int, packed binary")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda batches: _verdicts(batches, length), "seg long, runs array<struct<at:int,n:int>>")
    )

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = cut()
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.extend((seg, row, start) for _, seg, start, _, _ in walk(text, of))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seg", "row", "start"]
                )

    placed = named.select("row", "text").mapInArrow(occurrences, "seg long, row long, start int")
    flags = (
        placed.join(verdicts, "seg")
        .select("row", F.explode("runs").alias("run"), "start")
        .groupBy("row")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("run.at")).alias("at"), F.col("run.n").alias("n"))).alias("flags"))
    )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, flagged in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                kept, spans = data, 0
                if flagged:
                    edge = np.zeros(len(data) + 1, np.int64)
                    at = np.array([f["at"] for f in flagged])
                    n = np.array([f["n"] for f in flagged])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*out, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return step

    joined = docs.join(flags, "row", "left").select("doc_id", "text", "flags")
    return arrow_map(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
