"""Substring deduplication by super-k-mer partitioning of word windows.

A window is `width` consecutive words of one document. A word goes if a window that covers it starts in a
document with a smaller id, too. Windows are judged on the input.

1. Windows' minimisers are hashes of RUN words; `superkmers` cuts the documents into segments.
2. A segment travels to its minimiser's bucket as one packed string (six bytes of hash a word). A task sends
   equal segments once, with the smallest and largest id that has them, so copies don't pile up.
3. In a bucket, sorting the windows gives each window's smallest document exactly, whatever segment it is in.
4. Bitmaps of fixed size say which segments have a repeated window and then which documents lose words. Only these
   segments' occurrences are joined to the verdicts, and only these documents' texts to their flagged windows;
   all others are answered where they are read.

Words are compared by 48-bit hashes, windows by all their words' hashes. Null texts have no words. Rows of one
`doc_id` are the same document for the comparison and rows of their own for the result, told apart by their id and a
64-bit hash of the text; rows without a `doc_id` neither lose words nor make others lose any. An empty table gives no
rows, and columns other than `doc_id` and `text` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow_map, mix, rolling, words_of
from .jaccard import EXACT, word_hashes
from .superkmers import bitmap_of, bytes_of, known, repeated_minimisers, segments, whole_keys

RUN = 3
_HELD = 300_000


def _cutter(width: int):
    def make():
        def of(text: str | None):
            words = word_hashes(text, EXACT) & np.uint64((1 << 48) - 1)
            if len(words) < width:
                none = np.zeros(0, np.int64)
                return none, none, none.astype(np.uint64), words
            return *segments(rolling(words, RUN), width - RUN + 1)[:3], words

        return of

    return make


def _verdicts(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per distinct segment with a repeated window: the smallest document of each of its windows."""
    for table in whole_keys(batches, 20_000):
        seg, lo, hi = (table.column(c).to_numpy() for c in ("seg", "lo", "hi"))
        data, offsets = bytes_of(table.column("packed"))
        words = np.zeros((len(data) // 6, 8), np.uint8)
        words[:, :6] = data.reshape(-1, 6)
        words, edges = words.reshape(-1).view(np.uint64), offsets // 6
        sizes = np.diff(edges) - width + 1
        first = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(first[-1]) - np.repeat(first[:-1], sizes) + np.repeat(edges[:-1], sizes)
        # Hashing a second time with other constants makes 128 bits a window.
        one, two = rolling(words, width)[at], rolling(mix(words + np.uint64(1)), width)[at]
        row = np.repeat(np.arange(len(seg)), sizes)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        start = np.concatenate(([0], np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1))
        low = np.minimum.reduceat(lo[row[order]], start)
        high = np.maximum.reduceat(hi[row[order]], start)
        lengths = np.diff(np.concatenate((start, [len(one)])))
        mins, again = np.empty(len(one), np.int64), np.empty(len(one), bool)
        mins[order], again[order] = np.repeat(low, lengths), np.repeat(low < high, lengths)
        wanted = np.logical_or.reduceat(again, first[:-1])
        _, unique = np.unique(seg, return_index=True)
        chosen = unique[wanted[unique]]
        if len(chosen):
            least, most = np.minimum.reduceat(mins, first[:-1]), np.maximum.reduceat(mins, first[:-1])
            varied = [mins[first[r] : first[r + 1]] if least[r] != most[r] else None for r in chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg[chosen]), pa.array(least[chosen]), pa.array(varied, pa.list_(pa.int64()))], ["seg", "low", "mins"]
            )


def drop_repeated_windows(docs: DataFrame, width: int = 13, with_text: bool = True) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_words`, `n_removed`, `kept_sha256`, and `with_text` `kept`, the text that is left."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row"))
    named = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    cut = _cutter(width)
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_minimisers(named, cut, F.col("lo") < F.col("hi")))

    def walk(text, of):
        """Segments that may repeat: (key, segment's hash, first window, windows, packed words)."""
        starts, counts, keys, words = of(text)
        if not len(keys):
            return
        packed = words.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        for k in np.flatnonzero(known(bitmap.value, keys)).tolist():
            start, count = int(starts[k]), int(counts[k])
            part = packed[6 * start : 6 * (start + count + width - 1)]
            yield int(keys[k]), xxhash.xxh64_intdigest(part) - (1 << 63), start, count, part

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = cut(), {}

        def flush() -> pa.RecordBatch:
            rows = [(key, seg, lo, hi, part) for seg, (key, lo, hi, part) in held.items()]
            held.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "seg", "lo", "hi", "packed"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key, seg, _, _, part in walk(text, of):
                    if (old := held.get(seg)) is None:
                        held[seg] = (key, doc_id, doc_id, part)
                    elif not old[1] <= doc_id <= old[2]:
                        held[seg] = (key, min(old[1], doc_id), max(old[2], doc_id), part)
                if len(held) >= _HELD:
                    yield flush()
        if held:
            yield flush()

    verdicts = materialize(
        named.select("doc_id", "text")
        .mapInArrow(send, "key long, seg long, lo long, hi long, packed binary")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda batches: _verdicts(batches, width), "seg long, low long, mins array<long>"),
        "window-verdicts",
    )
    repeating = docs.sparkSession.sparkContext.broadcast(bitmap_of(verdicts.select(F.col("seg").alias("key"))))

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = cut()
        for batch in batches:
            out = []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                out.extend((seg, doc_id, row, start, count) for _, seg, start, count, _ in walk(text, of))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                columns = list(zip(*out, strict=True))
                found = pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seg", "doc_id", "row", "start", "count"]
                )
                yield found.filter(pa.array(known(repeating.value, found.column("seg").to_numpy().view(np.uint64))))

    placed = named.select("doc_id", "row", "text").mapInArrow(
        occurrences, "seg long, doc_id long, row long, start int, count int"
    )
    one = F.lit(1).cast("long")
    shift = lambda n: F.call_function("shiftleft", one, n)
    some = F.aggregate(
        F.transform("mins", lambda m, i: F.when(m < F.col("doc_id"), shift(i)).otherwise(0)),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    every = F.when(F.col("low") < F.col("doc_id"), shift(F.col("count")) - 1).otherwise(0)
    flags = (
        placed.join(verdicts, "seg")
        .select("doc_id", "row", "start", F.when(F.col("mins").isNull(), every).otherwise(some).alias("mask"))
        .where(F.col("mask") != 0)
        .groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("start", "mask")).alias("flags"))
    )
    flags = materialize(flags, "window-flags")
    flagged = docs.sparkSession.sparkContext.broadcast(bitmap_of(flags.select(F.col("row").alias("key"))))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def answered(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k, _ in zip(columns, kinds, names, strict=False)], names
        )

    def answer(doc_id: int | None, words: list[str], kept: list[str]) -> tuple:
        left = " ".join(kept)
        digest = hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(words), len(words) - len(kept), digest, left

    def whole():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = known(flagged.value, batch.column("row").to_numpy().view(np.uint64))
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            out = []
            for k in np.flatnonzero(~hit):
                words = words_of(texts[k])
                out.append(answer(ids[k], words, words))
            return answered(out)

        return step

    def touched():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(known(flagged.value, batch.column("row").to_numpy().view(np.uint64))))

        return step

    def reduced():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, flagged_ in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = words_of(text)
                kept = words
                if flagged_:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for flag in flagged_:
                        start, mask = flag["start"], flag["mask"]
                        while mask:
                            low = mask & -mask
                            at = start + low.bit_length() - 1
                            edge[at] += 1
                            edge[at + width] -= 1
                            mask ^= low
                    free = np.cumsum(edge[:-1]) == 0
                    kept = [words[k] for k in np.flatnonzero(free)]
                out.append(answer(doc_id, words, kept))
            return answered(out)

        return step

    rows = docs.select("doc_id", "row", "text")
    joined = arrow_map(rows, touched, rows.schema).join(flags, ["doc_id", "row"], "left").select("doc_id", "text", "flags")
    return arrow_map(rows, whole, schema).unionByName(arrow_map(joined, reduced, schema))
