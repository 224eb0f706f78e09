"""A class-based bigram language model (Brown et al.) with exchange clustering of all words.

Every training word is in one of `classes` classes; the end of a text is a class of its own and starts the
next. The `head` most frequent words only give the start: they are exchanged one by one, starting from
classes by rank, until none moves, while all others count by shape (length, digits, punctuation). Then all
words are exchanged in rounds. A round counts each word's left and right classes over all bigrams, and tasks
move words to the class that raises the class bigrams' likelihood most, as if the word moved alone. After
the first round, a word may move every other round, so that words do not swap places for ever. Rounds end
when words that hold less than SETTLED of the tokens move, when the likelihood no longer rises (the better
classes stay), or after ROUNDS.

A text's probability is the product of class transitions and word emissions: transitions interpolate class
bigrams with class frequencies by Witten and Bell's weights, emissions are relative frequencies within the
class, with one count more per word and one for all unseen words. An unseen word is taken for one of the
class that has most words of its shape seen once.

Counts cover all training texts. The DICTIONARY most frequent words go to all tasks with their classes
(bounded); words beyond it are known by 59 bits of hash and their shape, and their counts and classes are
joined, in training as in scoring, so nothing is cut off.

Null texts are empty: one end token. Without training texts every count is 0 and the model's transitions
and emissions are uniform. Rows that share a `doc_id` are scored one by one; rows without one are not
learned from and not held out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import arrow_runs, mix

DICTIONARY = 200_000
SHAPES = 12
ROUNDS = 8
SETTLED = 0.01
_FLUSH = 300_000
_LINE = 2_000_000
_KEPT = 100_000  # words beyond the dictionary whose ids a task keeps at hand
_PAIRS = 32_768  # bigrams in a row: Parquet buffers at least a hundred rows
_BLOCK = 1_000_000  # words of texts that are scored together
_BUCKET = 100_000  # tokens of words beyond the dictionary in a bucket
_RUN = 1024  # words of the dictionary in a bucket
_RARE = (1 << 24) - 1
_ROWS = "bucket long, kind int, parts array<binary>"
# Of a bucket's words beyond the dictionary: word, class, count; per neighbour the word's place, side (1: left), neighbour, count.
_STATE = (np.int64, np.int16, np.int64, np.int32, np.uint8, np.int64, np.int32)


def shape(word: str) -> int:
    """The kind of a word that has no class yet."""
    size = 0 if len(word) <= 4 else 1 if len(word) <= 9 else 2
    if word.isalpha():
        return size * 4
    return size * 4 + (3 if any(map(str.isdigit, word)) else 1 if word[:-1].isalpha() else 2)


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    """The lower-cased words of each text; splitting bytes leaves Unicode's other white space inside words."""
    return [text.lower().split() if text else [] for text in batch.column("text").cast(pa.binary()).to_pylist()]


def _counts(training: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for words in _words(batch):
                held.update(words)
                if len(held) >= _FLUSH:
                    yield flush()
        if held:
            yield flush()

    return arrow_runs(training.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rare_id(word: bytes) -> int:
    """A negative id for a lower-cased word beyond the dictionary; the last four bits are its shape."""
    return ((xxhash.xxh64_intdigest(word) | 1 << 63) & ~15 | shape(word.decode())) - (1 << 64)


class Ids(dict):
    """Lower-cased word to its rank in the dictionary, or to a negative id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__(ranks)
        self.ranks = ranks

    def __missing__(self, word: bytes) -> int:
        if len(self) >= len(self.ranks) + _KEPT:
            self.clear()
            self.update(self.ranks)
        value = self[word] = rare_id(word)
        return value

    def of(self, words: Iterable[bytes], count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, count)


def _binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    places = pa.py_buffer((offsets * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, places, pa.py_buffer(np.ascontiguousarray(values))])


def _encoded(docs: DataFrame, ranks) -> DataFrame:
    """Per text its ids: three bytes a word in `low` and `high`, and the negative ids in `rare`; `block` is a run of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, filled = Ids(ranks.value), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lists = _words(batch)
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            words = ids.of(chain.from_iterable(lists), int(offsets[-1]))
            beyond = words < 0
            rare_offsets = np.concatenate(([0], np.cumsum(beyond)))[offsets]
            places = np.where(beyond, _RARE, words)
            ends = filled + np.cumsum(lengths + 1)
            blocks = first + (ends - lengths - 1) // _BLOCK
            filled = int(ends[-1]) if len(ends) else filled
            columns = [
                pa.array(blocks),
                _binaries((places & 0xFFFF).astype("<u2"), offsets),
                _binaries((places >> 16).astype(np.uint8), offsets),
                _binaries(words[beyond], rare_offsets),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "held_out", "trains")] + columns,
                ["doc_id", "held_out", "trains", "block", "low", "high", "rare"],
            )

    kinds = "doc_id long, held_out boolean, trains boolean, block long, low binary, high binary, rare binary"
    return materialize(arrow_runs(docs.select("doc_id", "held_out", "trains", "text"), run, kinds), "lm-ids")


def _line(low: list[bytes], high: list[bytes], rare: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with the end before, between and behind them, and the number of words of each."""
    lengths = np.fromiter(map(len, high), np.int64, len(high))
    words = np.frombuffer(b"".join(low), "<u2").astype(np.int64) | np.frombuffer(b"".join(high), np.uint8).astype(np.int64) << 16
    words[words == _RARE] = np.frombuffer(b"".join(rare), np.int64)
    line = np.full(len(words) + len(lengths) + 1, end, np.int64)
    line[np.arange(len(words)) + np.repeat(np.arange(len(lengths)) + 1, lengths)] = words
    return line, lengths


def _lines(batches: Iterable[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """Lines of about _LINE ids; each starts and stops with an end."""
    held: list[list[list[bytes]]] = []
    size = 0
    for batch in batches:
        held.append([batch.column(c).to_pylist() for c in ("low", "high", "rare")])
        size += sum(map(len, held[-1][1])) + len(held[-1][1])
        if size >= _LINE:
            yield _line(*(list(chain.from_iterable(c)) for c in zip(*held, strict=True)), end)[0]
            held, size = [], 0
    if size:
        yield _line(*(list(chain.from_iterable(c)) for c in zip(*held, strict=True)), end)[0]


def _blobs(rows: list[tuple[int, int, list[np.ndarray]]]) -> pa.RecordBatch:
    """Rows of arrays for a bucket: many words travel in one row."""
    parts = pa.array([[np.ascontiguousarray(x).tobytes() for x in r[2]] for r in rows], pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), parts], ["bucket", "kind", "parts"]
    )


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, list[bytes]]]]]:
    """The rows of each bucket, of batches sorted by it; they are not gathered."""
    columns = ("bucket", "kind", "parts")
    rows = chain.from_iterable(zip(*(batch.column(c).to_pylist() for c in columns), strict=True) for batch in batches)
    for bucket, own in groupby(rows, itemgetter(0)):
        yield bucket, (row[1:] for row in own)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _split(word: np.ndarray, buckets: int, columns: list[np.ndarray], kind: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of `word`, holding its part of the columns."""
    bucket = _bucket(word, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    stops = np.append(starts[1:], len(bucket))
    rows = [(int(bucket[i]), kind, [c[i:j] for c in columns]) for i, j in zip(starts, stops, strict=True)]
    for begin in range(0, len(rows), 256):
        yield _blobs(rows[begin : begin + 256])


def _arrays(parts: list[bytes], kinds: tuple) -> list[np.ndarray]:
    return [np.frombuffer(p, k) for p, k in zip(parts, kinds, strict=True)]


def _bigrams(ids: DataFrame, size: int) -> DataFrame:
    """Bigrams (a, b, n) of the dictionary's words and the end, whose id is `size`; counted within lines only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _lines(batches, size):
            a, b = line[:-1], line[1:]
            keys = np.sort((a * (size + 1) + b)[(a >= 0) & (b >= 0)])
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(keys))).astype(np.int32)
            keys = keys[first]
            for begin in range(0, len(keys), _PAIRS):
                part = slice(begin, begin + _PAIRS)
                pair = [(keys[part] // (size + 1)).astype(np.int32), (keys[part] % (size + 1)).astype(np.int32)]
                yield _blobs([(0, 0, [*pair, counts[part]])])

    return materialize(arrow_runs(ids.where("trains").select("low", "high", "rare"), run, _ROWS), "lm-bigrams")


def _near(ids: DataFrame, size: int, classes: int, buckets: int) -> DataFrame:
    """The words beyond the dictionary by bucket, with their counts, first classes and neighbours (_STATE)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _lines(batches, size):
            a, b = line[:-1], line[1:]
            right, left = a < 0, b < 0
            word = np.concatenate((a[right], b[left]))
            if len(word):
                side = np.concatenate((np.zeros(right.sum(), np.uint8), np.ones(left.sum(), np.uint8)))
                yield from _split(word, buckets, [word, side, np.concatenate((b[right], a[left]))], 0)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            found = [_arrays(parts, (np.int64, np.uint8, np.int64)) for _, parts in rows]
            word, side, near = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((near, side, word))
            word, side, near = word[order], side[order], near[order]
            new = (word[1:] != word[:-1]) | (side[1:] != side[:-1]) | (near[1:] != near[:-1])
            first = np.flatnonzero(np.concatenate(([True], new)))
            n = np.diff(np.append(first, len(word))).astype(np.int32)
            word, side, near = word[first], side[first], near[first]
            words, of = np.unique(word, return_inverse=True)
            count = np.bincount(of, np.where(side == 0, n, 0), len(words)).astype(np.int64)
            number = (classes + (words & 15)).astype(np.int16)
            yield _blobs([(bucket, 1, [words, number, count, of.astype(np.int32), side, near, n])])

    rows = arrow_runs(ids.where("trains").select("low", "high", "rare"), run, _ROWS)
    return materialize(arrow_runs(_grouped(rows), merge, _ROWS), "lm-near")


def exchange(bigrams: np.ndarray, head: int, classes: int) -> np.ndarray:
    """The class of each symbol; symbols beyond `head` keep classes of their own."""
    size = len(bigrams)
    extra = size - head
    classes = max(1, min(classes, head))
    of = np.concatenate((np.arange(head) % classes, classes + np.arange(extra)))
    total = classes + extra
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    pairs = member.T @ bigrams @ member
    weight = bigrams.sum(axis=1)
    mass = member.T @ weight
    f = lambda x: x * np.log(np.maximum(x, 1))
    moved = 1
    while moved:
        moved = 0
        for w in range(head):
            out, into, own = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            old = of[w]
            out[old] -= own
            into[old] -= own
            pairs[old] -= out
            pairs[:, old] -= into
            pairs[old, old] -= own
            mass[old] -= weight[w]
            base = f(pairs)
            gain_out = (f(pairs + out[None]) - base).sum(axis=1)
            gain_in = (f(pairs + into[:, None]) - base).sum(axis=0)
            d = np.arange(total)
            gain = gain_out + gain_in
            gain -= f(pairs[d, d] + out) + f(pairs[d, d] + into) - 2 * base[d, d]
            gain += f(pairs[d, d] + out + into + own) - base[d, d]
            gain -= 2 * (f(mass + weight[w]) - f(mass))
            new = int(gain[:classes].argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            member[w, old] = 0
            member[w, new] = 1
            of[w] = new
            pairs[new] += out
            pairs[:, new] += into
            pairs[new, new] += own
            mass[new] += weight[w]
            moved += new != old
    return of


def _start(bigrams: DataFrame, near: DataFrame, shapes, head: int, classes: int) -> np.ndarray:
    """The classes of the `head` most frequent words, exchanged among themselves."""
    size = head + SHAPES + 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.concatenate((np.arange(head), head + shapes.value[head:], [size - 1])).astype(np.int64)
        of = lambda ids: np.where(ids < 0, head + (ids & 15), symbol[np.maximum(ids, 0)])
        totals = np.zeros(size * size, np.int64)
        for _, rows in _by_bucket(batches):
            for kind, parts in rows:
                if kind == 0:
                    a, b, n = _arrays(parts, (np.int32,) * 3)
                    np.add.at(totals, of(a.astype(np.int64)) * size + of(b.astype(np.int64)), n)
                    continue
                words, _, _, at, side, other, n = _arrays(parts, _STATE)
                own, right = words[at], side == 0
                left = ~right & (other >= 0)  # two words beyond the dictionary count once
                np.add.at(totals, of(own[right]) * size + of(other[right]), n[right])
                np.add.at(totals, of(other[left]) * size + of(own[left]), n[left])
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found // size, found % size, totals[found])], ["a", "b", "n"])

    def run(rows: pa.Table) -> pa.Table:
        table = np.zeros((size, size))
        table[rows["a"].to_numpy(), rows["b"].to_numpy()] = rows["n"].to_numpy()
        return pa.table({"symbol": np.arange(size, dtype=np.int32), "class": exchange(table, head, classes).astype(np.int32)})

    # One bounded group, as a start for all words: size squared counts, however large the corpus.
    rows = arrow_runs(bigrams.unionByName(near), count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    of = np.arange(size)
    for symbol, number in rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "symbol int, class int").collect():
        of[symbol] = number
    return of[:head]


def _vectors(bigrams: DataFrame, state: DataFrame, known: np.ndarray, total: int, buckets: int) -> DataFrame:
    """Per bucket its words' classes and cells: kinds are classes on the right, then on the left, then the word itself.

    A cell is a word's place in the bucket times the number of kinds, plus the kind. Buckets below 0 are runs of the
    dictionary's words, whose classes are `known`; `state` has the others with their neighbours. Those tell each
    neighbour their class, so only words next to each other beyond the dictionary meet in the shuffle. `pairs` are
    the class bigrams that start in the bucket.
    """
    shared = state.sparkSession.sparkContext.broadcast(known)
    width, self_ = 2 * total + 2, 2 * total + 1

    def told(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(totals) // width, _RUN):
            part = totals[first * width : (first + _RUN) * width]
            cells = np.flatnonzero(part)
            if len(cells):
                yield _blobs([(-1 - first // _RUN, 0, [cells.astype(np.int32), part[cells]])])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int64)
        totals = np.zeros(len(of) * width, np.int32)
        for _, rows in _by_bucket(batches):
            for _, parts in rows:
                a, b, n = _arrays(parts, (np.int32,) * 3)
                a, b, same = a.astype(np.int64), b.astype(np.int64), a == b
                np.add.at(totals, a * width + of[b], n)
                np.add.at(totals, b * width + (total + of[a]), n)
                np.add.at(totals, a[same] * width + self_, n[same])
        yield from told(totals)

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(shared.value) * width, np.int32)
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            word, kind, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            if len(word):
                yield from _split(word, buckets, [word, kind, n], 0)

        for bucket, rows in _by_bucket(batches):
            for _, parts in rows:
                _, number, _, at, side, near, n = _arrays(parts, _STATE)
                kind = number[at] + np.where(side == 0, total, 0).astype(np.int16)  # this word is on the neighbour's left
                inside = near >= 0
                np.add.at(totals, near[inside] * width + kind[inside], n[inside])
                held.append((near[~inside], kind[~inside], n[~inside]))
                size += len(held[-1][0])
                if size >= _FLUSH:
                    yield from flush()
                    size = 0
                yield _blobs([(bucket, 1, [np.frombuffer(p, np.uint8) for p in parts])])
        if held:
            yield from flush()
        yield from told(totals)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.astype(np.int64)
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                first = (-1 - bucket) * _RUN
                number = shared.value[first : first + _RUN]
                dense = np.zeros(len(number) * width, np.int64)
                for _, parts in rows:
                    cells, n = _arrays(parts, (np.int32, np.int32))
                    dense[cells] += n
                cells = np.flatnonzero(dense)
                n, kept = dense[cells], [np.arange(first, first + len(number)), number]
            else:
                rows = list(rows)
                (kept,) = (parts for kind, parts in rows if kind == 1)
                words, number, _, at, side, near, times = kept = _arrays(kept, _STATE)
                inside, same = near >= 0, (side == 0) & (near == words[at])
                cells = [at[inside] * width + of[near[inside]] + np.where(side[inside] == 0, 0, total), at[same] * width + self_]
                n = [times[inside], times[same]]
                for kind, parts in rows:
                    if kind == 0:
                        word, kinds, more = _arrays(parts, (np.int64, np.int16, np.int32))
                        cells.append(np.searchsorted(words, word) * width + kinds)
                        n.append(more)
                cells, n = np.concatenate(cells), np.concatenate(n).astype(np.int64)
                order = np.argsort(cells)
                cells, n = cells[order], n[order]
                first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
                cells, n = cells[first], np.add.reduceat(n, first)
            pairs = np.zeros((total, total), np.int64)
            right = cells % width < total
            np.add.at(pairs, (number[cells[right] // width], cells[right] % width), n[right])
            batch = _blobs([(bucket, 1, [cells, n, *kept])])
            yield batch.append_column("pairs", pa.array([pairs.tobytes()], pa.binary()))

    rows = arrow_runs(bigrams, count, _ROWS).unionByName(arrow_runs(state, tell, _ROWS))
    return materialize(arrow_runs(_grouped(rows), merge, _ROWS + ", pairs binary"), "lm-vectors")


def _table(cells: np.ndarray, n: np.ndarray, many: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of classes on the right and on the left, and of the word beside itself."""
    table = np.zeros((many, 2 * total + 2))
    table.ravel()[cells] = n
    return table[:, :total], table[:, total : 2 * total], table[:, 2 * total + 1]


def _class_pairs(vectors: DataFrame, total: int) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total * total, np.int64)
        for batch in batches:
            for pairs in batch.column("pairs").to_pylist():
                sums += np.frombuffer(pairs, np.int64)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found // total, found % total, sums[found])], ["g", "h", "n"])

    pairs = np.zeros((total, total))
    for g, h, n in arrow_runs(vectors.select("pairs"), run, "g long, h long, n long").groupBy("g", "h").agg(F.sum("n")).collect():
        pairs[g, h] = n
    return pairs


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(
    pairs: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray, old: np.ndarray, classes: int | None = None
) -> np.ndarray:
    """For each word, taken out of its class `old`, what the likelihood gains when it joins each class.

    With `classes`, only the first ones are joined; all words must be in them.
    """
    many, total = out.shape[0], classes or out.shape[1]
    row, d = np.arange(many), np.arange(total)
    weight = out.sum(axis=1, keepdims=True)
    out, into = out.copy(), into.copy()
    out[row, old] -= own
    into[row, old] -= own
    gain = np.zeros((many, total))
    for table, here, there in ((pairs.T, out, into), (pairs, into, out)):
        w, j = np.nonzero(here)
        if not len(w):
            continue
        n, e = here[w, j], np.arange(len(w))
        base, lower = table[j, :total], _f(table[:, :total])[j]  # without the word: its old class's row and column are lower
        base[e, old[w]] -= n
        at = np.flatnonzero(j == old[w])
        base[at] -= there[w[at], :total]
        base[at, old[w[at]]] -= own[w[at]]
        lower[e, old[w]] = _f(base[e, old[w]])
        lower[at] = _f(base[at])
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        gain[w[first]] += np.add.reduceat(_f(base + n[:, None]) - lower, first, axis=0)
    w, j = np.nonzero(((out != 0) | (into != 0) | (own != 0)[:, None])[:, :total])  # nothing changes elsewhere
    here, there, same = out[w, j], into[w, j], own[w]
    both = pairs[d, d][j] - np.where(j == old[w], here + there + same, 0)
    gain[w, j] += _f(both + here + there + same) - _f(both + here) - _f(both + there) + _f(both)
    sums = pairs.sum(axis=1)[:total]
    mass, lower = np.broadcast_to(sums, gain.shape).copy(), np.broadcast_to(_f(sums), gain.shape).copy()
    mass[row, old] -= weight[:, 0]
    lower[row, old] = _f(mass[row, old])
    return gain - 2 * (_f(mass + weight) - lower)


def _alike(old: np.ndarray, cells: np.ndarray, n: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the words with the same class and cells, and for each word the place of its first."""
    kind, lengths = cells % width, np.diff(starts)
    sign = mix(mix(kind.astype(np.uint64)) + n.astype(np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sign)))
    sign = mix(sums[starts[1:]] - sums[starts[:-1]] + mix(old.astype(np.uint64) + np.uint64(1 << 32)))
    _, first, of = np.unique(sign, return_index=True, return_inverse=True)
    like = first[of]
    same = (lengths == lengths[like]).all() and (old == old[like]).all()
    if same:
        at = np.arange(len(cells)) + np.repeat(starts[like] - starts[:-1], lengths)
        same = (kind == kind[at]).all() and (n == n[at]).all()
    return (first, of) if same else (np.arange(len(old)), np.arange(len(old)))


def _moved(vectors: DataFrame, pairs: np.ndarray, classes: int, turn: int) -> DataFrame:
    """Per bucket its words with their classes after this round, the tokens `n` and those whose words `moved`."""
    total = len(pairs)
    width = 2 * total + 2
    model = vectors.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            (parts,) = (parts for _, parts in rows)
            cells, n, word, old, *rest = _arrays(parts, (np.int64, np.int64, *(_STATE if bucket >= 0 else _STATE[:2])))
            new, right = old.copy(), cells % width < total
            weight = np.bincount(cells[right] // width, n[right], len(word)).astype(np.int64)
            turns = (mix(word.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % 2 == turn % 2
            free = np.flatnonzero((old != total - 1) & ((old >= classes) | turns))
            starts = np.searchsorted(cells // width, np.arange(len(word) + 1))
            first, of = _alike(old[free], *_rows(cells, n, starts, free, width), width)
            chosen = free[first]
            best_of = np.zeros(len(chosen), old.dtype)
            for begin in range(0, len(chosen), 512):
                at = chosen[begin : begin + 512]
                here, times, _ = _rows(cells, n, starts, at, width)
                out, into, own = _table(here, times, len(at), total)
                gain = gains(model.value, out, into, own, old[at], None if (old[at] >= classes).any() else classes)
                best = gain[:, :classes].argmax(axis=1)
                row, now = np.arange(len(at)), old[at]
                better = (gain[row, best] > gain[row, now] + 1e-9) | (now >= classes)
                best_of[begin : begin + 512] = np.where(better, best, now)
            new[free] = best_of[of]
            batch = _blobs([(bucket, 1, [word, new, *(rest or [weight])])])
            sums = (int(weight[new != old].sum()), int(weight.sum()))
            yield batch.append_column("moved", pa.array(sums[:1], pa.int64())).append_column("n", pa.array(sums[1:], pa.int64()))

    rows = vectors.select("bucket", "kind", "parts")
    return materialize(arrow_runs(rows, run, _ROWS + ", moved long, n long"), "lm-classes")


def _rows(cells: np.ndarray, n: np.ndarray, starts: np.ndarray, at: np.ndarray, width: int):
    """The cells of the words `at`, renumbered, with their counts and where each word's start."""
    lengths = starts[at + 1] - starts[at]
    begins = np.concatenate(([0], np.cumsum(lengths)))
    places = np.arange(begins[-1]) + np.repeat(starts[at] - begins[:-1], lengths)
    return cells[places] % width + np.repeat(np.arange(len(at)) * width, lengths), n[places], begins


def cluster(
    bigrams: DataFrame, near: DataFrame, shapes, head: int, classes: int, buckets: int
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The words beyond the dictionary with their classes, the classes of the dictionary's words and the end, and the class bigrams."""
    size = len(shapes.value)
    total = classes + SHAPES + 1
    known = np.append(classes + shapes.value, total - 1).astype(np.int16)
    known[:head] = _start(bigrams, near, shapes, head, classes)
    table, kept, share = near, None, 1.0
    for turn in range(ROUNDS + 1):
        vectors = _vectors(bigrams, table.where("bucket >= 0").select("bucket", "kind", "parts"), known, total, buckets)
        pairs = _class_pairs(vectors, total)
        value = _f(pairs).sum() - 2 * _f(pairs.sum(axis=1)).sum()
        worse = turn > 1 and value <= kept[0]
        if worse or turn == ROUNDS or share < SETTLED:
            discard(vectors)
            if worse:
                discard(table)
            else:
                kept = (value, table, known, pairs)
            break
        if kept:  # the rounds before are not gone back to: their tables would add up
            discard(kept[1])
        kept = (value, table, known, pairs)
        table = _moved(vectors, pairs, classes, turn)
        discard(vectors)
        known = known.copy()
        for parts in table.where("bucket < 0").select("parts").toArrow().column(0).to_pylist():
            word, number, _ = _arrays(parts, _STATE[:3])
            known[word] = number
        moved, n = table.agg(F.sum("moved"), F.sum("n")).first()
        share = (moved or 0) / max(1, n or 0) if turn else 1.0
    left = np.append(np.arange(classes), total - 1)  # no word has a shape for its class any more
    return kept[1].where("bucket >= 0").select("bucket", "kind", "parts"), np.minimum(kept[2], classes), kept[3][np.ix_(left, left)]


def _by_shape(words: DataFrame, classes: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Per shape and class the tokens, the words and those seen once, of the words beyond the dictionary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 16 * classes), np.int64)
        for _, rows in _by_bucket(batches):
            for _, parts in rows:
                word, number, n = _arrays(parts[:3], _STATE[:3])
                at = (word & 15) * classes + number
                for k, value in enumerate((n, np.ones(len(n)), n == 1)):
                    sums[k] += np.bincount(at, value, 16 * classes).astype(np.int64)
        found = np.flatnonzero(sums[1])
        columns = (found // classes, found % classes, *sums[:, found])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shape", "class", "n", "v", "ones"])

    sums = arrow_runs(words, run, "shape long, class long, n long, v long, ones long").groupBy("shape", "class")
    return sums.agg(F.sum("n"), F.sum("v"), F.sum("ones")).collect()


def _answers(ids: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """Per block (as `bucket`) the classes and counts of those of its words beyond the dictionary that were learned."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            word = np.unique(np.frombuffer(b"".join(held), np.int64))
            held.clear()
            if len(word):
                yield from _split(word, buckets, [word, np.full(len(word), now, np.int64)], 0)

        for batch in batches:
            for block, rare in zip(batch.column("block").to_pylist(), batch.column("rare").to_pylist(), strict=True):
                if block != now and held:
                    yield from flush()
                now = block
                held.append(rare)
        if held:
            yield from flush()

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            rows = list(rows)
            table = [_arrays(parts[:3], _STATE[:3]) for kind, parts in rows if kind == 1]
            if not table:
                continue
            words, number, n = table[0]
            for kind, parts in rows:
                if kind == 0:
                    word, block = _arrays(parts, (np.int64, np.int64))
                    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
                    at = at[words[at] == word]
                    if len(at):
                        yield _blobs([(int(block[0]), 0, [words[at], number[at], n[at]])])

    rows = arrow_runs(ids.select("block", "rare"), ask, _ROWS).unionByName(
        words.select("bucket", "kind", F.slice("parts", 1, 3).alias("parts"))
    )
    return arrow_runs(_grouped(rows), answer, _ROWS)


def score_texts(docs: DataFrame, held_out: Column, head: int = 1000, classes: int = 40) -> DataFrame:
    """Per row of `docs`: `doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`, `perplexity`."""
    spark = docs.sparkSession
    docs = docs.select(
        F.col("doc_id").cast("long"),
        "text",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(~held_out, F.lit(False)).alias("trains"),
    )
    training = docs.where("trains").select("text")
    counts = materialize(_counts(training), "lm-counts")
    ends = training.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, distinct = n_words + ends, n_distinct + (1 if ends else 0)
    top = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).toArrow()
    top_words, top_counts = top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.int64)
    size = len(top_words)
    head = min(head, size)
    classes = max(1, min(classes, head))
    ranks = spark.sparkContext.broadcast({word.encode(): k for k, word in enumerate(top_words)})
    of_word = np.array([shape(word) for word in top_words], np.int64)
    shapes = spark.sparkContext.broadcast(of_word)
    buckets = 1 + int(n_words - top_counts.sum()) // _BUCKET
    ids = _encoded(docs, ranks)
    near = _near(ids, size, classes, buckets)
    bigrams = _bigrams(ids, size)
    words, known, pairs = cluster(bigrams, near, shapes, head, classes, buckets)
    number = classes + 1

    outgoing, incoming, kinds = pairs.sum(axis=1), pairs.sum(axis=0), (pairs > 0).sum(axis=1)
    flat = (incoming + 1) / (incoming.sum() + number)
    share = np.divide(outgoing, outgoing + kinds, out=np.zeros(number), where=outgoing + kinds > 0)
    moves = share[:, None] * np.divide(pairs, outgoing[:, None], out=np.zeros_like(pairs), where=outgoing[:, None] > 0)
    moves = np.log10(moves + (1 - share)[:, None] * flat[None])

    in_class, single, of_shape = np.ones(number), np.zeros((SHAPES, classes)), np.zeros((SHAPES, classes))
    for s, c, n, v, ones in _by_shape(words, classes):
        in_class[c] += n + v
        of_shape[s, c], single[s, c] = v, ones
    np.add.at(in_class, known[:size], top_counts + 1)
    np.add.at(of_shape, (of_word, known[:size]), 1)
    np.add.at(single, (of_word, known[:size]), top_counts == 1)
    # The class of unseen words, by shape: most words seen once, else most words, of the shape or of all.
    evidence = np.where(single.any(axis=1)[:, None], single, np.where(of_shape.any(axis=1)[:, None], of_shape, of_shape.sum(axis=0)))
    unseen = np.append(evidence.argmax(axis=1), np.zeros(16 - SHAPES, np.int64))
    class_total = np.log10(in_class)
    base_total = math.log10(train_tokens + distinct + 1)
    model = spark.sparkContext.broadcast((known.astype(np.int64), moves, class_total, top_counts))
    end_base = math.log10(ends + 1) - base_total

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, moves, class_total, top_counts = model.value
        log_counts = np.append(np.log10(top_counts + 1.0), 0.0)
        lists: list[list] = []
        found: list[list[np.ndarray]] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not lists:
                return
            doc_id, held, low, high, rare = zip(*lists, strict=True)
            line, lengths = _line(low, high, rare, size)
            beyond = line < 0
            group, logs = of[np.maximum(line, 0)], log_counts[np.maximum(line, 0)]
            seen = ~beyond
            if beyond.any():
                word, at = np.unique(line[beyond], return_inverse=True)
                its, n = unseen[word & 15], np.zeros(len(word))
                for known_word, number, times in found:
                    place = np.searchsorted(word, known_word)
                    its[place], n[place] = number, times
                group[beyond], logs[beyond], seen[beyond] = its[at], np.log10(n + 1)[at], (n > 0)[at]
            emission = logs - class_total[group]
            emission[line == size] = 0  # the end is all of its class
            ends_at = np.cumsum(lengths + 1)
            value = np.add.reduceat(moves[group[:-1], group[1:]] + emission[1:], ends_at - lengths - 1)
            base = np.add.reduceat(logs[1:], ends_at - lengths - 1) - base_total * lengths + end_base
            n_known = np.add.reduceat((seen & (line != size))[1:].astype(np.int64), ends_at - lengths - 1) + (1 if ends else 0)
            columns = (lengths + 1, n_known, base, value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(held, pa.bool_()), *(pa.array(c) for c in columns)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "total"],
            )

        names = ("bucket", "parts", "doc_id", "held_out", "low", "high", "rare")
        for batch in batches:
            for block, parts, *text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if block != now:
                    yield from flush()
                    now, lists, found = block, [], []
                if parts is None:
                    lists.append(text)
                else:
                    found.append(_arrays(parts, _STATE[:3]))
        yield from flush()

    texts = ids.select(F.col("block").alias("bucket"), "doc_id", "held_out", "low", "high", "rare")
    rows = _grouped(texts.unionByName(_answers(ids, words, buckets).drop("kind"), allowMissingColumns=True))
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, total double"
    scored = materialize(arrow_runs(rows, score, kinds), "lm-scored")
    value = F.col("total")
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        value.alias("score"),
        F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )
