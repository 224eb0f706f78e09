"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

An item and a stretch of a document match when the item can be turned into the stretch with edits
(insert, drop or replace a word) to at most `1 - similarity` of the item's words. Words are compared
lower-cased without characters other than letters and digits.

The benchmark is taken in blocks of bounded size; each block goes to all tasks and every document is
read once a block, without a shuffle:

1. Windows. A match of n words with d edits leaves a run of n // (d + 1) item words untouched. So only
   windows of an item's length, laid where a document shares such a run (of up to three words) with an
   item, can match; all others are left out without loss.
2. Embedding. Each window takes random walks: step j writes the word under the pointer and moves on by a
   random bit of (j, word). Few edits make few differing positions, since walks meet again.
3. LSH. Each walk is read at two sampled positions; windows and items of the same length that agree in
   a walk are candidates. Each class of lengths has the smallest number of walks with which `recall` of copies at the
   very threshold are found, measured on edited copies of its own items. For a class that MAX_WALKS are too few for, every
   window of step 1 is a candidate of the items whose run it has.
4. Verification. Candidates' edit distance to the closest stretch is computed exactly.

Items so short that no edit is allowed match as whole runs of words. Null texts and items, and items without a word,
match nothing; items without an `item_id` are not searched. Repeated documents and items each give rows; ties take the
first position. Texts are searched whole, however long; an empty table or benchmark gives no rows. Columns other
than `doc_id` and `text` are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix

BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16_000_000
MAX_WALKS = 48
POSITIONS = 2
_PAD = np.uint64(0x51ED270B2C1C6D5B)
_CHUNK = 256
_SLICE_BYTES = 1 << 20


def clean_word(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Cleaned(dict):
    """Raw word to the hash of its clean form; 0 when nothing is left of it."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        plain = clean_word(word)
        value = self[word] = _hash(plain) or 1 if plain else 0
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return hashes[hashes != 0]


def edits_allowed(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


class Walks:
    """CGK walks over windows of hashed words, read at sampled positions."""

    def __init__(self, count: int, seed: int = 7) -> None:
        self.count = count
        self.seed = seed
        dice = np.random.default_rng(seed)
        self.places = dice.random((MAX_WALKS, POSITIONS))[:count]

    def _moves(self, steps: int) -> np.ndarray:
        dice = np.random.default_rng(self.seed + 1)
        return (dice.integers(0, 1 << 63, (steps, MAX_WALKS), dtype=np.uint64)[:, : self.count] << np.uint64(1)) | np.uint64(1)

    def keys(self, windows: list[np.ndarray]) -> np.ndarray:
        """One key per window and walk; windows of different length never share a key."""
        out = np.empty((len(windows), self.count), np.uint64)
        for begin in range(0, len(windows), _CHUNK):
            part = windows[begin : begin + _CHUNK]
            sizes = np.array([len(w) for w in part])
            longest = int(sizes.max())
            words = np.full((len(part), longest + 1), _PAD, np.uint64)
            for k, window in enumerate(part):
                words[k, : len(window)] = window
            steps = 2 * longest
            moves = self._moves(steps)
            at = np.minimum((self.places[None] * (2 * sizes)[:, None, None]).astype(np.int64), steps - 1)
            pointer = np.zeros((len(part), self.count), np.int64)
            rows = np.arange(len(part))[:, None]
            key = np.broadcast_to(sizes.astype(np.uint64)[:, None], pointer.shape).copy()
            for j in range(steps):
                word = words[rows, pointer]
                for p in range(POSITIONS):
                    key = np.where(at[:, :, p] == j, mix(key ^ (word + np.uint64(p + 1))), key)
                bit = (mix(word * moves[j]) >> np.uint64(63)).astype(np.int64)
                pointer = np.minimum(pointer + bit, sizes[:, None])
            out[begin : begin + _CHUNK] = mix(key + np.arange(self.count, dtype=np.uint64))
        return out


def length_class(n: int) -> int:
    """Items of one class differ by a quarter in length."""
    return int(math.log(n) / math.log(1.25) + 1e-9)


def choose_walks(items: list[np.ndarray], similarity: float, recall: float, samples: int = 300) -> int | None:
    """Walks needed to find `recall` of copies of `items` with as many edits as are allowed; None if MAX_WALKS don't do."""
    dice = np.random.default_rng(11)
    originals, copies = [], []
    for k in dice.integers(0, len(items), samples):
        item = items[k]
        changed = list(item)
        for _ in range(edits_allowed(len(item), similarity)):
            place = int(dice.integers(0, len(changed)))
            kind = int(dice.integers(0, 3))
            if kind == 0:
                changed[place] = np.uint64(dice.integers(1, 1 << 62))
            elif kind == 1:
                changed.insert(place, np.uint64(dice.integers(1, 1 << 62)))
            else:
                del changed[place]
        copy = np.array((changed + [_PAD] * len(item))[: len(item)], np.uint64)
        originals.append(item)
        copies.append(copy)
    walks = Walks(MAX_WALKS)
    found = walks.keys(originals) == walks.keys(copies)
    reached = np.logical_or.accumulate(found, axis=1).mean(axis=0)
    enough = np.flatnonzero(reached >= recall)
    return int(enough[0]) + 1 if len(enough) else None


def closest(item: np.ndarray, region: np.ndarray, limit: int) -> tuple[int, int] | None:
    """Fewest edits from `item` to a stretch of `region`, and the stretch's end; None above `limit`."""
    n = len(item)
    masks: dict[int, int] = defaultdict(int)
    for k, word in enumerate(item.tolist()):
        masks[word] |= 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, None
    for end, word in enumerate(region.tolist(), 1):  # bit-parallel columns of the edit table
        match = masks.get(word, 0)
        zero = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(zero | up)), up & zero
        if score <= limit and (best is None or score < best[0]):
            best = (score, end)
    return best


class Block:
    """A bounded part of the benchmark, ready to be searched for.

    Each length class has as many walks as its own items need for the target recall. Items of a class that misses it with
    MAX_WALKS are verified wherever the document shares one of their runs at the place it has in the item, without
    walks. Items too short for any edit are whole runs.
    """

    def __init__(self, rows: list[tuple[int, str]], similarity: float, recall: float, min_words: int) -> None:
        cleaned = Cleaned()
        found = [(i, cleaned.of(text)) for i, text in rows]
        found = [(i, words) for i, words in found if len(words) >= max(1, min_words)]
        self.ids = [i for i, _ in found]
        self.items = [words for _, words in found]
        self.similarity = similarity
        by_class: dict[int, list[int]] = defaultdict(list)
        self.whole: dict[int, dict[int, list[int]]] = {}
        for k, words in enumerate(self.items):
            if edits_allowed(len(words), similarity):
                by_class[length_class(len(words))].append(k)
            else:
                run = int(_runs(words, len(words))[0])
                self.whole.setdefault(len(words), {}).setdefault(run, []).append(k)
        self.walks: dict[int, Walks] = {}
        self.buckets: dict[tuple[int, int], list[int]] = {}
        #: Per run length, for each run its places: (place, item's length, the item itself if it goes without walks).
        self.runs: dict[int, dict[int, set[tuple[int, int, int]]]] = {}
        for kind, members in by_class.items():
            items = [self.items[k] for k in members]
            count = choose_walks(items, similarity, recall)
            if count is not None:
                self.walks[kind] = Walks(count)
                for k, keys in zip(members, self.walks[kind].keys(items).tolist(), strict=True):
                    for key in keys:
                        self.buckets.setdefault((kind, key), []).append(k)
            for k, words in zip(members, items, strict=True):
                n = len(words)
                q = min(3, n // (edits_allowed(n, similarity) + 1))
                places = self.runs.setdefault(q, {})
                for at, run in enumerate(_runs(words, q).tolist()):
                    places.setdefault(run, set()).add((at, n, -1 if count is not None else k))
        self.sorted = {q: np.sort(np.fromiter(places, np.uint64, len(places))) for q, places in self.runs.items()}
        self.sorted_whole = {n: np.sort(np.fromiter(runs, np.uint64, len(runs))) for n, runs in self.whole.items()}

    def windows(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Start and length of the document's windows that can match an item, and that item or -1."""
        out: set[tuple[int, int, int]] = set()
        for q, known in self.sorted.items():
            for p, run in _shared(words, q, known):
                out.update((p - at, n, k) for at, n, k in self.runs[q][run])
        return sorted(out)

    def matches(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document's place, item's id, item's words, edits, first word) of each match."""
        best: dict[tuple[int, int], tuple[int, int]] = {}

        def verify(d: int, start: int, k: int) -> None:
            item = self.items[k]
            n, limit = len(item), edits_allowed(len(item), self.similarity)
            begin_at = max(0, start - limit)
            hit = closest(item, docs[d][begin_at : start + n + limit], limit)
            if hit:
                first = max(0, begin_at + hit[1] - n)
                best[d, k] = min(best.get((d, k), (n, first)), (hit[0], first))

        waiting: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for d, words in enumerate(docs):
            for n, known in self.sorted_whole.items():
                for p, run in _shared(words, n, known):
                    for k in self.whole[n][run]:
                        if np.array_equal(words[p : p + n], self.items[k]):
                            best[d, k] = min(best.get((d, k), (n, p)), (0, p))
            for start, n, k in self.windows(words):
                if k >= 0:
                    verify(d, start, k)
                else:
                    waiting[length_class(n)].append((d, start, n))
        for kind, places in waiting.items():
            for begin in range(0, len(places), 4096):
                part = places[begin : begin + 4096]
                keys = self.walks[kind].keys([_window(docs[d], start, n) for d, start, n in part]).tolist()
                for (d, start, n), own in zip(part, keys, strict=True):
                    for k in {k for key in own for k in self.buckets.get((kind, key), ())}:
                        if len(self.items[k]) == n:
                            verify(d, start, k)
        for (d, k), (edits, first) in best.items():
            yield d, self.ids[k], len(self.items[k]), edits, first


def _window(words: np.ndarray, start: int, n: int) -> np.ndarray:
    window = words[max(start, 0) : start + n]
    if start < 0:
        window = np.concatenate((np.full(min(-start, n), _PAD), window))
    return np.concatenate((window, np.full(n - len(window), _PAD))) if len(window) < n else window


def _shared(words: np.ndarray, q: int, known: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places and hashes of the runs of `q` words that are known."""
    if len(words) >= q:
        runs = _runs(words, q)
        near = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        for p in np.flatnonzero(known[near] == runs).tolist():
            yield p, int(runs[p])


def _runs(words: np.ndarray, q: int) -> np.ndarray:
    count = max(0, len(words) - q + 1)
    out = np.zeros(count, np.uint64)
    for k in range(q):
        out = mix(out ^ words[k : k + count])
    return out


def _matches(block: Block, cleaned: Cleaned, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """`block.matches` over all texts, those of about _SLICE_BYTES at a time (or one): what is held does not grow with a batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + _SLICE_BYTES, "right")))
        for d, *rest in block.matches([cleaned.of(t) for t in texts.slice(begin, end - begin).to_pylist()]):
            yield begin + d, *rest
        begin = end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters (or one item)."""
    rows, chars = [], 0
    for item_id, text in (
        benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").toLocalIterator()
    ):
        if rows and (len(rows) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield rows
            rows, chars = [], 0
        rows.append((item_id, text))
        chars += len(text)
    if rows:
        yield rows


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, min_words: int = 1
) -> DataFrame:
    """Per document and item that match: `doc_id`, `item_id`, `item_words`, `edits`, `first_word`."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_words int, edits int, first_word int"
    source = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    found = None
    for rows in _blocks(benchmark):
        block = spark.sparkContext.broadcast(Block(rows, similarity, recall, min_words))

        def make(block=block):
            cleaned = Cleaned()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids = batch.column(0).to_pylist()
                out = list(_matches(block.value, cleaned, batch.column(1)))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                columns = list(zip(*((ids[d], *rest) for d, *rest in out), strict=True)) or [[]] * 5
                names = ("doc_id", "item_id", "item_words", "edits", "first_word")
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

            return step

        part = arrow_map(source, make, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, min_words: int = 5
) -> DataFrame:
    """The rows, unchanged, that match no item; one pass per block, no shuffle.

    Items of fewer than `min_words` words do not cost a document: a word or two are in many clean ones.
    """
    place = docs.columns.index("text")
    for rows in _blocks(benchmark):
        block = docs.sparkSession.sparkContext.broadcast(Block(rows, similarity, recall, min_words))

        def make(block=block):
            cleaned = Cleaned()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                bad = {d for d, *_ in _matches(block.value, cleaned, batch.column(place))}
                return batch.filter(pa.array([d not in bad for d in range(batch.num_rows)], pa.bool_()))

            return step

        docs = arrow_map(docs, make, docs.schema)
    return docs
