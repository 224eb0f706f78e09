"""Benchmark passages of all lengths are found at the edit limit; odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filetwin.llm import decontaminate
from filetwin.llm.common import BATCH_BYTES, arrow_map
from filetwin.llm.decontaminate import Block, Cleaned, MAX_WALKS, drop_leaks, edits_allowed, find_leaks

BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _word(dice):
    return "".join(dice.choice("abcdefghij") for _ in range(6))


def _edited(item, edits, dice):
    copy = list(item)
    for _ in range(edits):
        place = dice.randrange(len(copy))
        kind = dice.randrange(3)
        if kind == 0:
            copy[place] = _word(dice)
        elif kind == 1:
            copy.insert(place, _word(dice))
        else:
            del copy[place]
    return copy


@pytest.fixture(scope="module")
def mixed():
    """Nine in ten items have 12 words; the others 50 to 400. Each is copied at the very limit of edits."""
    dice = random.Random(6)
    sizes = [12] * 360 + [50] * 40 + [100] * 40 + [200] * 40 + [400] * 40
    items = [[_word(dice) for _ in range(n)] for n in sizes]
    texts = []
    for item in items:
        copy = _edited(item, edits_allowed(len(item), 0.8), dice)
        texts.append([_word(dice) for _ in range(30)] + copy + [_word(dice) for _ in range(30)])
    return sizes, items, texts


def test_recall_at_the_limit_for_every_length(mixed):
    sizes, items, texts = mixed
    block = Block([(k, " ".join(item)) for k, item in enumerate(items)], 0.8, 0.95, 1)
    cleaned = Cleaned()
    found = {(d, k) for d, k, *_ in block.matches([cleaned.of(" ".join(t)) for t in texts])}
    for n in (12, 50, 100, 200, 400):
        own = [k for k, size in enumerate(sizes) if size == n]
        assert np.mean([(k, k) in found for k in own]) >= 0.9, n
    assert all(d == k for d, k in found)
    assert {walks.count for walks in block.walks.values()} != {MAX_WALKS}


def test_short_items_are_whole_runs(spark):
    docs = spark.createDataFrame(
        [(1, "The quick, brown FOX jumps"), (2, "quick fox"), (3, "brown fox"), (4, None), (5, ""), (None, "one two")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame(
        [(10, "quick brown fox"), (11, "fox"), (12, None), (13, "--"), (None, "fox"), (14, "one two"), (14, "one two")],
        "item_id long, text string",
    )
    got = sorted(((r.doc_id or 0), r.item_id, r.edits, r.first_word) for r in find_leaks(docs, bench).collect())
    assert got == [(0, 14, 0, 0), (0, 14, 0, 0), (1, 10, 0, 1), (1, 11, 0, 3), (2, 11, 0, 1), (3, 11, 0, 1)]
    assert drop_leaks(docs, bench).count() == 6


def test_odd_inputs(spark):
    dice = random.Random(9)
    item = [_word(dice) for _ in range(30)]
    long = [_word(dice) for _ in range(60_000)]
    long[50_000:50_030] = item
    rows = [(1, " ".join(long), "c", 7), (2, " ".join(item), "c", 7), (2, " ".join(item), "c", 7), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, edits long")
    bench = spark.createDataFrame([(1, " ".join(item), "x")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.first_word) for r in find_leaks(docs, bench).collect())
    assert got == [(1, 1, 0, 50_000), (2, 1, 0, 0), (2, 1, 0, 0)]
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]
    assert find_leaks(docs.limit(0), bench).collect() == [] and find_leaks(docs, bench.limit(0)).collect() == []


def test_texts_are_searched_a_slice_at_a_time(monkeypatch):
    """However many texts a batch has, no more of them are held at once than a slice has."""
    import pyarrow as pa

    held = []
    real = decontaminate.Block.matches
    monkeypatch.setattr(decontaminate, "_SLICE_BYTES", 60)
    monkeypatch.setattr(decontaminate.Block, "matches", lambda self, docs: held.append(len(docs)) or real(self, docs))
    block = decontaminate.Block([(1, "one two three four five six")], 0.8, 0.95, 1)
    texts = ["no", None, "", "x " * 50, "a one two three four five six b"] * 40
    found = list(decontaminate._matches(block, decontaminate.Cleaned(), pa.array(texts)))
    assert [d for d, *_ in found] == list(range(4, 200, 5))
    assert sum(held) == 200 and max(held) < 6


def test_texts_come_in_batches_of_bounded_bytes(spark):
    """However many texts a task has, it takes some megabytes at a time."""
    spark.conf.unset(BATCHES)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    sizes = arrow_map(docs, lambda: lambda b: pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}), "n long, size long")
    found = sizes.collect()
    assert sum(r.n for r in found) == 3000 and max(r.size for r in found) < 2 * BATCH_BYTES
    spark.conf.set(BATCHES, "100k")  # a lower bound is left alone
    assert drop_leaks(docs, spark.createDataFrame([(1, "no such words anywhere here")], "item_id long, text string")).count() == 3000
    assert spark.conf.get(BATCHES) == "100k"
    spark.conf.unset(BATCHES)
