"""Segments of one minimiser: which of them are sorted."""

import random

import pyarrow as pa
import pytest

from filetwin.llm import suffix_dedup
from filetwin.llm.suffix_dedup import K, _alike, _verdicts, drop_repeated_strings

LENGTH = 200


def noise(dice, n):
    return bytes(dice.randrange(97, 123) for _ in range(n))


def batch(parts):
    rows = [(7, seg, 1, place, part) for seg, (part, place) in enumerate(parts)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["key", "seg", "n", "place", "packed"])


@pytest.mark.parametrize("before, shared", [(0, False), (83, False), (84, True), (168, True), (1, True)])
def test_only_segments_that_may_share_a_string_are_sorted(monkeypatch, before, shared):
    """Two segments that agree in their minimiser, `before` bytes in front of it and, if `shared`, enough behind it."""
    dice, sorted_ = random.Random(1), []
    real = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda line: sorted_.append(len(line)) or real(line))
    after = LENGTH - K - before if shared else 83
    middle = noise(dice, before + K + after)
    fill = lambda n, c: c + noise(dice, n - 1) if n else b""
    parts = []
    for c in (b"0", b"1"):
        left, right = 168 - before, 168 - after
        front = noise(dice, left - 1) + c if left else b""
        parts.append((front + middle + fill(right, c), 168))
    assert _alike(parts, LENGTH) == [shared] * 2
    found = pa.Table.from_batches(_verdicts([batch(parts)], LENGTH), batch_schema()).to_pylist()
    assert [r["runs"] for r in found] == ([[{"at": 168 - before, "n": 1}]] * 2 if shared else [])
    assert bool(sorted_) == shared


def batch_schema():
    return pa.schema([("seg", pa.int64()), ("runs", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))])


def test_planted_strings_around_every_place_go(spark):
    """Strings of just 200 and 199 bytes in noise: the first go, whatever their minimiser's place, the second stay."""
    dice = random.Random(2)
    rows, wanted = [], {}
    for k in range(40):
        size = LENGTH - k % 2
        middle = noise(dice, size)
        for side, c in enumerate(b"01"):
            mark = bytes([c])
            front, back = noise(dice, dice.randrange(300)), noise(dice, dice.randrange(300))
            rows.append((2 * k + side, (front + mark + middle + mark + back).decode()))
            wanted[2 * k + side] = LENGTH if size == LENGTH else 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = drop_repeated_strings(docs, LENGTH).select("doc_id", "n_removed").collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == wanted
