"""The pipeline as a whole: every stage's decisions on a small table, odd rows and an empty table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filetwin.llm.jaccard import bitmap, keep_first_of_each, overlap_bound
from filetwin.llm.language import keep_known_language, train_language_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _sentence(dice, words):
    return " ".join("".join(dice.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(words))


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


@pytest.fixture
def run(spark, tmp_path):
    def run_(rows, items):
        folder = str(tmp_path / f"sf{random.random()}")
        spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        return corpus_pipeline.run(spark, folder)

    return run_


def test_stages_take_effect_together(run):
    dice = random.Random(3)
    item = _sentence(dice, 30)
    clean = {k: _sentence(dice, 60) for k in range(20)}
    rows = [(k, t, None, "s", len(t)) for k, t in clean.items()]
    rows.append((100, clean[3], None, "s", 3))
    rows.append((101, clean[4] + " more", None, "s", 3))
    rows.append((102, f"{_sentence(dice, 20)} {item} {_sentence(dice, 20)}", None, "s", 3))
    rows.append((103, f"{_sentence(dice, 40)} mail jo.doe@example.org now", None, "s", 3))
    rows += [(104, None, None, None, None), (105, "", None, None, None), (106, "... 12 !", None, None, None)]
    # One id on two unrelated texts, one of them twice, and rows without an id.
    rows += [(107, _sentence(dice, 50), "xx", "s", 1), (107, _sentence(dice, 45), "xx", "s", 1)]
    rows += [rows[-1], (None, _sentence(dice, 50), None, "s", 1)]
    pieces = run(rows, [(1, item), (2, None), (None, "x")]).collect()
    lengths = {}
    for r in pieces:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert set(lengths) == set(clean) | {103, 107, None}
    totals = {r.doc_id: {x.doc_tokens for x in pieces if x.doc_id == r.doc_id} for r in pieces}
    assert lengths[107] == sum(totals[107]) and len(totals[107]) >= 1
    assert all(lengths[k] == sum(totals[k]) for k in clean)
    used = {}
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        assert sorted(spans)[0][0] == 0 and sum(n for _, n in spans) <= 1024


def test_empty_table(run):
    assert run([], [(1, "a b c d e f")]).collect() == []
    assert run([(1, None, None, None, None)], []).collect() == []


def test_stages_keep_the_columns_of_documents(spark):
    dice = random.Random(5)
    docs = spark.createDataFrame([(k, _sentence(dice, 40), "en", "s", 1) for k in range(12)], DOCS)
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "").columns == docs.columns, name


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    dice = random.Random(7)
    texts = [_sentence(dice, 40) for _ in range(6)]
    rows = [
        (1, texts[0], "b"),
        (1, texts[0], "a"),  # equal: the smaller row stays
        (1, texts[1], "c"),  # another text of the id
        (2, texts[1], "d"),  # a copy of that one
        (2, texts[2], "e"),
        (3, texts[2] + " x", "f"),  # a near copy of a text of id 2
        (4, texts[3], "g"),
        (5, None, "h"),
        (5, None, "h"),
        (None, texts[3], "i"),
        (None, texts[3], "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [tuple(r) for r in keep_first_of_each(docs).collect()]
    groups = [
        [(1, texts[0], "a")],
        [(1, texts[1], "c"), (2, texts[1], "d")],
        [(2, texts[2], "e"), (3, texts[2] + " x", "f")],
        [(4, texts[3], "g")],
        [(5, None, "h")],
    ]
    assert all(sum(k in group for k in kept) == 1 for group in groups)
    assert len(kept) == len(groups) + 2 and sum(k[0] is None for k in kept) == 2


def test_unlabelled_corpus_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "12"), (4, "ß")], "doc_id long, text string")
    docs = docs.withColumn("lang", F.lit(None).cast("string"))
    model = train_language_model(docs, F.lit(True))
    assert sorted(r.doc_id for r in keep_known_language(docs, model).collect()) == [1, 4]


def test_bitmaps_bound_the_overlap_closely():
    import numpy as np

    rng, slack = np.random.default_rng(2), []
    for _ in range(300):
        common = rng.integers(0, 2**63, rng.integers(0, 400), dtype=np.int64).astype(np.uint64)
        a = np.unique(np.concatenate((common, rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.int64).astype(np.uint64))))
        b = np.unique(np.concatenate((common, rng.integers(0, 2**63, rng.integers(1, 90), dtype=np.int64).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        bound = overlap_bound(bitmap(a), len(a), bitmap(b), len(b))
        assert bound >= both
        differ = len(a) + len(b) - 2 * both
        if both > 5 * differ:
            slack.append((bound - both) / differ)
    assert slack and np.mean(slack) < 0.15
