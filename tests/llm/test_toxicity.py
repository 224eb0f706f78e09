"""Toxicity: the score against the network spelt out, held-out accuracy, misspellings and odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filetwin.llm import queries
from filetwin.llm.common import crc_mod
from filetwin.llm.toxicity import BUCKETS, DIMS, Subwords, ToxicityModel, score_toxicity, train_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string, _text string, predicted string"
INSULTS = ["idiotic", "worthless", "pathetic", "disgusting"]


def sentence(dice, words):
    syllables = "ka lo mi ne ru sa to vi we zo".split()
    return ["".join(dice.choice(syllables) for _ in range(dice.choice([1, 2, 3]))) for _ in range(words)]


@pytest.fixture(scope="module")
def corpus(spark):
    dice, rows, labels = random.Random(2), [], []
    for k in range(900):
        words = sentence(dice, dice.choice([3, 20, 120]))
        toxic = int(k % 4 == 0)
        if toxic:
            words.insert(dice.randrange(len(words) + 1), dice.choice(INSULTS))
        rows.append((k, " ".join(words), "en", "s", "clash", "clash", "clash"))
        if k % 3:
            labels.append((k, 1 - toxic if k % 97 == 1 else toxic, "clash"))
    rows += [(2000, None, None, None, None, None, None), (2001, "", "en", "s", "", "", ""), (2002, " .,\n! ", "en", "s", "", "", "")]
    rows += [(None, "no id", "en", "s", "", "", "")] * 2 + [(1, "another text of a known id", "en", "s", "", "", "")]
    labels += [(None, 1, ""), (5, None, ""), (7, 0, ""), (9999, 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")


@pytest.fixture(scope="module")
def model(corpus):
    return train_toxicity(*corpus, crc_mod("doc_id", 5) != 0)


def test_features_of_words():
    subwords = Subwords()
    assert list(subwords.blocks(None)) == list(subwords.blocks("")) == list(subwords.blocks(" ., \n")) == []
    for text in ("idiot", " Idiot!", "\tIDIOT\n", "idiot "):
        (block,) = subwords.blocks(text)
        assert "".join(map(chr, block)) == " idiot "
    (block,) = subwords.blocks("an idiot 𝒜x İ")
    features, owners, words = subwords.features(block)
    grams = {0: 2 + 1, 1: 5 + 4, 2: 2 + 1, 3: 1}
    assert {w: int((owners == w).sum()) for w in range(4)} == {w: n + 1 for w, n in grams.items()}
    (alone,) = subwords.blocks("idiot")
    assert sorted(subwords.features(alone)[0]) == sorted(features[owners == 1])
    assert (features >= 0).all() and (features < BUCKETS).all() and len(words) == 4


def test_score_is_the_worst_window_of_the_network():
    rng = np.random.default_rng(1)
    vectors, weights = rng.normal(0, 1, (BUCKETS, DIMS)).astype(np.float32), rng.normal(0, 1, (DIMS, 2)).astype(np.float32)
    network = ToxicityModel(vectors, weights, 0.3, 1.0, 0.0, 0.5, span=3)
    score, subwords, dice = network.scorer().function(), Subwords(), random.Random(3)
    for words in (1, 2, 3, 50):
        split = sentence(dice, words)
        bags = []
        for word in split:
            (block,) = subwords.blocks(word)
            bags.append(vectors[subwords.features(block)[0]].mean(axis=0))
        probabilities = []
        for start in range(max(1, words - 2)):
            logits = np.mean(bags[start : start + 3], axis=0) @ weights
            probabilities.append(1 / (1 + np.exp(logits[0] - logits[1] - 0.3)))
        assert score(" ".join(split)) == pytest.approx(max(probabilities), abs=1e-5)


def test_very_long_texts_are_scored_whole(model):
    score, words = model.scorer().function(), sentence(random.Random(5), 400_000)
    assert score(" ".join(words)) < 0.5
    assert score(" ".join([*words, "you", "idiotic", "fool"])) > 0.5
    assert score("ka" * 700_000) < 0.5


def test_held_out_texts(corpus, model):
    docs, labels = corpus
    scores = {r.doc_id: (r.score, r.predicted) for r in score_toxicity(docs, model, "doc_id", "lang").collect()}
    told = docs.where((crc_mod("doc_id", 5) == 0) & (F.col("doc_id") < 900)).collect()
    truth = {r.doc_id: any(w in r.text for w in INSULTS) for r in told}
    assert len(truth) > 100
    caught = [scores[d][1] for d, toxic in truth.items() if toxic]
    clean = [scores[d][1] for d, toxic in truth.items() if not toxic]
    assert np.mean(caught) > 0.9 and np.mean(clean) < 0.05
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p in scores.values())


def test_misspellings_share_ngrams(model):
    score = model.scorer().function()
    for word in ("idiotics", "worthlesss", "disgustingly", "patheticc"):
        assert score(f"ka lo {word} mine ru") > score("ka lo mineru mine ru") and score(f"mi {word}") > 0.5


def test_odd_rows(spark, corpus, model):
    docs, _ = corpus
    found = score_toxicity(docs, model, "doc_id")
    assert found.count() == docs.count()
    assert {tuple(r) for r in found.where("doc_id >= 2000").collect()} == {(2000, 0.0, 0), (2001, 0.0, 0), (2002, 0.0, 0)}
    assert score_toxicity(docs.limit(0), model, "doc_id").collect() == []


def test_without_two_classes(spark, corpus):
    docs, labels = corpus
    for chosen, wanted in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0)):
        model = train_toxicity(docs, chosen, F.lit(True))
        found = {r.score for r in score_toxicity(docs.where("doc_id < 900"), model, "doc_id").collect()}
        assert found == {wanted}
    assert train_toxicity(docs.limit(0), labels, F.lit(True)).prior == 0.0


def test_the_sample_is_bounded(spark):
    """An id on very many rows, or very many equal rows, gives a few texts."""
    from filetwin.llm.toxicity import _sample

    docs = spark.range(6000).select(
        F.when(F.col("id") < 2000, 1).when(F.col("id") < 4000, 2).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") < 2000, "same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"),
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    sample = _sample(docs, labels, F.lit(True), 100, 8)
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert all(60 < n < 150 for n in counts.values())
    everything = _sample(docs, labels, F.lit(True), 10_000, 8)
    assert everything.where("doc_id = 1").count() <= 1 and everything.where("doc_id = 2").count() < 30


def test_query(spark):
    found = queries.op13_toxicity(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == 200 and found.where("held_out").count() > 0
