"""Toxicity of texts: subword-bag embeddings averaged into a linear softmax.

A word is a run of letters and digits, lower-cased. Its features are the word itself and its character n-grams
of 3 and 4 characters, blanks at its ends included, hashed to BUCKETS embedding rows; its vector is the
mean of theirs, so a misspelling that no training text holds still shares most n-grams with the word it stands
for. The vectors of up to `span` consecutive words are averaged and go through a linear softmax over two
classes. A text is as toxic as its worst such window: the average of a whole long text would drown a
single insult. All windows of a text are looked at, however long it is.

Embeddings and softmax are learned together, in numpy, in one task, on a bounded sample: of the labelled
training rows about `per_class` ids a class and at most about `copies` different texts an id, and of a text with
more than `max_words` words that many in pieces chosen at random (this bounds the fit only; scoring takes whole texts).
Gradients go through whole texts in the first epochs, then through each text's worst window. A fifth of
the sample is kept out of the fit; it chooses the epoch and calibrates the scores.

Null and empty texts and texts without a letter or digit have no window and get the score 0. An id with several
labels is toxic if one says so; null labels and null ids teach nothing. Repeated rows are each scored; equal
texts of an id are learned once. Without a training text of both classes every other score is the share of toxic
training ids, 0 if there are none. An empty table gives no rows. Of columns other than `doc_id` and `text` none is
looked at, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow_map

BUCKETS = 1 << 18
DIMS = 16
SPAN = 3
_PIECE = 32
_BLANK = 32
_BLOCK = 1 << 19


def _alphabet() -> np.ndarray:
    """Letters and digits to their lower case, all else to a blank; further planes are kept as they are."""
    table = np.full(0x10000, _BLANK, np.uint32)
    for code in range(0x10000):
        if (sign := chr(code)).isalnum():
            table[code] = ord(low) if len(low := sign.lower()) == 1 else code
    return table


class Subwords:
    """Texts to the hashed features of their words."""

    def __init__(self) -> None:
        self.table = _alphabet()

    def blocks(self, text: str | None) -> Iterator[np.ndarray]:
        """The text's words with one blank around each, in blocks that end with a word."""
        if not text:
            return
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 0x10000, self.table[np.minimum(codes, 0xFFFF)], codes)
        blank = codes == _BLANK
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        codes = np.concatenate(([_BLANK], codes[keep], [_BLANK])).astype(np.uint32)
        if len(codes) > 2 and codes[1] == _BLANK:
            codes = codes[1:]
        if codes[-2] == _BLANK:
            codes = codes[:-1]
        if len(codes) < 3:
            return
        blanks = np.flatnonzero(codes == _BLANK)
        start = 0
        while start < len(codes) - 1:
            # The first blank at or behind the block's end: no word is cut, however long.
            end = blanks[min(np.searchsorted(blanks, start + _BLOCK), len(blanks) - 1)]
            yield codes[start : end + 1]
            start = int(end)

    @staticmethod
    def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a block: all features, the number of the word that each belongs to, and a 64-bit hash per word."""
        blank = codes == _BLANK
        word = np.cumsum(blank) - 1
        starts = np.flatnonzero(blank)[:-1] + 1
        inner = np.flatnonzero(~blank)
        place = (inner - starts[word[inner]]).astype(np.uint64)
        mixed = (codes[inner].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= (place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        first = np.searchsorted(inner, starts)
        whole = np.add.reduceat(mixed, first)
        features, owners = [(whole >> np.uint64(20)).astype(np.uint32)], [np.arange(len(starts))]
        rolled = codes * np.uint32(0x9E3779B1)
        clean = np.ones(len(codes), bool)
        for size in range(2, 5):
            if len(codes) < size:
                break
            rolled = (rolled[:-1] * np.uint32(0x27D4EB2F)) ^ (codes[size - 1 :] * np.uint32(0x85EBCA6B))
            if size < 3:
                continue
            # Blanks may stand at both ends of an n-gram, not within.
            clean = (clean[: len(rolled)] if size == 3 else clean[:-1]) & ~blank[size - 2 : size - 2 + len(rolled)]
            at = np.flatnonzero(clean)
            features.append(rolled[at] + np.uint32(size))
            owners.append(word[at + 1])
        found = np.concatenate(features)
        found = (found ^ (found >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found ^= found >> np.uint32(13)
        return (found % np.uint32(BUCKETS)).astype(np.int32), np.concatenate(owners), whole


def _worst(words: np.ndarray, span: int) -> tuple[int, float]:
    """Start and mean of the window with the largest mean; a shorter text is one window."""
    width = min(span, len(words))
    sums = np.concatenate(([0.0], np.cumsum(words)))
    means = (sums[width:] - sums[:-width]) / width
    start = int(means.argmax())
    return start, float(means[start])


@dataclass(frozen=True)
class Scorer:
    """What tasks need to score texts: the network is linear behind the averages, so one number a feature."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float
    prior: float
    span: int

    def function(self):
        """From a text to its score."""
        subwords = Subwords()

        def score(text: str | None) -> float:
            if not self.slope:
                return self.prior if next(subwords.blocks(text), None) is not None else 0.0
            parts = []
            for block in subwords.blocks(text):
                features, owners, words = subwords.features(block)
                sums = np.bincount(owners, self.table[features], len(words))
                parts.append(sums / np.bincount(owners, minlength=len(words)))
            if not parts:
                return 0.0
            logit = _worst(np.concatenate(parts), self.span)[1] + self.bias
            return float(_sigmoid(self.slope * logit + self.offset))

        return score


@dataclass(frozen=True)
class ToxicityModel:
    """`vectors` (buckets x dims) and `weights` (dims x 2) of the network; slope and offset of the calibration.

    A slope of 0 stands for a model without training texts of both classes.
    """

    vectors: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    prior: float
    span: int = SPAN

    def scorer(self) -> Scorer:
        table = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])
        return Scorer(table, self.bias, self.slope, self.offset, self.prior, self.span)


class _Texts:
    """The sample as word numbers, with each word's features once."""

    def __init__(self, texts: list[str | None], max_words: int, seed: int) -> None:
        subwords, numbers = Subwords(), {}
        lists, self.texts = [], []
        for n, text in enumerate(texts):
            ids = []
            for block in subwords.blocks(text):
                features, owners, words = subwords.features(block)
                order = np.argsort(owners, kind="stable")
                features, ends = features[order], np.cumsum(np.bincount(owners, minlength=len(words)))
                for k, word in enumerate(words.tolist()):
                    if (number := numbers.get(word)) is None:
                        number = numbers[word] = len(lists)
                        lists.append(features[ends[k - 1] if k else 0 : ends[k]])
                    ids.append(number)
            ids = np.array(ids, np.int64)
            if len(ids) > max_words:
                pieces = np.random.default_rng((seed, n)).choice(len(ids) // _PIECE, max_words // _PIECE, replace=False)
                ids = ids[(np.sort(pieces)[:, None] * _PIECE + np.arange(_PIECE)).ravel()]
            self.texts.append(ids)
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.features = np.concatenate(lists) if lists else np.zeros(0, np.int32)

    def features_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of these words, and which of the words each belongs to."""
        sizes = self.sizes[words]
        owner = np.repeat(np.arange(len(words)), sizes)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.features[self.starts[words][owner] + shift], owner

    def word_scores(self, rows: np.ndarray, table: np.ndarray, kept: np.ndarray | None = None) -> list[np.ndarray]:
        """For each of these texts, the score of each of its words, from all features or the `kept` ones."""
        used, places = np.unique(np.concatenate([self.texts[row] for row in rows]), return_inverse=True)
        features, owner = self.features_of(used)
        sizes = self.sizes[used]
        if kept is not None:
            some = kept[features]
            features, owner = features[some], owner[some]
            sizes = np.maximum(np.bincount(owner, minlength=len(used)), 1)
        scores = np.bincount(owner, table[features], len(used)) / sizes
        return np.split(scores[places], np.cumsum([len(self.texts[row]) for row in rows])[:-1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _calibrated(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of a logistic regression on the logit, slightly shrunk, and its loss."""
    x = np.stack((logits / 10, np.ones_like(logits)), axis=1)
    theta, towards = np.array([10.0, 0.0]), np.array([10.0, 0.0])
    for _ in range(100):
        p = _sigmoid(x @ theta)
        gradient = x.T @ (weight * (p - toxic)) + 1e-2 * (theta - towards)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    if theta[0] <= 0:
        theta = towards
    p = np.clip(_sigmoid(x @ theta), 1e-9, 1 - 1e-9)
    loss = -(weight * np.where(toxic > 0, np.log(p), np.log(1 - p))).sum() / weight.sum()
    return float(theta[0] / 10), float(theta[1]), float(loss)


def fit(
    texts: list[str | None],
    toxic: np.ndarray,
    weight: np.ndarray,
    span: int = SPAN,
    warm: int = 2,
    epochs: int = 6,
    rate: float = 0.5,
    drop: float = 0.5,
    batch: int = 64,
    max_words: int = 1536,
    seed: int = 1,
) -> ToxicityModel:
    """Learns embeddings, softmax and calibration from these texts; `weight`: how many rows a text stands for."""
    rng = np.random.default_rng(seed)
    data = _Texts(texts, max_words, seed)
    toxic = toxic.astype(np.float64)
    prior = float((weight * toxic).sum() / weight.sum()) if len(toxic) else 0.0
    usable = np.array([len(t) > 0 for t in data.texts], bool)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMS)).astype(np.float32) * np.float32(0.1 / DIMS)
    weights = rng.normal(0, 1, (DIMS, 1)).astype(np.float32)
    weights = np.concatenate((-weights, weights), axis=1) / np.float32(2 * np.linalg.norm(weights))
    held = rng.permutation(len(toxic)) % 5 == 0
    rows, apart = np.flatnonzero(usable & ~held), np.flatnonzero(usable & held)
    share = np.array([(toxic[rows] == c).sum() for c in (0, 1)], np.float64)
    if not share.all():
        return ToxicityModel(vectors[:0], weights, 0.0, 0.0, 0.0, prior, span)
    balance = share.sum() / (2 * share)
    judged = 0 < toxic[apart].sum() < len(apart)
    seen, seen_weights, bias, seen_bias = np.zeros(BUCKETS), np.zeros_like(weights, np.float64), 0.0, 0.0
    best, chosen_model = np.inf, None

    for epoch in range(epochs):
        order = rng.permutation(rows)
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            direction = weights[:, 1] - weights[:, 0]
            # Words are told from a part of their features, so that no single n-gram stands for a word.
            kept = rng.random(BUCKETS) >= drop
            scores = data.word_scores(chosen, vectors @ direction, kept)
            ids, errors, total = [], [], 0.0
            for row, words in zip(chosen, scores, strict=True):
                own = data.texts[row]
                if epoch >= warm:
                    start, logit = _worst(words, span)
                    own = own[start : start + span]
                else:
                    logit = words.mean()
                error = (_sigmoid(logit + bias) - toxic[row]) * balance[int(toxic[row])]
                ids.append(own)
                errors.append(np.full(len(own), error / len(own)))
                total += error
            # All words of a window share its error: first per word, then per feature.
            used, places = np.unique(np.concatenate(ids), return_inverse=True)
            pull = np.bincount(places, np.concatenate(errors))
            features, owner = data.features_of(used)
            some = kept[features]
            features, owner = features[some], owner[some]
            pull /= np.maximum(np.bincount(owner, minlength=len(used)), 1)
            touched, places = np.unique(features, return_inverse=True)
            gradient = np.bincount(places, pull[owner])
            mean = gradient @ vectors[touched]
            seen[touched] += gradient**2
            # The start keeps a feature that is met once from taking a full step.
            step = rate * gradient / (np.sqrt(seen[touched]) + 0.02)
            vectors[touched] -= (step[:, None] * direction).astype(np.float32)
            slope = np.stack((-mean, mean), axis=1)
            seen_weights += slope**2
            weights -= (0.025 * slope / (np.sqrt(seen_weights) + 1e-8)).astype(np.float32)
            seen_bias += total**2
            bias -= rate * total / (np.sqrt(seen_bias) + 1e-8)

        if epoch < warm and epoch < epochs - 1:
            continue
        slope, offset, loss = 1.0, 0.0, 0.0
        if judged:
            table = vectors @ (weights[:, 1] - weights[:, 0])
            parts = [data.word_scores(apart[k : k + batch], table) for k in range(0, len(apart), batch)]
            logits = np.array([_worst(words, span)[1] + bias for part in parts for words in part])
            slope, offset, loss = _calibrated(logits, toxic[apart], weight[apart] / weight[apart].mean())
        if loss < best or not judged:
            best = loss
            chosen_model = ToxicityModel(vectors.copy(), weights.copy(), bias, slope, offset, prior, span)
    return chosen_model


def _sample(docs: DataFrame, labels: DataFrame, is_training: Column, per_class: int, copies: int) -> DataFrame:
    """(text, toxic, weight) of a bounded number of labelled training texts."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & is_training)
    told = told.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # Ids only: texts are not moved before the sample is known.
    present = docs.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    present = materialize(present.join(told, "doc_id"), "toxicity-labels")
    sizes = dict(present.groupBy("toxic").count().collect())  # two rows
    steps = 1 << 30
    share = F.lit(0)
    weight = F.lit(0.0)
    for label, size in sizes.items():
        share = F.when(F.col("toxic") == label, min(steps, -(-per_class * steps // size))).otherwise(share)
        weight = F.when(F.col("toxic") == label, max(1.0, size / per_class)).otherwise(weight)
    ids = present.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(steps)) < share)
    ids = materialize(ids.withColumn("weight", weight), "toxicity-ids")
    # About `per_class` ids a class, whatever the tables' sizes; an id on very many rows gives a few of them.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    place = F.pmod(F.xxhash64("text", F.lit("copies")), F.lit(steps))
    rows = rows.where((F.col("n") <= copies) | (place * F.col("n") < F.lit(copies * steps)))
    return materialize(rows.dropDuplicates(["doc_id", "text"]).select("doc_id", "text", "toxic", "weight"), "toxicity-sample")


def train_toxicity(
    docs: DataFrame, labels: DataFrame, is_training: Column, per_class: int = 2000, copies: int = 8, **settings
) -> ToxicityModel:
    """Learns from the texts of `docs` whose `doc_id` has a label in `labels` (`doc_id`, `toxic`) and satisfies `is_training`."""
    sample = _sample(docs, labels, is_training, per_class, copies)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        m = fit(rows["text"].tolist(), rows["toxic"].to_numpy(), rows["weight"].to_numpy(), **settings)
        numbers = [m.bias, m.slope, m.offset, m.prior]
        return pd.DataFrame({"vectors": [m.vectors.tobytes()], "weights": [m.weights.tobytes()], "numbers": [numbers]})

    # One group, of bounded size, so that embeddings and softmax are learned jointly.
    fitted = sample.groupBy(F.lit(1).alias("one")).applyInPandas(
        learn, "vectors binary, weights binary, numbers array<double>"
    )
    row = fitted.first()
    if row is None:
        return ToxicityModel(np.zeros((0, DIMS), np.float32), np.zeros((DIMS, 2), np.float32), 0.0, 0.0, 0.0, 0.0)
    vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, DIMS)
    weights = np.frombuffer(row["weights"], np.float32).reshape(DIMS, 2)
    return ToxicityModel(vectors, weights, *row["numbers"], span=settings.get("span", SPAN))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """The columns `keep` of `docs`, then `score` and `predicted`; only `text` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def make():
        score = shared.value.function()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([score(text) for text in batch.column(0).to_pylist()], np.float64)
            columns = [*batch.columns[1:], pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        return step

    return arrow_map(docs.select(F.col("text").alias("_text"), *keep), make, schema)
