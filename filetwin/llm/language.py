"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Bigrams and trigrams of lower-cased letters, with one blank for every run of other characters, are
hashed to DIMS features. Document frequencies and class sizes come from all training rows. The
classifier itself is fitted on a bounded sample, `per_class` rows a class in expectation: the sample
is dealt to shards of about `shard_rows` rows, each shard runs follow-the-regularised-leader with
elastic-net penalties, and the shards' weights are averaged. A fifth of the sample is kept out of the
fit and picks the temperature that the logits are divided by.

Texts that are null or have no letter get `und` with score 0, and so does every text when there are
no labelled rows. Null labels are not learned. Labels beyond the `max_classes` most frequent ones are
not learned, which bounds the model that tasks receive (DIMS x max_classes weights).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow_map, arrow_runs

DIMS = 1 << 16
_BLANK = 32


def _letters() -> np.ndarray:
    table = np.full(0x10000, _BLANK, np.uint32)
    for code in range(0x10000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


class Grams:
    """Texts to hashed n-gram counts."""

    def __init__(self) -> None:
        self.table = _letters()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Feature numbers and their counts; None for a text without letters."""
        if not text:
            return None
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if int(codes.max()) < 0x10000:
            codes = self.table[codes]
        else:
            low, high = np.minimum(codes, 0xFFFF), codes >= 0x10000
            mapped = self.table[low]
            for code in np.unique(codes[high]):
                mapped[codes == code] = code if chr(int(code)).isalpha() else _BLANK
            codes = mapped
        blank = codes == _BLANK
        if blank.all():
            return None
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        codes = np.concatenate(([_BLANK], codes[keep], [_BLANK])).astype(np.uint32)
        first = codes * np.uint32(0x9E3779B1)
        two = first[:-1] ^ (codes[1:] * np.uint32(0x85EBCA6B))
        three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
        both = np.concatenate((two, three))
        both ^= both >> np.uint32(15)
        both *= np.uint32(0x2C1B3C6D)
        both >>= np.uint32(32 - 16)
        if len(both) < 3000:
            return np.unique(both, return_counts=True)
        counts = np.bincount(both, minlength=DIMS)
        found = np.flatnonzero(counts)
        return found, counts[found]


def _weighted(grams: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    features, counts = grams
    values = (1 + np.log(counts)) * idf[features]
    return features, values / np.sqrt(values @ values)


@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, grams: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, float]:
        if grams is None or not self.labels:
            return "und", 0.0
        features, values = _weighted(grams, self.idf)
        logits = (values @ self.weights[features]) / self.temperature
        shares = np.exp(logits - logits.max())
        best = int(shares.argmax())
        return self.labels[best], float(shares[best] / shares.sum())


def _frequencies(training: DataFrame) -> np.ndarray:
    """In how many training texts each feature occurs; the last entry is the number of texts."""

    def run(batches: Iterable[pa.RecordBatch]):
        grams, totals = Grams(), np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (found := grams(text)) is not None:
                    totals[found[0]] += 1
                    totals[DIMS] += 1
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(totals[seen])], ["feature", "n"])

    parts = arrow_runs(training.select("text"), run, "feature int, n long")
    totals = np.zeros(DIMS + 1, np.int64)
    for feature, n in parts.groupBy("feature").agg(F.sum("n")).collect():  # at most DIMS + 1 rows
        totals[feature] = n
    return totals


def _ftrl(rows: pd.DataFrame, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after `epochs` passes over the shard's rows."""
    z, n = np.zeros((DIMS, classes), np.float32), np.zeros((DIMS, classes), np.float32)

    def weights(z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for label, features, values in zip(rows["label"], rows["features"], rows["values"], strict=True):
            features, values = np.asarray(features), np.asarray(values, np.float32)
            old_z, old_n = z[features], n[features]
            w = weights(old_z, old_n)
            logits = values @ w
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            gradient = values[:, None] * error
            grown = old_n + gradient * gradient
            z[features] = old_z + gradient - (np.sqrt(grown) - np.sqrt(old_n)) / alpha * w
            n[features] = grown
    return weights(z, n)


def train_language_model(
    docs: DataFrame,
    is_training: Column,
    per_class: int = 1500,
    shard_rows: int = 1500,
    max_classes: int = 256,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
) -> LanguageModel:
    """Fits on the rows of `docs` (`doc_id`, `text`, `lang`) for which `is_training` holds."""
    training = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", "lang"
    )
    sizes = training.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_classes).collect()
    labels = sorted(r["lang"] for r in sizes)
    totals = _frequencies(training)
    idf = np.log((1 + totals[DIMS]) / (1 + totals[:DIMS])) + 1
    if not labels or not totals[DIMS]:
        return LanguageModel([], idf, np.zeros((DIMS, 0), np.float32), 1.0)

    steps = 1 << 20
    share = {r["lang"]: min(steps, -(-per_class * steps // r["count"])) for r in sizes}
    number = {label: k for k, label in enumerate(labels)}
    limits = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(steps))
    sampled = training.where(place < F.coalesce(F.element_at(limits, F.col("lang")), F.lit(0)))
    shards = max(1, sum(min(per_class, r["count"]) for r in sizes) // shard_rows)
    shared_idf = docs.sparkSession.sparkContext.broadcast(idf)

    def featurize():
        grams = Grams()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, lang, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (found := grams(text)) is not None:
                    features, values = _weighted(found, shared_idf.value)
                    rows.append((number[lang], part, features.astype(np.int32), values.astype(np.float32)))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            names = ("label", "part", "features", "values")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return step

    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5 * shards)).cast("int")
    sample = materialize(
        arrow_map(
            sampled.select("text", "lang", part.alias("part")),
            featurize,
            "label int, part int, features array<int>, `values` array<float>",
        ),
        "language-sample",
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        w = _ftrl(rows, len(labels), epochs, alpha, beta, l1, l2)
        feature, label = np.nonzero(w)
        return pd.DataFrame({"feature": feature, "label": label, "weight": w[feature, label].astype(float)})

    fitted = (
        sample.where(F.col("part") % 5 != 0)
        .withColumn("shard", F.col("part") % shards)
        .groupBy("shard")
        .applyInPandas(fit, "feature int, label int, weight double")
        .groupBy("feature", "label")
        .agg(F.sum("weight").alias("weight"))
    )
    weights = np.zeros((DIMS, len(labels)), np.float32)
    for feature, label, weight in fitted.collect():  # at most DIMS x max_classes
        weights[feature, label] = weight / shards

    shared = docs.sparkSession.sparkContext.broadcast(weights)
    grid = 2.0 ** np.linspace(-5, 3, 33)

    def losses():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            total = np.zeros(len(grid))
            for label, features, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                logits = np.asarray(values) @ shared.value[np.asarray(features)]
                scaled = logits[None, :] / grid[:, None]
                top = scaled.max(axis=1)
                total += np.log(np.exp(scaled - top[:, None]).sum(axis=1)) + top - scaled[:, label]
            return pa.RecordBatch.from_arrays([pa.array(grid), pa.array(total)], ["temperature", "loss"])

        return step

    held = sample.where(F.col("part") % 5 == 0).select("label", "features", "values")
    scores = arrow_map(held, losses, "temperature double, loss double").groupBy("temperature").agg(F.sum("loss"))
    best = min(((loss, t) for t, loss in scores.collect()), default=(0.0, 1.0))
    return LanguageModel(labels, idf, weights, float(best[1]))


def predict_language(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """The columns `keep` of `docs`, then `lang_pred` and `score`; only `text` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def make():
        grams = Grams()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shared.value.predict(grams(t)) for t in batch.column(0).to_pylist()]
            columns = [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found])]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        return step

    return arrow_map(docs.select(F.col("text").alias("_text"), *keep), make, schema)


def keep_known_language(docs: DataFrame, model: LanguageModel, min_score: float = 0.3) -> DataFrame:
    """The rows, unchanged, whose language is recognised with at least `min_score`.

    Without a single labelled training row no language can be told apart; then all rows whose text has letters stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def make():
        grams = Grams()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(place).to_pylist()
            if not shared.value.labels:
                return batch.filter(pa.array([grams(t) is not None for t in texts], pa.bool_()))
            found = (shared.value.predict(grams(t)) for t in texts)
            return batch.filter(pa.array([name != "und" and score >= min_score for name, score in found], pa.bool_()))

        return step

    return arrow_map(docs, make, docs.schema)
