"""Operator 2: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three characters of the lower-cased text (digits and ASCII punctuation count as a space) are hashed
into 2^16 places.  The model is trained by follow-the-regularised-leader, per coordinate, with elastic-net
penalties, so most weights are exactly zero; a temperature fitted on a part of the sample that it did not see makes
its probabilities honest.  Document frequencies count all labelled rows; the weights are fitted on a bounded sample
of them (``SAMPLE`` per language), of which only n-gram counts leave the executors; prediction is a column over whole texts, without a shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is everything if no row is
labelled; rows without a label or a text are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import documents, held_out, unused

UNKNOWN = "und"
PLACES = 1 << 16
# Labelled rows per language that the model is fitted on, at most; a fifth of them set the temperature.
SAMPLE = 300
# Features kept: the n-grams found in most documents.
FEATURES = 4096
EPOCHS = 6
# Of follow-the-regularised-leader: step, damping, and the two penalties.
STEP, DAMPING, L1, L2 = 0.5, 1.0, 0.5, 0.01
_PLAIN = {n: 32 for n in range(128) if not chr(n).isalpha()}


def ngrams(text: str) -> np.ndarray:
    """The place of every n-gram of the text, repeats included."""
    c = np.frombuffer(text.lower().translate(_PLAIN).encode("utf-32-le"), np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    return np.concatenate([one, two, three]) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    feature: np.ndarray  # for each place its feature from 1, or 0
    idf: np.ndarray  # by feature; feature 0 counts nothing
    weights: np.ndarray  # language x feature
    bias: np.ndarray
    temperature: float

    def vector(self, places: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """The unit TF-IDF vector of a text's n-grams, frequencies damped by a logarithm."""
        found = np.bincount(self.feature[places], counts, len(self.idf))
        x = np.log1p(found) * self.idf
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax((self.weights @ x + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(self.vector(ngrams(text)))
        best = int(p.argmax())  # the first of equals
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (class x feature) and biases after ``EPOCHS`` passes in a fixed shuffled order."""
    x = np.hstack([x, np.ones((len(x), 1))])
    z, n, w = (np.zeros((classes, x.shape[1])) for _ in range(3))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            at = np.flatnonzero(x[i])
            shrunk = np.sign(z[:, at]) * np.maximum(np.abs(z[:, at]) - L1, 0)
            w[:, at] = -shrunk / ((DAMPING + np.sqrt(n[:, at])) / STEP + L2)
            p = _softmax(w[:, at] @ x[i, at])
            p[y[i]] -= 1
            g = p[:, None] * x[i, at]
            root = np.sqrt(n[:, at] + g * g)
            z[:, at] += g - (root - np.sqrt(n[:, at])) / STEP * w[:, at]
            n[:, at] += g * g
    return w[:, :-1], w[:, -1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm.

    A row's target is (n + 1) / (n + 2) instead of 1, so that a sample without errors doesn't ask for certainty.
    """
    if not len(y):
        return 1.0
    target = (len(y) + 1) / (len(y) + 2)

    def loss(log_t: float) -> float:
        p = np.clip(_softmax(logits / np.exp(log_t))[np.arange(len(y)), y], 1e-12, 1 - 1e-12)
        return float(-(target * np.log(p) + (1 - target) * np.log(1 - p)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each place occurs."""
    total = np.zeros(PLACES, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen = np.zeros(PLACES, np.int64)
            seen[ngrams(text)] = 1
            total += seen
    place = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(total[place])], ["place", "n"])


def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [np.unique(ngrams(x or ""), return_counts=True) for x in texts]
        yield pd.DataFrame({"places": [a.astype(np.int32) for a, _ in rows], "counts": [b.astype(np.int32) for _, b in rows]})


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns text and lang of rows that are not held out; at most about ``sample`` rows of each language."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(rows.groupBy("lang").count().collect())  # a row per language
    languages = sorted(sizes)
    empty = Model([], np.zeros(PLACES, np.int32), np.zeros(1), np.zeros((0, 1)), np.zeros(0), 1.0)
    if not languages:
        return empty
    # rows in the order of a hash of their id: the first of each language, about as many as asked for
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int(min(1.0, sample / n) * (1 << 30)))])
    drawn = rows.where(draw < share[F.col("lang")]).select("lang", "text", draw.alias("draw"), F.col("doc_id").alias("id"))
    drawn = drawn.orderBy("draw", "id").limit(2 * sample * len(languages))
    made = F.pandas_udf(_counts, "places array<int>, counts array<int>")(F.col("text"))
    drawn = drawn.select("lang", made.alias("x"), "draw").select("lang", "x.*", "draw").toPandas().sort_values("draw", kind="stable")
    # document frequencies are those of all rows that may be learned from: a row per place, partial sums by task
    frequencies = rows.select("text").mapInArrow(_frequencies, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(PLACES, np.int64)
    found[frequencies.place] = frequencies.n
    kept = np.argsort(-found, kind="stable")[:FEATURES]
    kept = np.sort(kept[found[kept] > 1])
    feature = np.zeros(PLACES, np.int32)
    feature[kept] = np.arange(1, len(kept) + 1)
    idf = np.r_[0.0, np.log((1 + sum(sizes.values())) / (1 + found[kept])) + 1]
    model = Model(languages, feature, idf, np.zeros((len(languages), len(idf))), np.zeros(len(languages)), 1.0)
    x = np.array([model.vector(np.asarray(p), np.asarray(c)) for p, c in zip(drawn.places, drawn.counts, strict=True)])
    y = np.array([languages.index(lang) for lang in drawn.lang], int)
    aside = np.arange(len(y)) % 5 == 4
    if len(y):
        model.weights, model.bias = follow_the_leader(x[~aside], y[~aside], len(languages))
        model.temperature = fit_temperature(x[aside] @ model.weights.T + model.bias, y[aside])
    return model


def identify(text: Column, model: Broadcast[Model]) -> Column:
    """struct(lang_pred, score) of a text column."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.value.predict(x) for x in texts], columns=["lang_pred", "score"])

    return F.pandas_udf(of, "lang_pred string, score double")(text)


def drop_unknown(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents that have a language, with a probability of ``least``; the others have no letter.  docs' own columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    (found,) = unused(docs.columns, "found")
    marked = docs.withColumn(found, identify(F.col("text"), model))
    known = (F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= least)
    return marked.where(known).select(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = spark.sparkContext.broadcast(fit(docs))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
