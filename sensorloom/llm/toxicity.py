"""Toxicity of documents: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space made single, and the character n-grams that lie inside a word, with its
edges, are hashed into buckets. A document has a bucket or not. Each bucket is scaled by the logarithm of the
ratio of its smoothed shares in the toxic and in the clean training documents; logistic regression on the
scaled features gives the weights. Ratio and weight multiply to one number per bucket, so a model is one small array
that goes to the executors with the code, and scoring is one pass over the texts without a shuffle.

Training runs in numpy on a bounded sample of the labelled documents, about ``TRAIN_DOCUMENTS`` of each class,
weighted back towards the share that the class has among all training labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.training import fold_of, training_rows

# Labelled documents of each class that the driver takes.
TRAIN_DOCUMENTS = 1_500
SIZES = (3, 4, 5)
BUCKET_BITS = 20
SMOOTHING = 1.0
LEAST_DOCUMENTS = 3
STEPS = 80
# Characters that are hashed at once.
BATCH_CHARS = 1_000_000

_SPACE = re.compile(r"\s+")
_EDGE = np.uint32(32)


def _codes(text: str | None) -> np.ndarray:
    plain = _SPACE.sub(" ", (text or "").lower().encode("utf-8", "replace").decode("utf-8")).strip()
    return np.frombuffer(f" {plain} ".encode("utf-32-le"), dtype=np.uint32)


def _batches(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points and document numbers of some texts at a time."""
    codes: list[np.ndarray] = []
    numbers: list[int] = []
    size = 0
    for number, text in enumerate(texts):
        codes.append(_codes(text))
        numbers.append(number)
        size += len(codes[-1])
        if size >= BATCH_CHARS:
            yield np.concatenate(codes), np.repeat(numbers, [len(c) for c in codes])
            codes, numbers, size = [], [], 0
    if codes:
        yield np.concatenate(codes), np.repeat(numbers, [len(c) for c in codes])


def _grams(codes: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document numbers and buckets of the n-grams of one size at a time, repeated ones included."""
    mixed = codes.astype(np.uint64)
    edge = (codes == _EDGE).astype(np.int32)
    edges = np.concatenate([[0], np.cumsum(edge)])
    rolling = np.zeros(len(codes), dtype=np.uint64)
    for size in range(1, max(SIZES) + 1):
        rolling = rolling[: len(codes) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + mixed[size - 1 :] + np.uint64(size)
        if size not in SIZES or not len(rolling):
            continue
        last = size - 1
        # Only the first and the last character may be white space, and both belong to one document.
        inner = edges[last : last + len(rolling)] - edges[1 : 1 + len(rolling)]
        kept = (inner == 0) & (numbers[: len(rolling)] == numbers[last:])
        value = rolling[kept]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield numbers[: len(rolling)][kept], (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _present(texts: Sequence[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and buckets, each pair once, sorted; only the wanted buckets if a mask is given."""
    found = []
    for codes, numbers in _batches(texts):
        pairs = []
        for document, bucket in _grams(codes, numbers):
            if wanted is not None:
                use = wanted[bucket]
                document, bucket = document[use], bucket[use]
            pairs.append(np.unique((document << BUCKET_BITS) | bucket))
        found.append(np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64))
    pairs = np.concatenate(found) if found else np.empty(0, np.int64)
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


@dataclass(frozen=True)
class ToxicityModel:
    """What each bucket adds to the log-odds, and what every text starts with."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        document, bucket = _present(texts, self.weights != 0)
        odds = self.bias + np.bincount(document, self.weights[bucket].astype(np.float64), len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def train(
    texts: Sequence[str | None], labels: Sequence[int], share: float | None = None, penalty: float = 1.0
) -> ToxicityModel:
    """Fit by full gradient steps (Adam), the same for the same rows.

    ``share`` is the part of label 1 among all labelled rows, from which the sample may differ. Without both
    classes every score is that share, or 0.5 without rows.
    """
    truth = np.asarray(labels, dtype=np.float64)
    buckets = 1 << BUCKET_BITS
    if share is None or not 0 < share < 1:
        share = (truth.sum() + 0.5) / (len(truth) + 1.0)
    document, bucket = _present(texts)
    toxic = np.bincount(bucket, truth[document], buckets) if len(document) else np.zeros(buckets)
    seen = np.bincount(bucket, minlength=buckets)
    if truth.sum() in (0, len(truth)) or not len(document):
        return ToxicityModel(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    p = (toxic + SMOOTHING) / (truth.sum() + 2 * SMOOTHING)
    q = (seen - toxic + SMOOTHING) / (len(truth) - truth.sum() + 2 * SMOOTHING)
    ratio = np.where(seen >= LEAST_DOCUMENTS, np.log(p / q), 0.0)
    used = np.flatnonzero(np.abs(ratio) > 0.7)
    place = np.full(buckets, -1)
    place[used] = np.arange(len(used))
    keep = place[bucket] >= 0
    document, column = document[keep], place[bucket[keep]]
    scale = ratio[used]
    weight, bias = np.zeros(len(used)), float(np.log(share / (1 - share)))
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    # A missed toxic document costs more than a lost clean one: the class counts half way, in log-odds, between
    # its true share and one half.
    odds = (share / (1 - share)) ** 0.5
    counted = odds / (1 + odds)
    balance = np.where(truth == 1, counted / truth.mean(), (1 - counted) / (1 - truth.mean()))
    for step in range(1, STEPS + 1):
        odds = bias + np.bincount(document, (weight * scale)[column], len(truth))
        error = balance * (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - truth) / len(truth)
        slope = np.bincount(column, error[document], len(used)) * scale + penalty * weight / max(1, len(used)) ** 0.5
        slope = np.append(slope, error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = 0.03 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    weights = np.zeros(buckets, np.float32)
    weights[used] = weight * scale
    return ToxicityModel(weights, float(bias))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = TRAIN_DOCUMENTS,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> ToxicityModel:
    """Model from the labelled documents outside the held-out fold. NULL labels and texts are not used."""
    rows = training_rows(docs, labels, label, per_class, key, text)
    usable = labels.filter(fold_of(key) != 0)
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train([t for t, _ in rows], [int(value) for _, value in rows], share)


def toxicity_score(model: ToxicityModel, text: str = "text") -> Column:
    """Score from 0 to 1 of a whole text; NULL and empty texts score what the model starts with."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return score(F.col(text))


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Documents with ``score`` and ``predicted`` (1 from 0.5 on); columns of these names are replaced."""
    rows = docs.withColumn("score", toxicity_score(model, text))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Documents that are not predicted toxic, with their own columns."""
    toxic = toxicity_score(fit_toxicity(docs, labels, text=text), text) >= 0.5
    return docs.filter(~toxic)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return rows.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", "predicted")
