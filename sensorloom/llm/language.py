"""Language of documents: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased and everything but letters becomes one space. Its character n-grams inside words, with their
edges, are hashed to rows of an embedding table; the mean of the rows, times a matrix, gives one value per language. Both are
trained together by stochastic gradient descent in numpy, on snippets of a bounded sample of labelled documents. A
held-back part of the sample calibrates the softmax's temperature and the score below which a prediction is
rejected.

For scoring, table and matrix multiply to one number per n-gram and language, so a text is the mean of looked-up rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import apart, restored
from sensorloom.llm.training import fold_of, training_rows

# Labelled documents of each language that the driver takes.
TRAIN_DOCUMENTS = 400
# Snippets of a training document, and their lengths in characters.
SNIPPETS = 4
SNIPPET_CHARS = (20, 60, 150, 400)
SIZES = (1, 2, 3)
BUCKET_BITS = 15
DIMENSIONS = 16
EPOCHS = 6
MINIBATCH = 64
RATE = 0.5
# Share of right predictions that the accepted ones of the calibration part reach.
ACCEPTED_ACCURACY = 0.98
BATCH_CHARS = 1_000_000
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")
# All letters, and numbers that are no digits, such as fractions and superscripts.
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode letter category."""
    return any(match[0].isalpha() for match in _LETTER_OR_NUMBER.finditer(text))


def _codes(text: str) -> np.ndarray:
    letters = _NO_LETTERS.sub(" ", text.lower().encode("utf-8", "replace").decode("utf-8"))
    if not letters.replace(" ", "a").isalpha():
        letters = _NO_LETTERS.sub(" ", "".join(c if c.isalpha() else " " for c in letters))
    return np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype=np.uint32)


def _grams(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers (ascending for each size) and buckets of the n-grams of some texts."""
    codes = [_codes(text) for text in texts]
    if not codes:
        return
    numbers = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    joined = np.concatenate(codes)
    space = joined == 32
    rolling = np.zeros(len(joined), dtype=np.uint64)
    for size in range(1, max(SIZES) + 1):
        rolling = rolling[: len(joined) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + joined[size - 1 :] + np.uint64(size)
        last = size - 1
        kept = numbers[: len(rolling)] == numbers[last:]
        if size == 1:
            kept &= ~space
        # White space may only be an edge.
        for inner in range(1, last):
            kept &= ~space[inner : inner + len(rolling)]
        if size == 2:
            kept &= ~(space[: len(rolling)] & space[1:])
        if size in SIZES:
            value = rolling[kept]
            value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            yield numbers[: len(rolling)][kept], (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _all_grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    found = list(_grams(texts))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=1, keepdims=True)
    powers = np.exp(logits)
    return powers / powers.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, what each bucket adds to their logits, the temperature and the least accepted score."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for start, stop in _slices(texts):
            for number, bucket in _grams(texts[start:stop]):
                if not len(number):
                    continue
                first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                total[start + number[first]] += np.add.reduceat(self.table[bucket], first, axis=0)
                count[start : stop] += np.bincount(number, minlength=stop - start)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated score of each text; ``und`` and 0 without a letter or without languages."""
        known = np.array([bool(t) and has_letter(t) for t in texts], dtype=bool)
        if not self.languages:
            known[:] = False
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        places = np.flatnonzero(known)
        if len(places):
            shares = _softmax(self.logits([texts[i] for i in places]) / self.temperature)
            for place, best in zip(places, shares.argmax(axis=1), strict=True):
                names[place] = self.languages[best]
            scores[places] = shares.max(axis=1)
        return names, scores


def _slices(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BATCH_CHARS characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _snippets(rows: Sequence[tuple[str, str]], random: np.random.Generator) -> list[tuple[str, str]]:
    """Pieces of different lengths from all over the training documents."""
    found = []
    for text, language in rows:
        for length in SNIPPET_CHARS[:SNIPPETS]:
            start = int(random.integers(0, max(1, len(text) - length + 1)))
            piece = text[start : start + length]
            if has_letter(piece):
                found.append((piece, language))
    return found


def train(rows: Sequence[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Fit on (text, language) rows; the same rows give the same model. No rows give a model without languages."""
    languages = tuple(sorted({language for _, language in rows}))
    if not languages:
        return LanguageModel((), np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    random = np.random.Generator(np.random.PCG64(seed))
    snippets = _snippets(rows, random)
    order = random.permutation(len(snippets))
    snippets = [snippets[i] for i in order]
    held = snippets[: len(snippets) // 10]
    fitted = snippets[len(held) :]
    number = {language: i for i, language in enumerate(languages)}
    table = random.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    matrix, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    batches = []
    for start in range(0, len(fitted), MINIBATCH):
        part = fitted[start : start + MINIBATCH]
        owner, bucket = _all_grams([text for text, _ in part])
        buckets, column = np.unique(bucket, return_inverse=True)
        # How often each used bucket stands in each snippet, as shares of the snippet.
        shares = np.zeros((len(part), len(buckets)))
        np.add.at(shares, (owner, column), 1.0)
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1)
        truth = np.zeros((len(part), len(languages)))
        truth[np.arange(len(part)), [number[language] for _, language in part]] = 1
        batches.append((buckets, shares.astype(np.float32), truth))
    steps = EPOCHS * len(batches)
    step = 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(batches)):
            buckets, shares, truth = batches[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = shares @ table[buckets]
            error = _softmax(mean @ matrix + bias) - truth
            back = error @ matrix.T
            matrix -= rate * mean.T @ error / np.sqrt(len(truth))
            bias -= 0.01 * rate * error.sum(axis=0)
            table[buckets] -= rate * shares.T @ back
    model = LanguageModel(languages, (table @ matrix).astype(np.float32), bias)
    return _calibrated(model, held or fitted, number)


def _calibrated(model: LanguageModel, held: Sequence[tuple[str, str]], number: dict[str, int]) -> LanguageModel:
    """Temperature with the least log loss, and the lowest score from which predictions are right often enough."""
    logits = model.logits([text for text, _ in held])
    truth = np.array([number[language] for _, language in held])

    def loss(temperature: float) -> float:
        shares = _softmax(logits / temperature)[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(shares, 1e-12)).mean())

    temperature = min((2.0**power for power in np.arange(-4, 4.25, 0.25)), key=loss)
    shares = _softmax(logits / temperature)
    score, right = shares.max(axis=1), shares.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    accuracy = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(accuracy >= ACCEPTED_ACCURACY)
    threshold = float(score[order[good[-1]]]) if len(good) else 1.0
    return LanguageModel(model.languages, model.table, model.bias, float(temperature), threshold)


def fit_language(
    docs: DataFrame, per_language: int = TRAIN_DOCUMENTS, key: str = "doc_id", text: str = "text", label: str = "lang"
) -> LanguageModel:
    """Model from documents with a language outside the held-out fold."""
    rows = training_rows(docs, docs, label, per_language, key, text)
    return train([(content, str(language)) for content, language in rows if has_letter(content)])


def identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Documents with ``lang_pred``, ``score`` and ``accepted`` (the score reaches the calibrated threshold).

    NULL texts and texts without a letter are ``und`` with score 0 and not accepted. Columns of these names are replaced.
    """

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang": names, "score": scores})

    rows = apart(docs, found=predict(F.col(text)))
    sure = (F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= model.threshold)
    return restored(rows, docs.columns, lang_pred=F.col("found.lang"), score=F.col("found.score"), accepted=sure)


def language_digest(docs: DataFrame) -> DataFrame:
    rows = identified(docs.select("doc_id", "text"), fit_language(docs))
    return rows.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score", "accepted")
