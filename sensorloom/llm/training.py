"""Bounded samples of labelled rows for models that are fitted on the driver.

What the driver receives is bounded by the parameters below, whatever the tables hold: the number of label values, of rows, and of
characters of a row. No text is left out for its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.session import stored

FOLDS = 5
# Different label values that a model may have; more are an error.
MOST_CLASSES = 500
# Rows of all classes together; with many classes each has fewer.
MOST_ROWS = 5_000
# Characters of a training text. Of a longer one evenly spaced pieces from all over it are used; scoring takes whole texts.
TRAIN_CHARS = 20_000
PIECES = 20


def fold_of(key: str) -> Column:
    """Checksum of the identifier as text modulo 5; a NULL identifier counts as empty. Fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _place(*values: Column) -> Column:
    """A number from 0 to 1 that follows from the values."""
    return F.shiftrightunsigned(F.xxhash64(*values, F.lit("sample")), 11) / F.lit(float(1 << 53))


def _drawn(rows: DataFrame, label: str, place: Column, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label value, or all if there are fewer: those whose place is below the class's share.

    Counts the rows of every value, a job that runs at once.
    """
    counts = stored(rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n")), "classes")
    classes = counts.count()
    if classes > MOST_CLASSES:
        raise ValueError(f"{classes} values of {label}, more than {MOST_CLASSES}")
    most = min(per_class, MOST_ROWS // max(1, classes))
    rates = counts.select("_label", F.least(F.lit(most) / F.col("_n"), F.lit(1.0)).alias("_rate"))
    chosen = rows.join(F.broadcast(rates), F.col(label) == F.col("_label"))
    return chosen.filter(place < F.col("_rate")).drop("_label", "_rate")


def sampled_labels(rows: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """Rows (key, label) outside the held-out fold, about ``per_class`` of each label value or all if there
    are fewer. The choice is a threshold on the identifier's hash: the same on every run."""
    usable = rows.select(key, label).filter(
        F.col(label).isNotNull() & F.col(key).isNotNull() & (fold_of(key) != 0)
    ).distinct()
    return _drawn(usable, label, _place(F.col(key).cast("string")), per_class).select(key, label)


def shortened(text: Column) -> Column:
    """The text, or evenly spaced pieces of it with spaces between, as long as a training text may be."""
    size = TRAIN_CHARS // PIECES
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(PIECES - 1)),
        lambda i: text.substr(F.floor(i * (F.length(text) - size) / (PIECES - 1)).cast("int") + 1, F.lit(size)),
    )
    return F.when(F.length(text) <= TRAIN_CHARS, text).otherwise(F.array_join(pieces, " "))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text"
) -> list[tuple[str, object]]:
    """Texts and labels of the sample, in a fixed order. ``labels`` may be the documents themselves.

    Keys are drawn first, then their texts, of which a repeated key may have any number; equal texts of a key count once.
    """
    chosen = sampled_labels(labels, key, label, per_class).withColumnRenamed(key, "_key")
    usable = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    found = usable.join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select(
        F.col(label).alias("_class"), F.xxhash64(F.col("_id").cast("string"), "_text").alias("_hash"), shortened(F.col("_text")).alias("_text")
    )
    texts = stored(found.groupBy("_class", "_hash").agg(F.first("_text").alias("_text")), "training")
    sample = _drawn(texts, "_class", _place(F.col("_hash")), per_class)
    return sorted((row[0], row[1]) for row in sample.select("_text", "_class").collect())
