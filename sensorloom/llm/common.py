"""Expressions that several corpus operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words end at ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
# Lower-cased words of ASCII letters, digits and everything beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pattern(expression: str) -> Column:
    return F.lit(expression)


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, pattern(WORD)), F.lit(0)).cast("long")


def plain_words(text: Column) -> Column:
    """Array of lower-cased words without punctuation; empty for NULL."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.regexp_extract_all(lowered, pattern(PLAIN_WORD), F.lit(0))


def hash_digits(text: Column, digits: int) -> Column:
    """Leading hexadecimal digits (15 at most) of the MD5 of a text, as a number; NULL counts as empty."""
    shown = F.md5(F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(shown, 1, digits), 16, 10).cast("long")


def bucket_count(rows: int) -> int:
    """Buckets that split ``rows`` so that neither their number nor their size grows past the square
    root of the table."""
    return max(1, math.ceil(math.sqrt(rows)))


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """A table's rows as one column ``row`` beside the named ones, so that its columns cannot clash with those an
    operator adds. ``row.*`` gives them back."""
    return df.select(F.struct("*").alias("row"), *(column.alias(name) for name, column in columns.items()))


def restored(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The packed columns, and new ones that replace those of the same name."""
    kept = [F.col(f"row.`{name}`") for name in columns if name not in added]
    return df.select(*kept, *(column.alias(name) for name, column in added.items()))
