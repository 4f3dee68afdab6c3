"""Expressions that turn raw text fields into typed reading columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted time layout, and number spellings that the JVM parser takes
# but a plain decimal parser does not (hex floats, type suffixes such as "1d" or "1.5f").
TIME_LAYOUT = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"
TIME_LENGTH = 19
JVM_ONLY_NUMBER = r"(?i)(0x|[0-9.][df]\s*$)"


def parse_time(text: Column) -> Column:
    """UTC wall time from the first 19 characters; NULL when they are no valid time."""
    head = F.substring(text, 1, TIME_LENGTH)
    return F.when(head.rlike(TIME_LAYOUT), head.try_cast("timestamp_ntz"))


def parse_measure(text: Column) -> Column:
    """Number from text; anything that is no number becomes 0.0."""
    number = F.when(~text.rlike(JVM_ONLY_NUMBER), text.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def to_local(ts: Column, offset_hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(offset_hours))


def wall_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of a zone-free timestamp.

    Built from calendar parts, because the unix_* functions go through the session time zone and
    would shift across its clock changes.
    """
    days = F.unix_date(ts.cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-free timestamp, by its calendar parts alike."""
    minutes = F.unix_date(ts.cast("date")).cast("long") * 1_440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
