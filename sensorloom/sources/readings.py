"""Readers for sensor readings.

A readings DataFrame has the columns

    deviceid, sensor, measure double, ts timestamp_ntz (UTC), local_ts timestamp_ntz,
    date, hour int, seq

``seq`` breaks ties between readings of equal time and must tell such readings apart.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.cleaning import parse_measure, parse_time, to_local

# Plant time is UTC+8.
OFFSET_HOURS = 8

RAW_SCHEMA = T.StructType(
    [
        T.StructField("deviceid", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("measure", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

DOCUMENT_FIELDS = ["deviceid", "topic", "sensor", "measure", "timestamp"]


def read_raw(
    spark: SparkSession,
    path: str,
    date: str | None = None,
    sensors: Iterable[str] | None = None,
    counts: Observation | None = None,
) -> DataFrame:
    """Text fields of comma-separated files with a header line; quotes have no meaning.

    ``{date}`` in the path is replaced by the date, for layouts with one file per day. ``seq`` follows
    the position in the file. ``sensors`` are chosen by the text field itself and before anything else, so that
    the scan can skip the other lines. ``counts`` receives ``lines`` and ``rejected`` of all lines, whatever their sensor,
    from the first job that reads them; the scan then skips none.
    """
    if date is not None:
        path = path.replace("{date}", date)
    lines = (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    if counts is not None:
        lines = lines.observe(
            counts,
            F.count(F.lit(1)).alias("lines"),
            F.count_if(parse_time(F.col("timestamp")).isNull()).alias("rejected"),
        )
    if sensors is not None:
        lines = lines.filter(F.col("sensor").isin(list(sensors)))
    position = F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("*", position.alias("seq"))


def parse_readings(raw: DataFrame, offset_hours: int = OFFSET_HOURS) -> DataFrame:
    """Typed columns from text fields. A row whose time cannot be read gets a NULL ``ts``."""
    typed = raw.select(
        F.coalesce("deviceid", F.lit("")).alias("deviceid"),
        F.coalesce("sensor", F.lit("")).alias("sensor"),
        parse_measure(F.col("measure")).alias("measure"),
        parse_time(F.col("timestamp")).alias("ts"),
        "seq",
    )
    return with_local_time(typed, offset_hours)


def with_local_time(df: DataFrame, offset_hours: int = OFFSET_HOURS) -> DataFrame:
    local = to_local(F.col("ts"), offset_hours)
    return df.withColumns(
        {
            "local_ts": local,
            "date": local.cast("date"),
            "hour": F.hour(local),
        }
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("ts").isNotNull())


def rejected(raw: DataFrame) -> DataFrame:
    """Raw rows that have no readable time: short lines and malformed times."""
    return raw.filter(parse_time(F.col("timestamp")).isNull())


def read_readings(
    spark: SparkSession,
    path: str,
    date: str | None = None,
    offset_hours: int = OFFSET_HOURS,
    sensors: Iterable[str] | None = None,
    counts: Observation | None = None,
) -> DataFrame:
    """Readings of a path or, with ``{date}`` in it, of that day's file. ``counts`` as in ``read_raw``."""
    return accepted(parse_readings(read_raw(spark, path, date, sensors, counts), offset_hours))


def check_rejects(counts: Observation, most: float) -> None:
    """Raise if more than the share ``most`` of the lines that were read had no readable time."""
    lines, rejected = counts.get["lines"], counts.get["rejected"]
    if rejected > most * lines:
        raise ValueError(f"{rejected} of {lines} lines have no readable time, more than a share of {most}")


def read_table(
    spark: SparkSession, path: str, date: str | None = None, offset_hours: int = OFFSET_HOURS
) -> DataFrame:
    """Readings of a Parquet table with deviceid, sensor, measure and ts, or of its slices of one local day.

    A table partitioned by ``date``, as the device-day layout is, opens only that day's folder. Without a ``seq``
    column readings of equal time follow their place in the files.
    """
    rows = spark.read.parquet(path)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    seq = F.col("seq") if "seq" in rows.columns else place
    if date is not None and "date" in rows.columns:
        rows = rows.filter(F.col("date") == F.lit(date).cast("date"))
    typed = readings_from_columns(
        rows.withColumn("_seq", seq), "deviceid", "sensor", "measure", "ts", "_seq", offset_hours
    )
    return typed if date is None else on_day(typed, date, offset_hours)


def readings_from_columns(
    df: DataFrame,
    deviceid: str,
    sensor: str,
    measure: str,
    ts: str,
    seq: str,
    offset_hours: int = OFFSET_HOURS,
) -> DataFrame:
    """Readings from a table that is typed already; a missing measure counts as 0.0."""
    named = df.select(
        F.col(deviceid).alias("deviceid"),
        F.col(sensor).alias("sensor"),
        F.coalesce(F.col(measure).cast("double"), F.lit(0.0)).alias("measure"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.col(seq).alias("seq"),
    )
    return with_local_time(named, offset_hours)


def on_day(readings: DataFrame, date: str, offset_hours: int = OFFSET_HOURS) -> DataFrame:
    """Readings of one local day, as a half-open range on the stored time so that scans can skip data."""
    start = dt.datetime.fromisoformat(date) - dt.timedelta(hours=offset_hours)
    return within(readings, "ts", start, start + dt.timedelta(days=1))


def within(df: DataFrame, column: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows with ``start <= column < end``."""
    kind = df.schema[column].dataType
    low, high = (F.lit(str(edge)).cast(kind) for edge in (start, end))
    return df.filter((F.col(column) >= low) & (F.col(column) < high))


def ingest_documents(
    documents: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    exclude: Iterable[str] = ("test",),
) -> DataFrame:
    """The five stored fields of raw documents in a half-open time range, without excluded sensors."""
    in_range = within(documents, "timestamp", start, end)
    unwanted = list(exclude)
    if unwanted:
        in_range = in_range.filter(~F.coalesce(F.col("sensor").isin(unwanted), F.lit(False)))
    return in_range.select(*DOCUMENT_FIELDS)


def day_windows(df: DataFrame, ts: str = "ts", offset_hours: int = OFFSET_HOURS) -> DataFrame:
    """Each distinct day of ``ts`` with the UTC start and end of that local day (half-open)."""
    day = F.col("date").cast("timestamp_ntz")
    return (
        df.select(F.col(ts).cast("date").alias("date"))
        .distinct()
        .select(
            "date",
            to_local(day, -offset_hours).alias("start_ts"),
            to_local(day, 24 - offset_hours).alias("end_ts"),
        )
    )
