"""Result tables: their contracts, and appending to them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.session import remove_folder, stored
from sensorloom.sources.sensors import MATRIX

# Rows per insert batch of a relational sink.
BATCH_ROWS = 5_000


@dataclass(frozen=True)
class Contract:
    """Columns of a result table in order, as a DDL string, and its key."""

    key: tuple[str, ...]
    columns: str

    @property
    def names(self) -> list[str]:
        return [column.split()[0] for column in self.columns.split(", ")]


# Names and columns of the result tables.
CONTRACTS: Mapping[str, Contract] = {
    "sensor_count": Contract(
        ("date", "deviceid", "sensor"), "date string, deviceid string, sensor string, count bigint"
    ),
    "sensor_data_count": Contract((), "date string, type string, count bigint"),
    "limo_max_min": Contract(
        ("date", "deviceid", "sensor"),
        "date string, deviceid string, sensor string, max double, min double, avg double",
    ),
    "limo_hour_max_min": Contract(
        ("date", "hour", "deviceid", "sensor"),
        "date string, hour int, deviceid string, sensor string, max double, min double, avg double",
    ),
    "sensor_top_value": Contract(
        ("date", "deviceid", "sensor"),
        "date string, deviceid string, sensor string, topvalue double, count bigint",
    ),
    "sensor_exceed": Contract(
        ("date", "deviceid", "sensor", "hour"),
        "date string, deviceid string, sensor string, hour int, count bigint",
    ),
    "sensor_boxplot": Contract(
        ("date", "sensor"),
        "date string, sensor string, lower double, q1 double, median double, q3 double, upper double",
    ),
    "sensor_outliers": Contract((), "date string, sensor string, measure double"),
    "sensor_matrix": Contract(
        (),
        "date string, sensor string, " + ", ".join(f"{s.lower()} double" for s in MATRIX),
    ),
    "sensor_temperature_kmeans": Contract(
        ("date", "clusterid"),
        "date string, clusterid int, cluster_num bigint, sensor1 double, sensor2 double,"
        " sensor3 double",
    ),
    "sensor_restart_count": Contract(
        ("date", "deviceid"),
        "date string, deviceid string, restart_count double, spendtime double",
    ),
    "sensor_device_type": Contract(("deviceid",), "deviceid string, type string"),
    "etl_device_status_info": Contract(
        (),
        "date string, deviceid string, starttime timestamp_ntz, stoptime timestamp_ntz, kwh double",
    ),
    "etl_device_statistic": Contract(
        (),
        "date string, deviceid string, restart_count bigint, total_runtime bigint,"
        " total_kwh double",
    ),
}


def conform(result: DataFrame, table: str) -> DataFrame:
    """The result with exactly the columns and types of its table, chosen by name."""
    schema = result.sparkSession.createDataFrame([], CONTRACTS[table].columns).schema
    missing = [field.name for field in schema if field.name not in result.columns]
    if missing:
        raise ValueError(f"{table} needs the columns {missing}")
    return result.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def duplicate_keys(result: DataFrame, table: str) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    key = CONTRACTS[table].key
    if not key:
        raise ValueError(f"{table} has no key")
    return result.groupBy(*key).count().filter("count > 1")


def dates_of(result: DataFrame) -> list[str]:
    """The distinct dates of a result, as text; a daily report has one or two. Runs a job."""
    return sorted(row[0] for row in result.select(F.col("date").cast("string")).distinct().collect())


def without_existing(
    result: DataFrame, existing: DataFrame, table: str, dates: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose key the table does not hold yet, so that a day can be run again.

    Only the dates of the result are read from the table. They may be given; otherwise the result is
    computed once to find them.
    """
    key = list(CONTRACTS[table].key)
    if not key:
        raise ValueError(f"{table} has no key; replace its days with replace_days")
    if "date" in CONTRACTS[table].names:
        existing = existing.filter(F.col("date").isin(dates_of(result) if dates is None else list(dates)))
    return conform(result, table).join(existing.select(*key), key, "left_anti")


def by_date(result: DataFrame) -> DataFrame:
    """Rows of a date together, so that the files of a write follow the dates and the bytes: a date with many rows is
    split, small ones share a task."""
    return result.hint("rebalance", F.col("date"))


def write_result(
    result: DataFrame,
    table: str,
    path: str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    mode: str = "append",
    leave_out: Sequence[str] = (),
) -> None:
    """Append a result to its table.

    File formats write to ``path/table``, one folder per date. ``fmt="jdbc"`` writes to the relational table of
    that name with the caller's connection options, in batches. ``leave_out`` names columns that a table made
    elsewhere does not have, such as the row label of the matrix.
    """
    rows, dated = conform(result, table).drop(*leave_out), "date" in CONTRACTS[table].names
    if dated and fmt != "jdbc":
        rows = by_date(rows)
    writer = rows.write.format(fmt).mode(mode).options(**sink_options(fmt, table, options))
    if fmt == "jdbc":
        writer.save()
        return
    if dated:
        writer = writer.partitionBy("date")
    writer.save(table_path(path, table))


def replace_days(
    result: DataFrame,
    table: str,
    path: str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    days: Sequence[str] = (),
) -> None:
    """Write a result in place of what its table holds of the same dates; other dates stay.

    ``days`` are those that were run: one of them that has no row in the result loses the rows it had. The result is
    stored first, so it may be read from the table itself, and a run that fails before that changes nothing. Relational tables cannot be
    replaced by day.
    """
    if fmt == "jdbc":
        raise ValueError("days of a relational table cannot be replaced; delete them there first")
    if "date" not in CONTRACTS[table].names:
        raise ValueError(f"{table} has no date")
    run = {dt.date.fromisoformat(day).isoformat() for day in days}
    staged = stored(conform(result, table), "staged")
    dynamic = {"partitionOverwriteMode": "dynamic"}
    write_result(staged, table, path, fmt, {**(options or {}), **dynamic}, mode="overwrite")
    for day in sorted(run - set(dates_of(staged))):
        remove_folder(staged.sparkSession, f"{table_path(path, table)}/date={day}")


def sink_options(fmt: str, table: str, options: Mapping[str, str] | None) -> dict[str, str]:
    defaults = {"dbtable": table, "batchsize": str(BATCH_ROWS)} if fmt == "jdbc" else {}
    return {**defaults, **(options or {})}


def table_path(path: str | None, table: str) -> str:
    if not path:
        raise ValueError("a file sink needs a path")
    return f"{path.rstrip('/')}/{table}"


def read_result(
    spark: SparkSession,
    table: str,
    path: str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    reader = spark.read.format(fmt).options(**sink_options(fmt, table, options))
    if fmt == "jdbc":
        return reader.load()
    return reader.schema(CONTRACTS[table].columns).load(table_path(path, table)).select(CONTRACTS[table].names)


def existing_result(
    spark: SparkSession,
    table: str,
    path: str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame | None:
    """The table, or None if its files have not been written yet."""
    try:
        return read_result(spark, table, path, fmt, options)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_device_days(
    readings: DataFrame, path: str, mode: str = "overwrite", files: int | None = None
) -> None:
    """Split readings by local day and device, in time order. Days that are written replace what the layout holds of
    them, so a day can be run again; ``append`` adds to them instead.

    One directory per day; inside it rows are laid out by device and time, so a scan for one device
    skips the other row groups. The range partitioning gives files of even size however unequal the
    devices are: a large device-day spans several files, many small ones share a file. ``files`` sets
    their number; by default it follows from the session's shuffle partitions.
    """
    layout = ["date", "deviceid", "ts", "seq"]
    ranges = layout if files is None else [files, *layout]
    (
        readings.select("deviceid", "sensor", "measure", "ts", "date", "seq")
        .repartitionByRange(*ranges)
        .sortWithinPartitions(*layout)
        .drop("seq")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read_device_days(
    spark: SparkSession, path: str, date: str | None = None, deviceid: str | None = None
) -> DataFrame:
    """All slices, or those of one day or device."""
    slices = spark.read.parquet(path)
    if date is not None:
        slices = slices.filter(F.col("date") == F.lit(date).cast("date"))
    if deviceid is not None:
        slices = slices.filter(F.col("deviceid") == deviceid)
    return slices
