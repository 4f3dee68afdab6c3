"""Counts and simple statistics. Each is one partial and one final aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_sensors(readings: DataFrame, sensors: Sequence[str] | None) -> DataFrame:
    """Readings of the listed sensors; all readings when there is no list."""
    if sensors is None:
        return readings
    return readings.filter(F.col("sensor").isin(list(sensors)))


def _extremes(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return readings.groupBy(*keys).agg(
        F.max("measure").alias("max"),
        F.min("measure").alias("min"),
        F.avg("measure").alias("avg"),
    )


def daily_stats(readings: DataFrame, sensors: Sequence[str] | None = None) -> DataFrame:
    return _extremes(only_sensors(readings, sensors), ["date", "deviceid", "sensor"])


def hourly_stats(readings: DataFrame, sensors: Sequence[str] | None = None) -> DataFrame:
    return _extremes(only_sensors(readings, sensors), ["date", "hour", "deviceid", "sensor"])


def sensor_count(readings: DataFrame, sensors: Sequence[str] | None = None) -> DataFrame:
    """Readings per date, device and sensor."""
    return (
        only_sensors(readings, sensors)
        .groupBy("date", "deviceid", "sensor")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def first_rows(result: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The first rows in an order, as a report shows them."""
    return result.orderBy(*order).limit(n)


def daily_total(readings: DataFrame, label: str) -> DataFrame:
    """Number of readings per date with a type label."""
    return (
        readings.groupBy("date")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("date", F.lit(label).alias("type"), "count")
    )


def device_type(readings: DataFrame, sensors: Sequence[str] | None, label: str) -> DataFrame:
    """Devices that have any of the listed sensors."""
    return (
        only_sensors(readings, sensors)
        .select("deviceid")
        .distinct()
        .withColumn("type", F.lit(label))
    )


def device_rows(readings: DataFrame) -> DataFrame:
    return readings.groupBy("deviceid").agg(F.count(F.lit(1)).alias("count"))


def distinct_days(readings: DataFrame) -> DataFrame:
    return readings.select("date").distinct().orderBy("date")
