"""The daily reports: which readings each uses, what it computes and which table it fills.

    spark-submit sensorloom/plans/daily.py <report> <date> --input '/data/{date}.csv' --output /results
    spark-submit sensorloom/plans/daily.py <report> <date> --input /data/device-days --input-format parquet --output /results
    spark-submit sensorloom/plans/daily.py all <date> --input '/data/{date}.csv' --output /results --most-rejected 0.01

A path with ``{date}`` names the day's own file. Any other path holds many days, of which the report takes the one. Several reports, separated by
commas, or ``all`` of them share one parse of the day and one count of its groups.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import limits, relations, sessions, stats
from sensorloom.operators.ordered import HOT_ROWS, GroupSizes, measure_groups
from sensorloom.session import released_copies, stored
from sensorloom.sinks.tables import (
    CONTRACTS,
    dates_of,
    existing_result,
    replace_days,
    without_existing,
    write_result,
)
from sensorloom.sources import sensors
from sensorloom.sources.readings import (
    accepted,
    check_rejects,
    on_day,
    parse_readings,
    read_raw,
    read_readings,
    read_table,
)


@dataclass(frozen=True)
class Report:
    """``sensors`` limits the readings. ``passes`` above one tells that they are read repeatedly; they
    are then parsed once and kept in columns. ``keys`` are those whose group sizes ``compute`` takes, of the ``sized`` sensors if not of
    all readings of the report. ``untimed`` reports use rows without a readable time, too."""

    table: str
    compute: Callable[[DataFrame, GroupSizes | None], DataFrame]
    sensors: Sequence[str] | None = None
    passes: int = 1
    keys: Sequence[str] = ()
    sized: Sequence[str] | None = None
    untimed: bool = False


def _plain(operator: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, GroupSizes | None], DataFrame]:
    """A computation that needs no group sizes."""
    return lambda readings, sizes: operator(readings)


def _sized(operator: Callable[..., DataFrame]) -> Callable[[DataFrame, GroupSizes | None], DataFrame]:
    return lambda readings, sizes: operator(readings, sizes=sizes)


def _run_sessions(readings: DataFrame, sizes: GroupSizes | None) -> DataFrame:
    return sessions.run_sessions(readings, sensors.STATUS, sensors.CURRENT, sizes=sizes)


def _status(readings: DataFrame, sizes: GroupSizes | None) -> DataFrame:
    return sessions.device_status(_run_sessions(readings, sizes), readings, sensors.STATUS)


def _statistic(readings: DataFrame, sizes: GroupSizes | None) -> DataFrame:
    return sessions.device_statistics(_run_sessions(readings, sizes), readings)


def _restarts(readings: DataFrame, sizes: GroupSizes | None) -> DataFrame:
    return sessions.restart_count(readings, sensors.STATUS, sizes=sizes)


def _clusters(readings: DataFrame, sizes: GroupSizes | None) -> DataFrame:
    return relations.kmeans_by_date(readings, sensors.CLUSTERED, sizes=sizes)


def _matrix(readings: DataFrame, sizes: GroupSizes | None) -> DataFrame:
    matrix = relations.corr_matrix(readings, sensors.MATRIX, sizes=sizes)
    return relations.wide_matrix(matrix, sensors.MATRIX)


def _total(readings: DataFrame) -> DataFrame:
    return stats.daily_total(readings, sensors.DEVICE_LABEL)


def _devices(readings: DataFrame) -> DataFrame:
    return stats.device_type(readings, None, sensors.DEVICE_LABEL)


def _count_view(readings: DataFrame) -> DataFrame:
    return stats.first_rows(stats.sensor_count(readings), ["date", "deviceid", "sensor"])


def _pair(operator: Callable[..., DataFrame]) -> Callable[[DataFrame, GroupSizes | None], DataFrame]:
    return lambda readings, sizes: operator(readings, *sensors.PAIR, sizes=sizes)


BY_GROUP, BY_SENSOR = limits.DEVICE_DAY_SENSOR, limits.DAY_SENSOR
RUNS = (sensors.STATUS, sensors.CURRENT)

REPORTS: Mapping[str, Report] = {
    "sensor-count": Report("sensor_count", _plain(stats.sensor_count), sensors.COUNTED),
    "sensor-sum": Report("sensor_data_count", _plain(_total)),
    "max-min": Report("limo_max_min", _plain(stats.daily_stats)),
    "hour-max-min": Report("limo_hour_max_min", _plain(stats.hourly_stats)),
    "top-value": Report("sensor_top_value", _sized(limits.top_value), sensors.LIMITED, 2, BY_GROUP),
    "exceed": Report("sensor_exceed", _sized(limits.exceed_by_hour), sensors.LIMITED, 2, BY_GROUP),
    "boxplot": Report("sensor_boxplot", _sized(limits.boxplot), [sensors.OUTLIER], 2, BY_SENSOR),
    "outliers": Report("sensor_outliers", _sized(limits.outliers), [sensors.OUTLIER], 3, BY_SENSOR),
    "matrix": Report("sensor_matrix", _matrix, sensors.MATRIX, 2, BY_SENSOR),
    "kmeans": Report("sensor_temperature_kmeans", _clusters, sensors.CLUSTERED, 2, BY_SENSOR),
    "restarts": Report("sensor_restart_count", _restarts, [sensors.STATUS], 2, sessions.DEVICE_DAY),
    "device-type": Report("sensor_device_type", _plain(_devices), sensors.COUNTED, untimed=True),
    "device-status": Report("etl_device_status_info", _status, None, 3, sessions.DEVICE_DAY, RUNS),
    "device-statistic": Report("etl_device_statistic", _statistic, None, 3, sessions.DEVICE_DAY, RUNS),
}

# Reports that only show their result.
VIEWS: Mapping[str, Report] = {
    "count-view": Report("", _plain(_count_view)),
    "pearson": Report("", _pair(relations.pearson), sensors.PAIR, 2, BY_SENSOR),
    "spearman": Report("", _pair(relations.spearman), sensors.PAIR, 2, ("date",)),
}


def report_input(
    spark: SparkSession,
    name: str,
    path: str,
    date: str,
    input_format: str = "csv",
    counts: Observation | None = None,
) -> DataFrame:
    """The day's readings of the report's sensors.

    The device list needs no time, so from a file of the day it also counts rows with a bad one. ``counts`` receives the lines of a
    CSV input and how many of them were rejected.
    """
    report = VIEWS.get(name) or REPORTS[name]
    if input_format == "parquet":
        return stats.only_sensors(
            read_table(spark, path.replace("{date}", date), date), report.sensors
        )
    if "{date}" in path and report.untimed:
        return parse_readings(read_raw(spark, path, date, report.sensors, counts))
    readings = read_readings(spark, path, date, sensors=report.sensors, counts=counts)
    return readings if "{date}" in path else on_day(readings, date)


def _dated(result: DataFrame, table: str, date: str) -> DataFrame:
    if table and "date" in CONTRACTS[table].names and "date" not in result.columns:
        return result.withColumn("date", F.lit(date))
    return result


def compute(
    spark: SparkSession,
    name: str,
    path: str,
    date: str,
    input_format: str = "csv",
    counts: Observation | None = None,
    most_rejected: float | None = None,
) -> DataFrame:
    """The report of one day. ``input_format`` is ``csv`` or ``parquet``, which includes the device-day layout.

    ``counts`` as in ``report_input``. With ``most_rejected`` the readings are parsed at call, which fails if a larger share of the lines
    has no readable time.
    """
    report = VIEWS.get(name) or REPORTS[name]
    checked = most_rejected is not None and input_format == "csv"
    counts = counts or (Observation() if checked else None)
    readings = report_input(spark, name, path, date, input_format, counts)
    if report.passes > 1 or checked:
        readings = stored(readings, "readings")
    if checked:
        check_rejects(counts, most_rejected)
    return _dated(report.compute(readings, None), report.table, date)


def compute_day(
    spark: SparkSession,
    names: Sequence[str],
    path: str,
    date: str,
    input_format: str = "csv",
    counts: Observation | None = None,
    most_rejected: float | None = None,
    reports: Mapping[str, Report] | None = None,
    hot_rows: int = HOT_ROWS,
) -> dict[str, DataFrame]:
    """Several reports of one day from one parse, which is stored, and one count of its groups.

    The rows of every device and sensor are counted once; the sizes that the reports need are sums of these counts. Results are those of
    ``compute``.
    """
    every = reports or {**REPORTS, **VIEWS}
    chosen = {name: every[name] for name in names}
    own_file = "{date}" in path
    if input_format == "parquet":
        day = read_table(spark, path.replace("{date}", date), date)
    else:
        counts = counts or Observation()
        day = parse_readings(read_raw(spark, path, date, counts=counts))
        day = day if own_file else on_day(day, date)
    day = stored(day, "day")
    if input_format == "csv" and most_rejected is not None:
        check_rejects(counts, most_rejected)
    timed = accepted(day)
    groups = None
    sizes: dict[tuple, GroupSizes] = {}
    results = {}
    for name, report in chosen.items():
        size = None
        if report.keys:
            groups = stored(stats.sensor_count(timed), "groups") if groups is None else groups
            listed = report.sized or report.sensors
            wanted = (tuple(report.keys), tuple(listed or ()))
            if wanted not in sizes:
                of_listed = stats.only_sensors(groups, listed)
                sizes[wanted] = measure_groups(of_listed, report.keys, hot_rows, counted="count")
            size = sizes[wanted]
        rows = day if report.untimed and own_file else timed
        result = report.compute(stats.only_sensors(rows, report.sensors), size)
        results[name] = _dated(result, report.table, date)
    return results


def write_report(
    result: DataFrame,
    table: str,
    date: str,
    output: str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    skip_existing: bool = False,
    replace: bool = False,
) -> None:
    """Append a day's result to its table. For a second run of the day see ``run``."""
    dated = "date" in CONTRACTS[table].names
    if dated and (replace or (skip_existing and not CONTRACTS[table].key)):
        replace_days(result, table, output, fmt, options, days=[date])
        return
    if skip_existing or replace:
        result = stored(result, "result")
        existing = existing_result(result.sparkSession, table, output, fmt, options)
        if existing is not None:
            result = without_existing(result, existing, table, dates_of(result) if dated else None)
    write_result(result, table, output, fmt, options)


def run(
    spark: SparkSession,
    name: str,
    path: str,
    date: str,
    output: str | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    skip_existing: bool = False,
    input_format: str = "csv",
    replace: bool = False,
    most_rejected: float | None = None,
) -> dict[str, int] | None:
    """Compute reports and append them to their tables, or show those that have none.

    ``name`` is a report, several with commas between, or ``all`` that fill tables. Returns the lines of a CSV input and how
    many of them were rejected for their time; a larger share than ``most_rejected`` fails the run before anything is written.

    ``skip_existing`` makes a rerun safe: rows whose key the table already holds are left out, and in a table without
    a key the date is replaced. ``replace`` replaces the date in every table that has dates, so a rerun after a correction
    also clears what is no longer true. Copies that operators store are deleted at the end.
    """
    names = list(REPORTS) if name == "all" else name.split(",")
    counts = Observation() if input_format == "csv" else None
    with released_copies(spark):
        if len(names) == 1:
            results = {name: compute(spark, name, path, date, input_format, counts, most_rejected)}
        else:
            results = compute_day(spark, names, path, date, input_format, counts, most_rejected)
        for one, result in results.items():
            if one in VIEWS:
                result.show()
            else:
                write_report(result, REPORTS[one].table, date, output, fmt, options, skip_existing, replace)
        return counts.get if counts else None


def main() -> None:
    parser = argparse.ArgumentParser(description="Run one daily report.")
    parser.add_argument("report", help="one or several, separated by commas, of: all, " + ", ".join(sorted({**REPORTS, **VIEWS})))
    parser.add_argument("date")
    parser.add_argument("--input", required=True, help="path of the readings; {date} is filled in, other paths are filtered by the date")
    parser.add_argument("--input-format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--output", help="folder of the result tables")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--option", action="append", default=[], metavar="KEY=VALUE")
    parser.add_argument("--skip-existing", action="store_true", help="leave out rows whose key is there already")
    parser.add_argument("--replace", action="store_true", help="replace what tables with dates hold of the date")
    parser.add_argument("--most-rejected", type=float, help="share of lines without a readable time above which a run fails")
    args = parser.parse_args()
    unknown = set(args.report.split(",")) - {"all", *REPORTS, *VIEWS}
    if unknown:
        parser.error(f"unknown reports: {', '.join(sorted(unknown))}")
    options = dict(option.split("=", 1) for option in args.option)
    spark = SparkSession.builder.appName(f"sensorloom-{args.report}").getOrCreate()
    counts = run(
        spark, args.report, args.input, args.date, args.output, args.format, options,
        args.skip_existing, args.input_format, args.replace, args.most_rejected,
    )
    if counts:
        print(json.dumps(counts))


if __name__ == "__main__":
    main()
