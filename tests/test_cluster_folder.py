"""Queries that keep rows in the shared folder, under a master of a cluster whose folder is a local path."""

import datetime as dt
import random

import pytest

import __spark_entry__ as registered
from tests.oracle import connect, spark_rows, sql_rows

STORING = [
    "aligned_readings", "boxplot", "corr_matrix", "corr_matrix_wide", "csv_readings", "day_plan", "day_report",
    "device_day_rerun", "device_day_slices", "device_statistics", "device_statistics_daily", "device_status",
    "empty_append", "exceed_by_hour", "exceed_by_hour_daily", "exceed_by_hour_sensor", "kmeans_by_date",
    "kmeans_clusters", "kmeans_size_check", "outliers", "outliers_by_sensor", "outliers_rerun",
    "outliers_rerun_empty", "pearson_pair",
]
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, first = random.Random(3), dt.datetime(2024, 1, 8)
    instants = rng.sample(range(4 * 86_400), 1_500)
    data = [
        (i, first + dt.timedelta(seconds=at), rng.randrange(6), rng.choice(registered.SENSORS), rng.randrange(1, 49_000) / 100, "{}")
        for i, at in enumerate(instants)
    ]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(data, SCHEMA).toPandas().to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.mark.parametrize("name", STORING)
def test_matches_sql_with_a_shared_local_path(cluster, sf_dir, name):
    columns, rows = spark_rows(registered.queries()[name](cluster, sf_dir))
    expected_columns, expected = sql_rows(connect(sf_dir), registered.oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected
