"""Properties of the physical plans."""

import re

import pytest

import __spark_entry__ as registered
from sensorloom.sinks.tables import write_device_days
from sensorloom.sources.readings import read_readings, read_table
from tests.oracle import TESTDATA

SF_DIR = str(TESTDATA / "sf0.001")


def plan(spark, capsys, name):
    result = registered.queries()[name](spark, SF_DIR)
    capsys.readouterr()
    result.explain("formatted")
    return capsys.readouterr().out


def exchanges(text):
    return len(re.findall(r"^\(\d+\) Exchange$", text, re.MULTILINE))


OWN = [name for name in registered.queries() if not re.match(r"op\d+_|pipeline", name)]


@pytest.mark.parametrize("name", sorted(OWN))
def test_no_cross_join_and_no_python(spark, capsys, name):
    text = plan(spark, capsys, name)
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "SinglePartition"):
        # One group over the whole table and a top 20 are single by nature, and few rows are clustered in one part.
        if operator == "SinglePartition" and name.endswith(("_all", "_first", "_check", "_clusters")):
            continue
        assert operator not in text, operator


@pytest.mark.parametrize(
    ("name", "shuffles"),
    [
        ("daily_stats", 1),
        ("hourly_stats", 1),
        ("sensor_count", 1),
        ("device_type", 1),
        ("top_value", 1),
        ("quartiles", 1),
        ("exceed_by_hour", 1),
        ("restart_count", 1),
        ("aligned_readings", 2),
        ("run_sessions", 3),
    ],
)
def test_number_of_shuffles(spark, capsys, name, shuffles):
    assert exchanges(plan(spark, capsys, name)) == shuffles


def test_scan_reads_and_filters_what_is_needed(spark, capsys):
    text = plan(spark, capsys, "sensor_count")
    assert "In(event_type, [click,purchase,view])" in text
    schemas = re.findall(r"ReadSchema: (.*)", text)
    assert schemas and all("props" not in schema and "value" not in schema for schema in schemas)


def test_sensor_filter_reaches_a_csv_scan(spark, capsys, tmp_path):
    path = tmp_path / "day.csv"
    path.write_text("deviceid,sensor,measure,timestamp\nd,L1,1,2017-06-17T00:00:00Z\n")
    read_readings(spark, str(path), sensors=["L1", "L2"]).explain("formatted")
    assert "In(sensor, [L1,L2])" in capsys.readouterr().out


def test_one_day_opens_one_folder(spark, capsys, tmp_path):
    readings = registered._readings(spark, SF_DIR)
    write_device_days(readings, str(tmp_path / "days"))
    read_table(spark, str(tmp_path / "days"), "2024-01-10").explain("formatted")
    assert re.search(r"PartitionFilters: \[.*date.*2024-01-10", capsys.readouterr().out)


def test_ranks_take_one_sort_each(spark, capsys):
    text = plan(spark, capsys, "spearman_pair")
    assert len(re.findall(r"^\(\d+\) Sort$", text, re.MULTILINE)) == 3
    assert len(re.findall(r"^\(\d+\) Window$", text, re.MULTILINE)) == 3


def test_status_filter_reaches_the_scan(spark, capsys):
    assert "EqualTo(event_type,click)" in plan(spark, capsys, "restart_count")


def test_time_range_reaches_the_scan(spark, capsys):
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in plan(spark, capsys, "ingest_documents")
