import pytest
from pyspark.sql import functions as F

from sensorloom.operators import stats
from sensorloom.sinks import tables
from tests.build import dicts, readings

ROWS = [
    ("a", "L1", 1, "2017-06-17T00:00:00"),
    ("a", "L1", 3, "2017-06-17T01:00:00"),
    ("b", "L2", 5, "2017-06-17T16:00:00"),
]


def test_conform_selects_by_name(spark):
    names = ["count", "sensor", "deviceid", "date", "x"]
    result = spark.createDataFrame([(1, "s", "d", "2017-06-17", 0)], names)
    fixed = tables.conform(result, "sensor_count")
    assert fixed.dtypes == [
        ("date", "string"), ("deviceid", "string"), ("sensor", "string"), ("count", "bigint"),
    ]
    assert tuple(fixed.first()) == ("2017-06-17", "d", "s", 1)
    with pytest.raises(ValueError, match="sensor"):
        tables.conform(result.drop("sensor"), "sensor_count")


def test_append_and_read_back(spark, tmp_path):
    result = stats.daily_stats(readings(spark, ROWS))
    path = str(tmp_path)
    assert tables.existing_result(spark, "limo_max_min", path) is None
    tables.write_result(result, "limo_max_min", path)
    written = tables.read_result(spark, "limo_max_min", path)
    assert [tuple(r) for r in written.orderBy("deviceid").collect()] == [
        ("2017-06-17", "a", "L1", 3.0, 1.0, 2.0),
        ("2017-06-18", "b", "L2", 5.0, 5.0, 5.0),
    ]
    assert tables.duplicate_keys(written, "limo_max_min").count() == 0
    assert tables.existing_result(spark, "limo_max_min", path).count() == 2
    assert tables.without_existing(result, written, "limo_max_min").count() == 0
    tables.write_result(result, "limo_max_min", path)
    again = tables.read_result(spark, "limo_max_min", path)
    assert tables.duplicate_keys(again, "limo_max_min").count() == 2


def test_reruns_read_only_their_dates(spark, tmp_path, capsys):
    result = stats.daily_stats(readings(spark, ROWS))
    tables.write_result(result, "limo_max_min", str(tmp_path))
    written = tables.read_result(spark, "limo_max_min", str(tmp_path))
    day = result.filter(F.col("date") == F.lit("2017-06-18").cast("date"))
    left = tables.without_existing(day, written, "limo_max_min")
    assert left.count() == 0
    left.explain("formatted")
    assert "PartitionFilters: [isnotnull(date" in capsys.readouterr().out


def test_days_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("2017-06-17", "a", 1.0), ("2017-06-18", "a", 2.0)], "date string, sensor string, measure double")
    for again in (rows, rows.filter("measure > 1")):
        tables.replace_days(again, "sensor_outliers", str(tmp_path))
    found = tables.read_result(spark, "sensor_outliers", str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.select(found.columns).collect()))
    with pytest.raises(ValueError, match="no key"):
        tables.without_existing(rows, found, "sensor_outliers")
    with pytest.raises(ValueError, match="relational"):
        tables.replace_days(rows, "sensor_outliers", fmt="jdbc")


def test_a_run_without_rows_clears_its_day(spark, tmp_path):
    rows = spark.createDataFrame(
        [("2017-06-17", "a", 1.0), ("2017-06-18", "a", 2.0)], "date string, sensor string, measure double"
    )
    path, table = str(tmp_path), "sensor_outliers"
    tables.replace_days(rows, table, path)
    written = tables.read_result(spark, table, path)
    # The result reads the table that it replaces.
    tables.replace_days(written.filter("measure > 5"), table, path, days=["2017-06-17", "2017-06-30"])
    assert [r["date"] for r in dicts(tables.read_result(spark, table, path))] == ["2017-06-18"]
    with pytest.raises(ValueError, match="isoformat"):
        tables.replace_days(written, table, path, days=["../x"])
    with pytest.raises(ValueError, match="no date"):
        tables.replace_days(rows.selectExpr("'d' AS deviceid", "'t' AS type"), "sensor_device_type", path)


def test_files_follow_the_dates(spark, tmp_path):
    days = 31
    rows = spark.range(20_000).repartition(8).select(
        F.date_add(F.lit("2017-06-01"), (F.col("id") % days).cast("int")).alias("date"),
        F.lit("a").alias("sensor"),
        F.col("id").cast("double").alias("measure"),
    )
    for _ in range(2):
        tables.write_result(rows, "sensor_outliers", str(tmp_path))
    files = list((tmp_path / "sensor_outliers").glob("date=*/*.parquet"))
    assert len({f.parent for f in files}) == days
    assert len(files) == 2 * days


def test_matrix_without_its_label(spark, tmp_path):
    names = tables.CONTRACTS["sensor_matrix"].names
    row = spark.createDataFrame([("2017-06-17", "L1", *[1.0] * 13)], tables.CONTRACTS["sensor_matrix"].columns)
    tables.write_result(row, "sensor_matrix", str(tmp_path), leave_out=["sensor"])
    written = spark.read.parquet(str(tmp_path / "sensor_matrix"))
    assert sorted(written.columns) == sorted(name for name in names if name != "sensor")


def test_empty_result_may_be_appended(spark, tmp_path):
    result = stats.sensor_count(readings(spark, ROWS), ["none"])
    tables.write_result(result, "sensor_count", str(tmp_path))
    assert tables.read_result(spark, "sensor_count", str(tmp_path)).count() == 0


def test_table_without_key_cannot_be_checked(spark):
    with pytest.raises(ValueError):
        tables.duplicate_keys(spark.range(1), "sensor_outliers")


def test_relational_options():
    options = tables.sink_options("jdbc", "sensor_count", {"url": "jdbc:x", "batchsize": "10"})
    assert options == {"dbtable": "sensor_count", "batchsize": "10", "url": "jdbc:x"}
    assert tables.sink_options("jdbc", "t", None)["batchsize"] == "5000"
    assert tables.sink_options("parquet", "t", None) == {}


def test_file_sink_needs_a_path(spark):
    with pytest.raises(ValueError):
        tables.write_result(stats.sensor_count(readings(spark, ROWS)), "sensor_count")


def test_device_days(spark, tmp_path):
    path = str(tmp_path / "slices")
    tables.write_device_days(readings(spark, ROWS), path)
    assert sorted(p.name for p in (tmp_path / "slices").glob("date=*")) == [
        "date=2017-06-17", "date=2017-06-18",
    ]
    one = tables.read_device_days(spark, path, "2017-06-17", "a")
    assert [r["measure"] for r in dicts(one, "ts")] == [1.0, 3.0]
    assert tables.read_device_days(spark, path, deviceid="b").count() == 1
    assert tables.read_device_days(spark, path).count() == 3


def test_device_days_run_again(spark, tmp_path):
    path = str(tmp_path / "slices")
    for _ in range(2):
        tables.write_device_days(readings(spark, ROWS), path)
    tables.write_device_days(readings(spark, ROWS[:1]), path)
    assert tables.read_device_days(spark, path).count() == 2
    tables.write_device_days(readings(spark, ROWS[:1]), path, mode="append")
    assert tables.read_device_days(spark, path).count() == 3


def test_files_of_a_day_are_cut_by_time(spark, tmp_path):
    rows = [("a", "L1", i, f"2017-06-17T00:{59 - i:02d}:00") for i in range(60)]
    path = str(tmp_path / "slices")
    tables.write_device_days(readings(spark, rows), path, files=4)
    by_file = {}
    for row in spark.read.parquet(path).withColumn("file", F.input_file_name()).collect():
        by_file.setdefault(row["file"], []).append(row["ts"])
    assert len(by_file) > 1
    assert all(times == sorted(times) for times in by_file.values())
    spans = sorted((times[0], times[-1]) for times in by_file.values())
    assert all(before[1] < after[0] for before, after in zip(spans, spans[1:]))
