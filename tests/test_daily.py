import csv
import datetime as dt
import random
from pathlib import Path

import pytest

from sensorloom.operators import limits, relations, sessions
from sensorloom.plans import daily
from sensorloom.session import shared_folder
from sensorloom.sinks import tables
from sensorloom.sources import sensors
from sensorloom.sources.readings import read_readings
from tests.build import dicts
from tests.oracle import canonical

DAY = "2017-06-17"
NAMES = sorted({*sensors.COUNTED, *sensors.LIMITED, *sensors.MATRIX, *sensors.PAIR})


@pytest.fixture(scope="module")
def day_path(tmp_path_factory):
    """One local day of readings of two devices."""
    folder = tmp_path_factory.mktemp("days")
    rng = random.Random(4)
    start = dt.datetime(2017, 6, 16, 16)
    rows = [
        (
            device,
            sensor,
            rng.choice([0, 3]) if sensor == sensors.STATUS else round(rng.random() * 100, 2),
            (start + dt.timedelta(seconds=rng.randrange(86400))).isoformat() + ".000Z",
        )
        for device in ("one", "two")
        for sensor in NAMES
        # Readings exceed the top value of their group only from a thousand readings on.
        for _ in range(1500 if sensor == sensors.LIMITED[0] else 12)
    ]
    rows += [("one", sensors.OUTLIER, 9999, f"{DAY}T01:00:00Z"), ("late", "L0003", 1, "no time")]
    rows.sort(key=lambda row: row[3])
    with open(folder / f"{DAY}.csv", "w", newline="") as file:
        csv.writer(file).writerows([("deviceid", "sensor", "measure", "timestamp"), *rows])
    return f"{folder}/{{date}}.csv"


@pytest.mark.parametrize("name", sorted(daily.REPORTS))
def test_report_fills_its_table(spark, day_path, tmp_path, name):
    daily.run(spark, name, day_path, DAY, str(tmp_path))
    table = daily.REPORTS[name].table
    written = tables.read_result(spark, table, str(tmp_path))
    rows = dicts(written)
    assert rows
    if "date" in written.columns:
        assert {row["date"] for row in rows} == {DAY}
    if tables.CONTRACTS[table].key:
        assert tables.duplicate_keys(written, table).count() == 0
    daily.run(spark, name, day_path, DAY, str(tmp_path), skip_existing=True)
    assert tables.read_result(spark, table, str(tmp_path)).count() == len(rows)


def test_device_list_ignores_times(spark, day_path):
    found = daily.compute(spark, "device-type", day_path, DAY)
    assert sorted((r["deviceid"], r["type"]) for r in dicts(found)) == [
        ("late", "LiMo"), ("one", "LiMo"), ("two", "LiMo"),
    ]


def test_outlier_report(spark, day_path):
    found = daily.compute(spark, "outliers", day_path, DAY)
    assert [(r["sensor"], r["measure"]) for r in dicts(found)] == [(sensors.OUTLIER, 9999.0)]


def test_matrix_report_has_thirteen_rows(spark, day_path):
    rows = dicts(daily.compute(spark, "matrix", day_path, DAY), "sensor")
    assert [r["sensor"] for r in rows] == sensors.MATRIX
    assert all(r[s.lower()] == 1.0 for r in rows for s in [r["sensor"]])


@pytest.mark.parametrize("name", sorted(daily.VIEWS))
def test_views_show(spark, day_path, capsys, name):
    daily.run(spark, name, day_path, DAY)
    assert daily.compute(spark, name, day_path, DAY).count() > 0


@pytest.fixture(scope="module")
def three_days(spark, day_path, tmp_path_factory):
    """A folder of three daily files, and the same readings in the device-day layout."""
    folder = tmp_path_factory.mktemp("three")
    text = open(day_path.replace("{date}", DAY)).read()
    for shift in (-1, 0, 1):
        day = dt.date(2017, 6, 17) + dt.timedelta(days=shift)
        moved = text
        # The local day covers parts of two days of stored time.
        for old in (dt.date(2017, 6, 16), dt.date(2017, 6, 17)):
            moved = moved.replace(f"{old}T", f"@{old + dt.timedelta(days=shift)}T")
        (folder / f"{day}.csv").write_text(moved.replace("@", ""))
    layout = str(tmp_path_factory.mktemp("layout") / "days")
    tables.write_device_days(read_readings(spark, str(folder)), layout)
    return str(folder), layout


@pytest.mark.parametrize("name", ["max-min", "outliers", "kmeans", "restarts", "device-statistic", "spearman"])
def test_one_day_of_many(spark, day_path, three_days, name):
    folder, layout = three_days
    from_file = daily.compute(spark, name, day_path, DAY)
    of_day = canonical(map(tuple, from_file.collect()), from_file.columns)
    for path, kind in ((folder, "csv"), (layout, "parquet")):
        found = daily.compute(spark, name, path, DAY, kind)
        assert canonical(map(tuple, found.collect()), found.columns) == of_day


def test_reports_leave_no_copies(spark, day_path, tmp_path):
    folder = Path(shared_folder(spark)) / f"sensorloom-{spark.sparkContext.applicationId}"
    before = {p.name for p in folder.glob("*")} if folder.exists() else set()
    daily.run(spark, "exceed", day_path, DAY, str(tmp_path))
    assert {p.name for p in folder.glob("*")} == before


def rows_of(df):
    return canonical(map(tuple, df.collect()), df.columns)


def test_all_reports_share_one_parse(spark, day_path, monkeypatch):
    parses, counted = [], []
    plain_raw, plain_sizes = daily.read_raw, daily.measure_groups
    monkeypatch.setattr(daily, "read_raw", lambda *a, **k: parses.append(a) or plain_raw(*a, **k))
    monkeypatch.setattr(daily, "measure_groups", lambda *a, **k: counted.append(k) or plain_sizes(*a, **k))
    names = [*daily.REPORTS, *daily.VIEWS]
    # No operator counts by itself.
    for module in (limits, relations, sessions):
        monkeypatch.setattr(module, "measure_groups", None)
    together = daily.compute_day(spark, names, day_path, DAY)
    assert len(parses) == 1
    # Sizes are sums of one count, and reports with the same groups share them.
    assert all(k == {"counted": "count"} for k in counted) and len(counted) < len(names) - 5
    monkeypatch.undo()
    for name in names:
        assert rows_of(together[name]) == rows_of(daily.compute(spark, name, day_path, DAY)), name


def test_all_reports_with_hot_groups(spark, day_path):
    names = ["top-value", "exceed", "boxplot", "outliers", "restarts", "device-statistic", "matrix", "spearman"]
    plain = daily.compute_day(spark, names, day_path, DAY)
    split = daily.compute_day(spark, names, day_path, DAY, hot_rows=10)
    for name in names:
        assert rows_of(split[name]) == rows_of(plain[name]), name


def test_several_reports_fill_their_tables(spark, day_path, tmp_path):
    counts = daily.run(spark, "max-min,outliers,device-type", day_path, DAY, str(tmp_path))
    assert counts["rejected"] == 1 and counts["lines"] > 1000
    for name in ("max-min", "outliers", "device-type"):
        table = daily.REPORTS[name].table
        written = tables.read_result(spark, table, str(tmp_path))
        expected = daily.compute(spark, name, day_path, DAY)
        assert rows_of(written) == rows_of(tables.conform(expected, table))


def test_rejects_are_counted_and_may_fail_a_run(spark, day_path, tmp_path):
    for name in ("max-min", "outliers", "device-type"):
        counts = daily.run(spark, name, day_path, DAY, str(tmp_path / name))
        assert counts["rejected"] == 1 and counts["lines"] > 1000
    for name in ("max-min", "max-min,boxplot"):
        with pytest.raises(ValueError, match="no readable time"):
            daily.run(spark, name, day_path, DAY, str(tmp_path / "failed"), most_rejected=0.0)
    assert not (tmp_path / "failed").exists()
    assert daily.run(spark, "max-min", day_path, DAY, str(tmp_path / "passed"), most_rejected=0.01)["rejected"] == 1


def test_a_corrected_day_is_replaced(spark, day_path, tmp_path):
    path, output = tmp_path / "day" / "{date}.csv", str(tmp_path / "out")
    (tmp_path / "day").mkdir()
    text = open(day_path.replace("{date}", DAY)).read()
    file = tmp_path / "day" / f"{DAY}.csv"
    for content, found, largest in ((text, 1, 9999.0), (text.replace(",9999,", ",50,"), 0, None)):
        file.write_text(content)
        for name in ("outliers", "max-min"):
            daily.run(spark, name, str(path), DAY, output, replace=True)
        assert tables.read_result(spark, "sensor_outliers", output).count() == found
        written = tables.read_result(spark, "limo_max_min", output)
        assert tables.duplicate_keys(written, "limo_max_min").count() == 0
        top = written.filter(written.sensor == sensors.OUTLIER).agg({"max": "max"}).first()[0]
        assert top == largest or top < 101
