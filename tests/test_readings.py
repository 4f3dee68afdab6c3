import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import parse_measure, parse_time, wall_seconds
from sensorloom.sources import readings as source
from tests.build import at, dicts, readings

HEADER = "deviceid,sensor,measure,timestamp"


def csv(tmp_path, lines, name="readings.csv"):
    path = tmp_path / name
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("abc", 0.0),
        ("", 0.0),
        (" 1.5 ", 1.5),
        ("1_000", 0.0),
        ("1d", 0.0),
        ("1.5f", 0.0),
        ("1.F ", 0.0),
        ("0x1p3", 0.0),
        ("-2e3", -2000.0),
        ("inf", float("inf")),
        ("-Infinity", float("-inf")),
        (None, 0.0),
    ],
)
def test_measure(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(parse_measure(F.col("text"))).first()[0] == expected


def test_measure_nan(spark):
    value = spark.createDataFrame([("nan",)], "text string").select(parse_measure(F.col("text")))
    assert value.first()[0] != value.first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2017-06-17T15:59:59.123Z", "2017-06-17T15:59:59"),
        ("2017-06-17T15:59:59", "2017-06-17T15:59:59"),
        ("2017-6-7T1:2:3", "2017-06-07T01:02:03"),
        ("2017-06-17 15:59:59", None),
        ("2017-06-17", None),
        ("2017-02-30T00:00:00", None),
        ("2017-06-17T15:59:60", None),
        ("bad", None),
        (None, None),
    ],
)
def test_time(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    value = df.select(parse_time(F.col("text"))).first()[0]
    assert value == (at(expected) if expected else None)


def test_time_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2017-03-12T02:30:00",)], "text string")
        ts = parse_time(F.col("text"))
        row = df.select(ts.alias("ts"), wall_seconds(ts).alias("s")).first()
        assert row["ts"] == at("2017-03-12T02:30:00")
        assert row["s"] == int(dt.datetime(2017, 3, 12, 2, 30, tzinfo=dt.timezone.utc).timestamp())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_csv_accepts_and_rejects(spark, tmp_path):
    path = csv(
        tmp_path,
        [
            "a,L1,1.5,2017-06-17T15:59:59Z",
            "a,L1,abc,2017-06-17T16:00:00Z",
            '"d,L1,2,2017-06-17T00:00:00Z',
            "b,L2,3,2017-06-17T00:00:00Z,extra",
            ",L3,4,2017-06-17T00:00:00Z",
            "short,line",
            "c,L1,4,bad",
            HEADER,
        ],
    )
    raw = source.read_raw(spark, path)
    good = dicts(source.read_readings(spark, path), "deviceid", "ts")
    assert [(r["deviceid"], r["sensor"], r["measure"]) for r in good] == [
        ("", "L3", 4.0),
        ('"d', "L1", 2.0),
        ("a", "L1", 1.5),
        ("a", "L1", 0.0),
        ("b", "L2", 3.0),
    ]
    shifted = [(r["date"], r["hour"]) for r in good if r["deviceid"] == "a"]
    assert shifted == [(dt.date(2017, 6, 17), 23), (dt.date(2017, 6, 18), 0)]
    assert sorted(r["deviceid"] for r in dicts(source.rejected(raw))) == ["c", "deviceid", "short"]


def test_csv_of_a_day(spark, tmp_path):
    csv(tmp_path, ["a,L1,1,2017-06-17T00:00:00Z"], "2017-06-17.csv")
    csv(tmp_path, ["b,L1,1,2017-06-18T00:00:00Z"], "2017-06-18.csv")
    day = source.read_readings(spark, f"{tmp_path}/{{date}}.csv", "2017-06-18")
    assert [r["deviceid"] for r in dicts(day)] == ["b"]


def test_sequence_follows_the_file(spark, tmp_path):
    path = csv(tmp_path, [f"a,L1,{i},2017-06-17T00:00:00Z" for i in range(50)])
    rows = source.read_readings(spark, path).orderBy("ts", "seq").collect()
    assert [r["measure"] for r in rows] == [float(i) for i in range(50)]


def test_day_filter_is_half_open(spark):
    df = readings(
        spark,
        [
            ("a", "s", 1, "2017-06-16T15:59:59"),
            ("a", "s", 2, "2017-06-16T16:00:00"),
            ("a", "s", 3, "2017-06-17T15:59:59"),
            ("a", "s", 4, "2017-06-17T16:00:00"),
        ],
    )
    assert sorted(r["measure"] for r in dicts(source.on_day(df, "2017-06-17"))) == [2.0, 3.0]


def test_day_windows_hold_each_time_once(spark):
    df = readings(spark, [("a", "s", 1, "2017-06-17T16:00:00"), ("a", "s", 1, "2017-06-18T03:00:00")])
    windows = source.day_windows(df)
    rows = dicts(windows, "date")
    assert rows[0] == {
        "date": dt.date(2017, 6, 17),
        "start_ts": at("2017-06-16T16:00:00"),
        "end_ts": at("2017-06-17T16:00:00"),
    }
    inside = df.join(windows, (df.ts >= windows.start_ts) & (df.ts < windows.end_ts))
    assert inside.count() == 2


def test_ingest(spark):
    rows = [
        ("a", "t", "s", 1.0, at("2017-06-30T00:00:00"), "x"),
        ("a", "t", "test", 1.0, at("2017-06-30T01:00:00"), "x"),
        ("a", "t", None, 1.0, at("2017-06-30T02:00:00"), "x"),
        ("a", "t", "s", 1.0, at("2017-07-01T00:00:00"), "x"),
    ]
    documents = spark.createDataFrame(
        rows,
        "deviceid string, topic string, sensor string, measure double, timestamp timestamp_ntz,"
        " other string",
    )
    kept = source.ingest_documents(documents, at("2017-06-30T00:00:00"), at("2017-07-01T00:00:00"))
    assert kept.columns == source.DOCUMENT_FIELDS
    assert sorted(str(r["sensor"]) for r in dicts(kept)) == ["None", "s"]


def test_typed_table(spark):
    df = spark.createDataFrame(
        [(1, "k", None, at("2017-06-17T16:00:00.5"), 7)],
        "who long, kind string, amount double, at timestamp_ntz, number long",
    )
    row = dicts(source.readings_from_columns(df, "who", "kind", "amount", "at", "number"))[0]
    assert (row["measure"], row["date"], row["hour"], row["seq"]) == (0.0, dt.date(2017, 6, 18), 0, 7)
