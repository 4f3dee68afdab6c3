"""Small readings tables for tests."""

import datetime as dt

from sensorloom.sources.readings import with_local_time

SCHEMA = "deviceid string, sensor string, measure double, ts timestamp_ntz, seq long"


def at(text):
    return dt.datetime.fromisoformat(text)


def readings(spark, rows, offset_hours=8):
    """Readings from (deviceid, sensor, measure, time) in file order."""
    numbered = [
        (device, sensor, float(measure), at(ts) if isinstance(ts, str) else ts, seq)
        for seq, (device, sensor, measure, ts) in enumerate(rows)
    ]
    return with_local_time(spark.createDataFrame(numbered, SCHEMA), offset_hours)


def sequence(spark, values, sensor="s", device="d", start="2017-06-17T00:00:00", step=1):
    """One sensor's readings, ``step`` seconds apart."""
    first = at(start)
    return readings(
        spark,
        [
            (device, sensor, value, first + dt.timedelta(seconds=i * step))
            for i, value in enumerate(values)
        ],
    )


def hourly_states(spark, states, first_hour=0, sensor="state", extra=()):
    """States one hour apart on the local day 2017-06-17, with local time equal to stored time."""
    rows = [
        ("d", sensor, state, f"2017-06-17T{first_hour + i:02d}:00:00")
        for i, state in enumerate(states)
    ]
    return readings(spark, rows + list(extra), offset_hours=0)


def dicts(df, *order):
    rows = [row.asDict() for row in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[name]) for name in order)) if order else rows
