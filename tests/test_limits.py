import bisect
import datetime as dt
import random

import pytest

from sensorloom.operators import limits
from tests.build import dicts, readings, sequence

SENSOR = ("sensor",)


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        (range(1, 7), (2, 3, 5)),
        (range(1, 13), (3, 6, 9)),
        ([4], (4, 4, 4)),
    ],
)
def test_quartiles_are_elements(spark, values, expected):
    row = dicts(limits.quartiles(sequence(spark, values), SENSOR))[0]
    assert (row["q1"], row["median"], row["q3"]) == expected


def test_boxplot(spark):
    row = dicts(limits.boxplot(sequence(spark, range(1, 13)), SENSOR))[0]
    assert (row["lower"], row["upper"]) == (-6.0, 18.0)


@pytest.mark.parametrize("hot_rows", [5, 10**6])
@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_outliers(spark, hot_rows, broadcast_rows):
    values = [*range(1, 13), -50, 100, 100]
    df = sequence(spark, values)

    def found(side):
        result = limits.outliers(df, SENSOR, side, hot_rows, broadcast_rows)
        return sorted(r["measure"] for r in dicts(result))

    assert found("upper") == [100.0, 100.0]
    assert found("both") == [-50.0, 100.0, 100.0]
    with pytest.raises(ValueError):
        limits.outliers(df, SENSOR, "lower")


@pytest.mark.parametrize(
    ("values", "top", "above"),
    [
        (list(range(1, 2001)), 1998, 2),
        ([1] * 1998 + [2] * 3, 2, 0),
        ([3, 1, 5, 2, 4], 5, 0),
    ],
)
@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_top_value(spark, values, top, above, hot_rows):
    df = sequence(spark, values)
    row = dicts(limits.top_value(df, hot_rows=hot_rows))[0]
    assert (row["topvalue"], row["count"]) == (top, len(values))
    counted = dicts(limits.exceed_by_hour(df, hot_rows=hot_rows))
    assert sum(r["count"] for r in counted) == above


def test_null_keys_are_a_group(spark):
    df = readings(spark, [(None, "s", i, "2017-06-17T00:00:00") for i in range(30)])
    for hot_rows in (5, 100):
        row = dicts(limits.top_value(df, ("deviceid",), 0.1, hot_rows))[0]
        assert (row["deviceid"], row["topvalue"], row["count"]) == (None, 26.0, 30)


def test_no_rows(spark):
    df = sequence(spark, [1]).filter("measure > 5")
    assert dicts(limits.quartiles(df)) == []
    assert dicts(limits.exceed_by_hour(df)) == []


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot_rows", [25, 10**6])
def test_random_groups_against_sorting(spark, seed, hot_rows):
    """One group has half of all rows and one value half of that group."""
    rng = random.Random(seed)
    start = dt.datetime(2017, 6, 17)
    rows = []
    for i in range(400):
        device = "hot" if i % 2 else f"d{rng.randrange(12)}"
        value = 7 if device == "hot" and rng.random() < 0.5 else rng.randrange(60)
        rows.append((device, "s", value, start + dt.timedelta(minutes=rng.randrange(600))))
    df = readings(spark, rows).cache()

    groups, by_hour = {}, {}
    for device, _, value, ts in rows:
        groups.setdefault(device, []).append(value)
    tops, quartiles = {}, {}
    for device, values in groups.items():
        values.sort()
        n = len(values)
        tops[device] = values[n - 1 - int(n * 0.1)]
        quartiles[device] = tuple(values[max(-(-n * q // 4), 1) - 1] for q in (1, 2, 3))
    for device, _, value, ts in rows:
        if value > tops[device]:
            key = (device, (ts + dt.timedelta(hours=8)).hour)
            by_hour[key] = by_hour.get(key, 0) + 1

    top = limits.top_value(df, ("deviceid",), 0.1, hot_rows)
    assert {r["deviceid"]: r["topvalue"] for r in dicts(top)} == tops
    found = limits.quartiles(df, ("deviceid",), hot_rows)
    assert {r["deviceid"]: (r["q1"], r["median"], r["q3"]) for r in dicts(found)} == quartiles
    exceed = limits.exceed_by_hour(df, ("deviceid",), 0.1, hot_rows)
    assert {(r["deviceid"], r["hour"]): r["count"] for r in dicts(exceed)} == by_hour
    whole = dicts(limits.top_value(df, (), 0.1, hot_rows))[0]
    everything = sorted(value for values in groups.values() for value in values)
    assert whole == {"topvalue": everything[len(everything) - 1 - 40], "count": 400}
    assert bisect.bisect_left(everything, whole["topvalue"]) <= 359
    df.unpersist()


def test_keys_of_result(spark):
    df = sequence(spark, range(20))
    assert limits.exceed_by_hour(df, SENSOR, 0.1, 5).columns == ["sensor", "hour", "count"]
    assert set(limits.quartiles(df, (), 5).columns) == {"q1", "median", "q3", "count"}
    assert limits.outliers(df, SENSOR).columns == ["sensor", "measure"]


@pytest.mark.parametrize("hot_rows", [25, 10**6])
def test_merging_equal_measures_changes_nothing(spark, monkeypatch, hot_rows):
    rng = random.Random(9)
    rows = [
        (rng.choice(["a", "b", None]), "s", rng.randrange(9), f"2017-06-17T{rng.randrange(15):02d}:00:00")
        for _ in range(300)
    ]
    df = readings(spark, rows)
    keys = ("deviceid",)

    def results():
        return [
            sorted(map(str, dicts(result)))
            for result in (
                limits.quartiles(df, keys, hot_rows),
                limits.top_value(df, keys, 0.2, hot_rows),
                limits.exceed_by_hour(df, keys, 0.2, hot_rows),
            )
        ]

    plain = results()
    monkeypatch.setattr(limits, "MERGE_ROWS", 1)
    assert results() == plain
    assert plain[2]
