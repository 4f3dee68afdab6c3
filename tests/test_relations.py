import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from sensorloom.operators import relations
from tests.build import dicts, readings

HOT = pytest.mark.parametrize("hot_rows", [5, 10**6])


def columns(spark, **series):
    """One reading per second of each named sensor; extra readings stay without a partner."""
    start = dt.datetime(2017, 6, 17)
    rows = [
        ("d", sensor, value, start + dt.timedelta(seconds=i))
        for sensor, values in series.items()
        for i, value in enumerate(values)
    ]
    return readings(spark, rows)


@HOT
def test_alignment_ends_with_the_shortest(spark, hot_rows):
    df = columns(spark, a=range(10), b=range(100, 108))
    rows = dicts(relations.align(df, ["b", "a"], hot_rows=hot_rows), "position")
    assert [(r["position"], r["b"], r["a"]) for r in rows] == [(i, 100 + i, i) for i in range(7)]
    assert relations.align(df, ["a", "b"], drop_last=False, hot_rows=hot_rows).count() == 8


def test_alignment_needs_every_sensor(spark):
    df = columns(spark, a=range(10), b=range(10))
    assert relations.align(df, ["a", "b", "c"]).count() == 0


def test_alignment_by_device(spark):
    rows = [
        (device, sensor, i, f"2017-06-17T00:00:{i:02d}")
        for device, n in (("x", 5), ("y", 3))
        for sensor in ("a", "b")
        for i in range(n)
    ]
    aligned = relations.align(readings(spark, rows), ["a", "b"], keys=("date", "deviceid"))
    counts = {r["deviceid"]: r["count"] for r in dicts(aligned.groupBy("deviceid").count())}
    assert counts == {"x": 4, "y": 2}


@HOT
def test_equal_times_follow_the_sequence(spark, hot_rows):
    rows = [("d", s, i, "2017-06-17T00:00:00") for i in range(20) for s in ("a", "b")]
    aligned = relations.align(readings(spark, rows), ["a", "b"], hot_rows=hot_rows)
    assert all(r["a"] == r["b"] == r["position"] for r in dicts(aligned))


@HOT
def test_correlations_against_ml(spark, hot_rows):
    rng = random.Random(3)
    x = [rng.choice([0, 0, 0, rng.random()]) for _ in range(60)]
    y = [v + rng.choice([0, 0, rng.random()]) for v in x]
    df = columns(spark, x=x, y=y)
    pairs = VectorAssembler(inputCols=["x", "y"], outputCol="v").transform(
        relations.align(df, ["x", "y"])
    )
    for operator, method in ((relations.pearson, "pearson"), (relations.spearman, "spearman")):
        expected = Correlation.corr(pairs, "v", method).first()[0].toArray()[0, 1]
        row = dicts(operator(df, "x", "y", hot_rows=hot_rows))[0]
        assert row["corr"] == pytest.approx(expected, abs=1e-9)
        assert row["pairs"] == 59
        whole = dicts(operator(df, "x", "y", keys=(), hot_rows=hot_rows))[0]
        assert whole["corr"] == pytest.approx(expected, abs=1e-9)


def test_constant_column_has_no_correlation(spark):
    df = columns(spark, x=[1, 1, 1], y=[2, 3, 4])
    assert dicts(relations.pearson(df, "x", "y"))[0]["corr"] is None
    assert dicts(relations.spearman(df, "x", "y"))[0]["corr"] is None
    matrix = {(r["sensor_a"], r["sensor_b"]): r["corr"] for r in dicts(relations.corr_matrix(df, ["x", "y"]))}
    assert matrix == {("x", "x"): 1.0, ("y", "y"): 1.0, ("x", "y"): None, ("y", "x"): None}


def test_wide_matrix_of_thirteen(spark):
    rng = np.random.default_rng(5)
    names = [f"L{i:04d}" for i in range(13)]
    values = rng.normal(size=(13, 40))
    values[1] += values[0]
    df = columns(spark, **{name: [float(v) for v in row] for name, row in zip(names, values)})
    long = relations.corr_matrix(df, names)
    wide = dicts(relations.wide_matrix(long, names), "sensor")
    found = np.array([[row[name.lower()] for name in names] for row in wide])
    assert np.allclose(found, np.corrcoef(values[:, :39]), atol=1e-9)


def test_clusters_of_tight_groups(spark):
    rng = random.Random(1)
    points = [
        (centre + rng.random(), 2 * centre + rng.random())
        for centre, n in ((0, 5), (50, 7), (100, 9))
        for _ in range(n)
    ]
    rng.shuffle(points)
    df = columns(spark, a=[p[0] for p in points] + [0], b=[p[1] for p in points] + [0])
    first = dicts(relations.kmeans_clusters(df, ["a", "b"]), "clusterid")
    again = dicts(relations.kmeans_clusters(df, ["a", "b"]), "clusterid")
    assert sorted(r["cluster_num"] for r in first) == [5, 7, 9]
    assert first == again


def test_points_belong_to_the_nearest_centre(spark):
    rng = random.Random(2)
    values = {s: [rng.random() * 10 for _ in range(80)] for s in ("a", "b", "c")}
    aligned = relations.align(columns(spark, **values), ["a", "b", "c"])
    model, clustered = relations.fit_clusters(aligned, ["a", "b", "c"])
    centres = np.array(model.clusterCenters())
    rows = clustered.select("a", "b", "c", F.col("prediction")).collect()
    assert len(rows) == 79
    for a, b, c, found in rows:
        distances = ((centres - np.array([a, b, c])) ** 2).sum(axis=1)
        assert distances[found] == pytest.approx(distances.min())


def test_clusters_do_not_depend_on_the_layout(spark):
    rng = random.Random(9)
    values = {s: [rng.random() * 10 for _ in range(400)] for s in ("a", "b", "c")}
    df = columns(spark, **values)
    found = []
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(name) for name in names]
    try:
        for settings in (("2", "true", "128m"), ("8", "false", "1k"), ("32", "false", "128m"), ("32", "true", "2k")):
            for name, value in zip(names, settings):
                spark.conf.set(name, value)
            rows = dicts(relations.kmeans_clusters(df, ["a", "b", "c"], keys=("date",)), "clusterid")
            found.append([tuple(round(v, 9) for v in row.values()) for row in rows])
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert all(other == found[0] for other in found)


def test_clusters_of_every_date(spark):
    """Three groups of rows on one date, two rows on the next, one on the last."""
    rows = []
    for day, points in (("2017-06-17", [1, 2, 3, 500, 501, 90_000, 90_002]), ("2017-06-18", [7, 7, 9]), ("2017-06-19", [4])):
        for i, value in enumerate(points):
            rows += [("d", sensor, value + shift, f"{day}T01:{i:02d}:00") for sensor, shift in (("a", 0), ("b", 10))]
    df = readings(spark, rows, offset_hours=0)
    found = relations.kmeans_by_date(df, ["a", "b"], drop_last=False).orderBy("date", "sensor1").collect()
    assert [(str(r["date"]), r["cluster_num"], r["sensor1"], r["sensor2"]) for r in found] == [
        ("2017-06-17", 3, 2.0, 12.0), ("2017-06-17", 2, 500.5, 510.5), ("2017-06-17", 2, 90_001.0, 90_011.0),
        ("2017-06-18", 2, 7.0, 17.0), ("2017-06-18", 1, 9.0, 19.0),
        ("2017-06-19", 1, 4.0, 14.0),
    ]
    assert len({(r["date"], r["clusterid"]) for r in found}) == len(found)
    assert relations.kmeans_by_date(df.filter("measure < 0"), ["a", "b"]).count() == 0
