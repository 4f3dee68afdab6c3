"""Operators whose groups are all cut into chunks, against the SQL of the registered queries."""

import pytest

import __spark_entry__ as registered
from sensorloom.operators import limits, ordered, relations, sessions
from sensorloom.operators.ordered import measure_groups
from tests.oracle import TESTDATA, connect, spark_rows, sql_rows

SF_DIR = str(TESTDATA / "sf0.001")
DEVICE, SENSOR = ("deviceid",), ("sensor",)
LIMIT = 12

rounded = registered._rounded

ON_READINGS = {
    "quartiles_by_sensor": lambda r: limits.quartiles(r, SENSOR, LIMIT),
    "outliers_by_sensor": lambda r: limits.outliers(r, SENSOR, "both", LIMIT),
    "top_value_by_device": lambda r: limits.top_value(r, ("deviceid", "sensor"), 0.1, LIMIT),
    "exceed_by_hour": lambda r: limits.exceed_by_hour(r, ("deviceid", "sensor"), 0.1, LIMIT),
    "exceed_by_hour_sensor": lambda r: limits.exceed_by_hour(r, SENSOR, hot_rows=LIMIT),
    "aligned_readings": lambda r: relations.align(r, registered.LISTED, hot_rows=LIMIT),
    "pearson_pair_all": lambda r: rounded(
        relations.pearson(r, "click", "view", (), hot_rows=LIMIT), "corr"
    ),
    "spearman_pair": lambda r: rounded(
        relations.spearman(r, "click", "view", hot_rows=LIMIT), "corr"
    ),
    "spearman_pair_all": lambda r: rounded(
        relations.spearman(r, "click", "view", (), hot_rows=LIMIT), "corr"
    ),
    "corr_matrix": lambda r: rounded(
        relations.corr_matrix(r, registered.SENSORS, hot_rows=8), "corr"
    ),
}

ON_STATES = {
    "restart_count": lambda r: sessions.restart_count(r, "click", DEVICE, hot_rows=LIMIT),
    "run_sessions": lambda r: rounded(
        sessions.run_sessions(r, "click", "view", DEVICE, hot_rows=LIMIT), "avg_current"
    ),
}


def forced(r, keys, sensors=None):
    """Sizes that split all groups into chunks of two steps and never broadcast."""
    rows = r if sensors is None else r.filter(r.sensor.isin(sensors))
    return measure_groups(rows, list(keys), LIMIT, broadcast_rows=0, shuffle_chunks=3)


BY_SHUFFLE = {
    "quartiles_by_sensor": lambda r: limits.quartiles(r, SENSOR, sizes=forced(r, SENSOR)),
    "outliers_by_sensor": lambda r: limits.outliers(r, SENSOR, "both", sizes=forced(r, SENSOR)),
    "exceed_by_hour_sensor": lambda r: limits.exceed_by_hour(r, SENSOR, sizes=forced(r, SENSOR)),
    "aligned_readings": lambda r: relations.align(
        r, registered.LISTED, sizes=forced(r, ["date", "sensor"], registered.LISTED)
    ),
    "spearman_pair": lambda r: rounded(
        relations.spearman(r, "click", "view", sizes=forced(r, ["date"])), "corr"
    ),
}

STATES_BY_SHUFFLE = {
    "restart_count": lambda r: sessions.restart_count(r, "click", DEVICE, sizes=forced(r, DEVICE)),
    "run_sessions": lambda r: rounded(
        sessions.run_sessions(r, "click", "view", DEVICE, sizes=forced(r, DEVICE)), "avg_current"
    ),
}


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def check(connection, name, result):
    assert spark_rows(result) == sql_rows(connection, registered.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(ON_READINGS))
def test_readings(spark, connection, name):
    check(connection, name, ON_READINGS[name](registered._readings(spark, SF_DIR)))


@pytest.mark.parametrize("name", sorted(ON_STATES))
def test_states(spark, connection, name):
    check(connection, name, ON_STATES[name](registered._states(spark, SF_DIR)))


@pytest.mark.parametrize("name", sorted(BY_SHUFFLE))
def test_readings_by_shuffle(spark, connection, name):
    check(connection, name, BY_SHUFFLE[name](registered._readings(spark, SF_DIR)))


@pytest.mark.parametrize("name", sorted(STATES_BY_SHUFFLE))
def test_states_by_shuffle(spark, connection, name):
    check(connection, name, STATES_BY_SHUFFLE[name](registered._states(spark, SF_DIR)))


@pytest.mark.parametrize("merge_rows", [0, 10**9])
def test_merging_does_not_change_results(spark, connection, monkeypatch, merge_rows):
    monkeypatch.setattr(limits, "MERGE_ROWS", merge_rows)
    readings = registered._readings(spark, SF_DIR)
    check(connection, "quartiles_by_sensor", limits.quartiles(readings, SENSOR))
    check(connection, "exceed_by_hour_sensor", limits.exceed_by_hour(readings, SENSOR))


def test_spearman_counts_at_most_twice(spark, monkeypatch):
    counts = []
    plain = ordered.measure_groups
    monkeypatch.setattr(relations, "measure_groups", lambda *a, **k: counts.append(a) or plain(*a, **k))
    relations.spearman(registered._readings(spark, SF_DIR), "click", "view", hot_rows=LIMIT).collect()
    assert len(counts) <= 2
