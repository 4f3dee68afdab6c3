"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as registered
from tests.oracle import TESTDATA, connect, spark_rows, sql_rows

SF_DIR = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_matches_sql(spark, connection, name):
    columns, rows = spark_rows(registered.queries()[name](spark, SF_DIR))
    expected_columns, expected = sql_rows(connection, registered.oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry_has_rows(spark):
    assert registered.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(registered.oracle_sql()) <= set(registered.queries())
