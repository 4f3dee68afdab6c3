"""Comparison of registered queries with their SQL on the same parquet tables."""

import math
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def connect(sf_dir):
    connection = duckdb.connect()
    for table in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return connection


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return str(value)


def canonical(rows, names):
    """Rows as sorted text, with the columns in name order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return sorted(df.columns), canonical([tuple(row) for row in df.collect()], df.columns)


def sql_rows(connection, sql):
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return sorted(names), canonical(result.fetchall(), names)
