"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(frame):
    def text(value):
        if value is None or value is pd.NA or value != value:
            return ""
        if isinstance(value, float):
            return f"{value:.9g}"
        return str(value)

    rows = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else text(v) for v in row) for row in rows.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, SF_DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
