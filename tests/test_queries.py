"""Every named query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, (float, np.floating)):
        return float(value)
    if isinstance(value, (int, np.integer)):
        return float(value)
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    got = rows(QUERIES[name](spark, FOLDER).toPandas())
    if name in ORACLES:
        assert got == rows(database.execute(ORACLES[name]).df())
    else:
        assert got[1]


def test_entry(spark):
    assert contract.entry(spark).count() == 2


def test_notification_ids_are_numbers(spark):
    ids = QUERIES["e03_notification_rows"](spark, FOLDER)
    assert ids.count() and not ids.filter(~ids["notification_id"].rlike(r"^\d+$")).count()
