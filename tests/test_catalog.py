"""Every registered query against the SQL it must agree with."""

import duckdb
import pytest

import __spark_entry__ as driver
from claimcheck import catalog
from tests.conftest import TESTDATA

SF_DIR = f"{TESTDATA}/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, oracle, name):
    frame = driver.queries()[name](spark, SF_DIR)
    rows = frame.collect()
    if name not in driver.oracle_sql():
        assert rows
        return
    result = oracle.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert table(frame.columns, rows) == table(columns, result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_only_unrepeatable_queries_lack_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {
        "profile_summarize_approx", "ml_fit_predict",
    }
