"""Every registered query against its DuckDB check, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kpiloom.plans.registry import CHECKS, QUERIES
from kpiloom.plans.tables import GIVEN

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

WITHOUT_CHECK = {"report_document", "header_match", "review_load"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def ordered(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in places) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF_DIR)
    got = frame.collect()
    if name in WITHOUT_CHECK:
        assert got
        return
    result = db.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert ordered(got, frame.columns) == ordered(result.fetchall(), names)


def test_entry(spark):
    rows = {r["kpi_id"]: r for r in entry.entry(spark).collect()}
    assert rows["avg_unit_price"]["flags"].startswith("value 2")
    assert set(CHECKS) == set(QUERIES) - WITHOUT_CHECK
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())
