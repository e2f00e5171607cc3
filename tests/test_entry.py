"""Every registered query against its SQL, on whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from letterloom.plans.oracle import ORACLE_SQL
from letterloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert normal(frame.columns, frame.collect()) == normal(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "score", "doc_id"]
