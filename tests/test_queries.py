"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from corpusloom import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_same_as_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    twin = db.sql(queries.oracles()[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    ours = sorted(repr([shown(r[c]) for c in columns]) for r in df.collect())
    assert ours == sorted(repr([shown(r[i]) for i in at]) for r in twin.fetchall())


def test_every_query_is_registered_once():
    assert set(queries.oracles()) <= set(queries.queries()) and len(queries.queries()) > 80
