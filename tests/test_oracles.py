"""Each query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import math

import duckdb
import pytest

from quillon import plans

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = plans.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.sql(plans.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    assert plain(found.select(*columns).collect()) == plain(expected.select(*columns).fetchall())


def test_flagship(spark):
    rows = plans.flagship(spark, SF).collect()
    assert rows and all(r["content"] for r in rows)


def test_every_query_is_registered():
    assert len(plans.queries()) >= 70
