"""Every query with a SQL form gives the same rows as that SQL."""

import datetime as dt

import duckdb
import pytest

from tallycast.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, small, name):
    rows = QUERIES[name](spark, small)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    relation = duck.execute(ORACLES[name])
    order = [d[0] for d in relation.description]
    assert sorted(order) == columns
    places = [order.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in places) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["seasonal_fit", "forecast_selected", "run_history"])
def test_rows_only_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
