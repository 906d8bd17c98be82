"""Queries with a SQL form give the same rows as that SQL; the others have their columns."""

import duckdb
import pytest

from tallycast.llm.oracles import ORACLES
from tallycast.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in "documents pages benchmark labels".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, tiny, name):
    rows = QUERIES[name](spark, tiny)
    columns = sorted(rows.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in rows.collect())
    relation = duck.execute(ORACLES[name])
    order = [d[0] for d in relation.description]
    assert sorted(order) == columns
    want = sorted(tuple(str(r[order.index(c)]) for c in columns) for r in relation.fetchall())
    assert got == want


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
