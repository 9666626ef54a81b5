"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from storepulse.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [int(name[2:].split("_")[0]) for name in queries()] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    expect = con.execute(oracle_sql()[name])
    columns = [c[0] for c in expect.description]
    found = queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expect.fetchall())
