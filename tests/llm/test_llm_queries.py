"""Registered queries with SQL, against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from quern.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in order) for r in result.fetchall())
