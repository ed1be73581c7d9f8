"""Every registered query of the library against DuckDB on the smallest tables."""

import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from quern.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return datetime(x.year, x.month, x.day).isoformat()
    return str(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = df.collect()
    assert name in catalog.ORACLE_SQL
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    have = Counter(tuple(map(plain, r)) for r in got)
    assert have == want
