"""Relational queries on tables that the smallest ones do not stand for."""

from collections import Counter

import duckdb
import pytest

from quern.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """What Spark and DuckDB give for a query over tables made by Spark's SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, text in tables.items():
            spark.sql(text).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        return Counter(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())), Counter(con.execute(catalog.ORACLE_SQL[name]).fetchall())

    return run


def test_lateral_top_of_shuffled_orders(both):
    """Orders of many files and partitions; prices tie, and some are null."""
    orders = "SELECT /*+ REPARTITION(8) */ id AS o_orderkey, hash(id) % 500 AS o_custkey, CASE WHEN id % 3 > 0 THEN CAST(abs(hash(id, 1)) % 50 AS DOUBLE) END AS o_totalprice FROM range(20000)"
    have, want = both("join_lateral_topk", customer="SELECT id - 250 AS c_custkey FROM range(700) UNION ALL SELECT 7", orders=orders)
    assert have == want and len(want) > 400


@pytest.mark.parametrize("name", ["join_not_in", "join_not_in_null"])
@pytest.mark.parametrize("keys", ["SELECT id AS k, 2 AS line FROM range(40)", "SELECT CASE WHEN id > 3 THEN id END AS k, 2 AS line FROM range(40)", "SELECT id AS k, 2 AS line FROM range(0)", "SELECT id AS k, id % 2 + 1 AS line FROM range(40)"])
def test_not_in_without_sending_the_keys(spark, both, tmp_path, name, keys):
    """Nulls on either side and no keys at all, by a plan that has no null-aware join."""
    lines = f"SELECT k AS l_suppkey, CAST(line AS INT) AS l_linenumber, 50.0D AS l_quantity, 0.1D AS l_discount FROM ({keys})"
    have, want = both(name, supplier="SELECT id * 2 AS s_suppkey FROM range(30) UNION ALL SELECT NULL", lineitem=lines)
    assert have == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan
