"""Whole loads, transforms after them, watermarks, DataFrames in and out, databases, snapshots."""

import uuid
from datetime import datetime
from typing import Annotated

import pandas as pd
import pytest

from quern.functions import normalize as nz
from quern.functions import udf
from quern.operators import loads, schema, strategies
from quern.sources import connections, files
from quern.sources.snapshot import POINTERS, Snapshot


@pytest.fixture
def table(spark, tmp_path):
    return lambda name="t": Snapshot(spark, str(tmp_path / name))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_transforms_halt_or_go_on(spark):
    seen = []

    @loads.transform()
    def count(spark, parent):
        seen.append(parent and parent["rows"])
        return {"n": 3}

    def plain(spark):
        seen.append("plain")

    assert loads.TRANSFORMS["count"] is count and count(spark) == {"n": 3} and seen == [None]
    steps = ["CREATE OR REPLACE TEMPORARY VIEW made AS SELECT 1 AS x", count, plain, "SELECT * FROM there_is_none", "SELECT 1"]
    with pytest.raises(loads.TransformFailed) as failed:
        loads.run_transforms(spark, steps, {"rows": 7})
    assert [s.status for s in failed.value.steps] == ["success"] * 3 + ["failed"] and spark.table("made").count() == 1
    done = loads.run_transforms(spark, steps, None, continue_on_failure=True)
    assert [s.status for s in done] == ["success"] * 3 + ["failed", "success"]
    assert done[1].metrics == {"n": 3} and done[2].metrics is None and "there_is_none" in done[3].error
    assert seen == [None, 7, "plain", None, "plain"]


def test_sync_modes_and_online(spark, table):
    t, online = table(), table("online")
    make = lambda *r: spark.createDataFrame(list(r), "id int, v string")
    assert loads.sync("s", t, make((1, "a"), (2, "b")), "merge", ["id"]).rows == 2
    assert loads.sync("s", t, make((2, "c"), (3, "d")), "scd1", ["id"], delete_missing=True).rows == 2
    with pytest.raises(strategies.DuplicateKeys):
        loads.sync("s", t, make((2, "x"), (2, "y")), "merge", ["id"])
    assert rows(t.read()) == [(2, "c"), (3, "d")]
    loads.sync("s", t, make((None, "n"), (None, "m")), "merge", ["id"])  # null keys are inserted each
    assert t.read().count() == 4
    history = table("h")
    for now, r in ((datetime(2024, 1, 1), make((1, "a"), (2, "b"))), (datetime(2024, 2, 1), make((1, "z")))):
        loads.sync("h", history, r, "scd2", ["id"], now=now, delete_missing=True, online=online)
    assert rows(online.read()) == [(1, "z")] and history.read().count() == 3
    assert loads.online_features(online, id=1) == {"id": 1, "v": "z"} and loads.online_features(online, id=9) is None
    for bad in (lambda: loads.sync("x", t, make((1, "a")), "upsert"), lambda: loads.sync("x", t, make((1, "a")), "merge"), lambda: loads.online_features(None, id=1)):
        with pytest.raises(ValueError):
            bad()


def test_warehouse_sync(spark, table):
    store = loads.Watermarks(table("marks"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").createOrReplaceTempView("w")
    read = lambda sql: spark.sql(sql.replace('"', "`"))
    got = []
    run = lambda write: loads.warehouse_sync("p", read, "SELECT * FROM w ORDER BY id;", write, "SELECT id * 10 AS x FROM source", "id", store)

    def broken(df):
        raise OSError("target is down")

    with pytest.raises(OSError):
        run(broken)
    assert store.get("p") is None
    assert run(lambda df: got.append(rows(df))) == 2 and store.get("p") == "2"
    assert run(lambda df: got.append(rows(df))) == 0 and store.get("p") == "2"  # an empty read leaves it
    assert got == [[(10,), (20,)], []]
    assert loads.watermarked("SELECT 1;", "c", "o'k") == "SELECT * FROM (SELECT 1) AS src WHERE \"c\" > 'o''k'"
    for bad in (dict(incremental_column="id"), dict(incremental_column="none", store=store)):
        with pytest.raises(ValueError):
            loads.warehouse_sync("q", read, "SELECT * FROM w", print, **bad)


def test_dataframes_in_and_out(spark, table):
    made = schema.table(name="people")(type("People", (), {"__annotations__": {"id": Annotated[int, schema.PrimaryKey()], "name": Annotated[str, nz.trim()]}}))
    t = table()
    loads.write_df(pd.DataFrame({"name": [" a ", "b"], "id": ["1", "2"], "extra": [0, 0]}), t, made, "merge")
    assert rows(t.read()) == [(1, "a"), (2, "b")] and t.read().columns == ["id", "name"]
    with pytest.raises(schema.SchemaDrift):
        loads.write_df(pd.DataFrame({"id": [1]}), t, made)
    with pytest.raises(TypeError):
        loads.write_df([1], t)
    assert list(loads.read_df(spark, "SELECT 1 AS x", "pandas")["x"]) == [1]
    with pytest.raises(ValueError):
        loads.read_df(spark, "SELECT 1", "numpy")
    inferred = table("inferred")
    loads.write_df(spark.range(2), inferred)
    loads.write_df(spark.range(1), inferred)
    assert inferred.read().columns == ["id"] and inferred.read().count() == 3


def test_database(spark):
    c = connections.Connection("jdbc", {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"})
    db = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(c.jdbc_url)
    db.createStatement().executeUpdate('CREATE TABLE t ("id" INT PRIMARY KEY, "v" INT)')
    make = lambda *r: spark.createDataFrame(list(r), "id int, v int")
    loads.write_spark_df(make((1, 1), (2, 2)), c, "t")
    loads.write_spark_df(make((2, 20), (3, 30)), c, "t", "merge", ["id"])
    read = lambda: rows(loads.read_spark_df(spark, c, "SELECT * FROM t"))
    assert read() == [(1, 1), (2, 20), (3, 30)]
    with pytest.raises(Exception):  # noqa: B017
        loads.write_spark_df(make((9, 9), (1, 5)), c, "t")  # one key is there: all of it is rolled back
    assert read() == [(1, 1), (2, 20), (3, 30)]
    with pytest.raises(strategies.DuplicateKeys):
        loads.write_spark_df(make((7, 1), (7, 2)), c, "t", "merge", ["id"])
    loads.write_spark_df(make((5, 5)), c, "t", "truncate")
    assert read() == [(5, 5)]
    assert files.query(spark, c.jdbc_url, "SELECT * FROM t", partition=("id", 0, 10, 2)).count() == 1
    found = db.getMetaData().getTables(None, None, "quern_stage%", None)
    assert not found.next()  # no staging table is left
    for bad in (("scd2", ()), ("merge", ())):
        with pytest.raises(ValueError):
            loads.jdbc_statements("t", "s", ["a"], *bad)
    with pytest.raises(TypeError):
        loads.write_spark_df([1], c, "t")
    with pytest.raises(TypeError):
        loads.read_spark_df(None, c, "SELECT 1")


def test_source_factories_and_callbacks():
    pg = connections.Connection("postgres", {"host": "h", "database": "d"})
    assert connections.Source.postgres_table(pg, "s", "t").query == "SELECT * FROM s.t"
    assert connections.Source.postgres_table(pg, "s", "t", ["a", "b"]).query == "SELECT a, b FROM s.t"
    with pytest.raises(ValueError):
        connections.Source.snowflake_query(pg, "SELECT 1")
    udf.register_callback("twice", lambda x: 2 * x)
    assert udf.call_back("twice", 4) == 8
    with pytest.raises(KeyError):
        udf.call_back("none")
    with pytest.raises(TypeError):
        udf.register_callback("x", 3)


def test_a_crash_leaves_the_version_before(spark, table, monkeypatch):
    t = table()
    t.write(spark.range(3))
    first = t.current()

    def fail(*_):
        raise OSError("crash")

    with monkeypatch.context() as m:  # between the new version and its pointer
        m.setattr(t, "_fs", fail)
        m.setattr(t, "current", lambda: first)
        with pytest.raises(OSError):
            t.write(spark.range(9))
    assert t.current() == first and t.read().count() == 3
    t.update(lambda old: old.unionByName(spark.range(2)))
    assert t.read().count() == 5 and t._pointers()[0] == first
    t.write(spark.range(1))
    assert len(t.vacuum(1)) == 3 and t._pointers() == [t.current()] and t.read().count() == 1 and POINTERS == "_pointers"
