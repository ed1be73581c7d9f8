"""Tables, load strategies, features, windows, quality, ad-hoc queries."""

import hashlib
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal
from typing import Annotated

import pytest

from quern.operators import analytics, features, quality, schema, strategies, windows
from quern.sources.snapshot import Snapshot


def spec(**more):
    return schema.any_spec(id="big_int!", name="text", **more)


def test_declared_tables(spark):
    @schema.table(schema="crm", unique=(("email",),))
    class Customer:
        id: Annotated[int, schema.PrimaryKey()]
        email: Annotated[str, schema.String(256), schema.Unique()]
        balance: Annotated[Decimal | None, schema.Numeric(12, 2)]
        since: date | None

    s = Customer.spec
    assert s.keys == ["id"] and s.struct.simpleString() == "struct<id:bigint,email:string,balance:decimal(12,2),since:date>"
    text = "crm.customer|id:BIGINT:N:p|email:VARCHAR(256):N:P|balance:NUMERIC(12,2):n:P|since:DATE:n:P|U:email|U:email"
    assert s.fingerprint == hashlib.sha256(text.encode()).hexdigest()[:32]
    swapped = schema.TableSpec("a", "t", s.columns, (("id",), ("email",)))
    assert swapped.fingerprint == schema.TableSpec("a", "t", s.columns, (("email",), ("id",))).fingerprint != s.fingerprint
    assert "fingerprint" in s.to_json() and "NOT NULL" in s.ddl()
    drift = schema.compare(s, spark.createDataFrame([], "id int, email string, extra int").schema)
    assert drift.missing == ("balance", "since") and drift.extra == ("extra",) and drift.types == (("id", "bigint", "int"),)
    with pytest.raises(schema.SchemaDrift):
        schema.conform(spark.createDataFrame([], "id int"), s)
    assert schema.conform(spark.createDataFrame([(1, "a")], "id int, name string"), spec()).schema["id"].dataType.simpleString() == "bigint"
    assert len(schema.scd2_columns(spec().struct)) == 6


@pytest.mark.parametrize("make", [lambda: schema.Numeric(40, 2), lambda: schema.Numeric(3, 4), lambda: schema.String(0), lambda: schema.ColumnType("blob"), lambda: schema.any_spec(a="text"), lambda: schema.TableSpec("s", "t", ())])
def test_bad_declarations(make):
    with pytest.raises(ValueError):
        make()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


def test_merge_edges(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    s = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "id int, v string")
    m = strategies.merge(t, s, ["id"])
    assert rows(m.table) == [(1, "a"), (2, "b"), (3, "c"), (4, None)] and m.counts() == {"inserted": 1, "updated": 1, "deleted": 0}
    assert rows(strategies.merge(t, s, ["id"], True).table) == [(1, "a"), (2, "b"), (4, None)]
    null = s.unionByName(spark.createDataFrame([(None, "n")], "id int, v string"))
    assert (3, "c") in rows(strategies.merge(t, null, ["id"], True).table)
    assert rows(strategies.hard_delete(t, s, ["id"]), "id") == [(1,), (2,)] and strategies.hard_delete(t, null, ["id"]).count() == 3
    with pytest.raises(strategies.DuplicateKeys):
        strategies.unique_keys(s.unionAll(s), ["id"])


def test_history(spark):
    day = lambda n: datetime(2024, 1, n)
    make = lambda *r: spark.createDataFrame(list(r), "id int, v string, ts timestamp")
    h = strategies.scd2(None, make((1, "a", day(1)), (1, "b", day(2)), (2, None, day(1))), ["id"], event_time="ts")
    assert rows(h, "id", "v", "is_current") == [(1, "b", True), (2, None, True)]
    h = strategies.scd2(h, make((1, "b", day(3)), (2, "x", day(3))), ["id"], event_time="ts")
    assert rows(h, "id", "v", "is_current", "valid_to") == [(1, "b", True, None), (2, "x", True, None), (2, None, False, day(3))]
    with pytest.raises(strategies.OutOfOrder):
        strategies.scd2(h, make((2, "y", day(2))), ["id"], event_time="ts")
    with pytest.raises(strategies.DuplicateKeys):
        strategies.scd2(None, make((1, "a", day(1)), (1, "b", day(2))).drop("ts"), ["id"], now=day(1))
    assert strategies.advance(make(), "ts", day(1)) == day(1) and strategies.advance(make((1, "a", day(4))), "ts", None) == day(4)
    gone = strategies.scd2_close_missing(h, make((2, "x", day(3))), ["id"], day(5))
    assert rows(gone.filter("id = 1"), "is_current", "valid_to") == [(False, day(5))]


def test_snapshots(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), ["k"])
    assert table.read() is None
    for n in range(4):
        table.update(lambda old, n=n: strategies.append(old, spark.createDataFrame([(n, n % 2)], "n int, k int"), datetime(2024, 1, 1), str(n)))
    assert rows(table.read(), "n", "_batch_id") == [(n, str(n)) for n in range(4)]
    with pytest.raises(Exception):
        table.update(lambda old: old.selectExpr("raise_error('no') AS n", "k"))
    assert table.read().count() == 4
    assert len(table.vacuum(1)) >= 3 and table.read().count() == 4


def test_features(spark):
    at = lambda d: datetime(2026, 1, d)
    view = spark.createDataFrame([(1, 100, at(1), at(6)), (1, 200, at(6), at(16)), (1, 300, at(16), None), (None, 9, at(1), None)], "id int, score int, valid_from timestamp, valid_to timestamp").withColumn("is_current", features.F.col("valid_to").isNull())
    for day, want in ((1, 100), (5, 100), (6, 200), (20, 300)):
        assert features.point_in_time(view, {"id": 1}, at(day)).first().score == want
    assert features.point_in_time(view, {"id": 1}, datetime(2025, 1, 1)).count() == 0
    spine = spark.createDataFrame([(1, at(3), "x"), (1, at(3), "x"), (2, at(3), "y"), (None, at(3), "z"), (1, None, "w"), (1, at(30), "v")], "id int, as_of timestamp, tag string")
    got = features.historical_features(spine, view, ["id"], ["score"])
    assert sorted((r.tag, r.score) for r in got.collect()) == [("v", 300), ("w", None), ("x", 100), ("x", 100), ("y", None), ("z", None)]
    assert features.training_set(spine, [("a", view, ["id"], ["score"]), ("b", view, ["id"], ["score"])]).columns[-2:] == ["a__score", "b__score"]
    assert features.online_features(view, ["id"], ["score"]).count() == 2
    with pytest.raises(ValueError):
        features.training_set(spine, [])


def test_windows(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    df = spark.createDataFrame([(1, at(s), v) for s, v in ((0, 1.0), (10, None), (20, 3.0), (31, 4.0), (45, 5.0), (100, 6.0))] + [(1, None, 9.0)], "k int, _event_ts timestamp, v double")
    A = windows.Aggregate
    every = (A("count", name="n"), A("count", "v"), A("sum", "v"), A("min", "v"), A("max", "v"), A("avg", "v"), A("first", "v"), A("last", "v"), A("count_distinct", "v"))
    config = windows.WindowConfig("session", ("k",), every, gap_ms=20_000, max_session_duration_ms=40_000)
    got = [tuple(r)[1:3] + tuple(r)[4:] for r in windows.windowed(df, config).orderBy("window_start").collect()]
    assert got == [(at(0), at(31), 4, 3, 8.0, 1.0, 4.0, 8 / 3, 1.0, 4.0, 3), (at(45), at(45), 1, 1, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 1), (at(100), at(100), 1, 1, 6.0, 6.0, 6.0, 6.0, 6.0, 6.0, 1)]
    t = windows.windowed(df, windows.WindowConfig("tumbling", (), (A("count", name="n"),), duration_ms=30_000)).orderBy("window_start").collect()
    assert [(r.window_start, r.n) for r in t] == [(at(0), 3), (at(30), 2), (at(90), 1)]
    assert windows.state_bytes(config) == 100_000 * (96 + 24 * 9 + 17 + 64)
    for bad in (dict(kind="session", gap_ms=1, max_session_duration_ms=1), dict(kind="session", group_by=("k",), gap_ms=1), dict(kind="tumbling"), dict(kind="hopping", duration_ms=5, hop_ms=9), dict(kind="sliding"), dict(kind="tumbling", duration_ms=1, late_data="keep")):
        with pytest.raises(ValueError):
            windows.WindowConfig(**bad)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "c")], "id bigint, name string")
    out = quality.run_expectations(df, spec(more="text"), {"short": "length(name) < 2"}, freshness=None)
    assert {a.name: a.verdict for a in out.assertions} == {"column(more)": "fail", "not_null(id)": "pass", "short": "fail", "unique(id)": "fail"} and out.verdict == "fail"
    assert quality.run_expectations(df).verdict == "empty"
    assert quality.run_expectations(df, conditions={"x": "id > 0"}).verdict == "pass"
    now = datetime(2024, 1, 1, 12, tzinfo=UTC)
    state = lambda minutes: quality.evaluate_freshness(now - timedelta(minutes=minutes), "10m", now)["state"]
    assert [state(m) for m in (1, 8, 10, 11)] == ["healthy", "warning", "warning", "breached"]
    assert quality.evaluate_freshness(None, 60)["state"] == "breached" and quality.parse_duration("2h") == timedelta(hours=2)
    with pytest.raises(ValueError):
        quality.parse_duration("soon")


def test_guard(spark):
    good = analytics.guard_readonly("-- c\nSELECT 'a;b -- c' /* x */ FROM t ; ")
    assert good.startswith("SELECT 'a;b -- c'")
    for bad in ("", None, "DROP TABLE t", "SELECT 1; SELECT 2", "FROM t INSERT INTO u SELECT *", "SELECT reflect('a', 'b')"):
        with pytest.raises(analytics.QueryError):
            analytics.guard_readonly(bad)
    paths = ("SELECT * FROM parquet.`/x`", "SELECT 1 FROM range(2) WHERE EXISTS (SELECT 1 FROM csv.`/x`)", "WITH a AS (SELECT * FROM text.`/x`) SELECT * FROM a", "EXPLAIN SELECT (SELECT max(a) FROM json.`/x`)")
    for bad in (*paths, "SELECT * FROM '/x'", "EXPLAIN ATTACH 'x'", "SELECT * FROM read_files('/x')", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(analytics.QueryError):
            analytics.guard_plan(spark, analytics.guard_readonly(bad))
    analytics.guard_plan(spark, "WITH a AS (SELECT * FROM default.t, range(3)) SELECT * FROM a WHERE id IN (SELECT id FROM b)")
    with pytest.raises(analytics.QueryError, match="more than"):
        analytics.Runner(spark, timeout_seconds=0.5).run("SELECT sum(a.id * b.id % 7) FROM range(10000000) a JOIN range(100000) b ON a.id <> b.id")
    assert analytics.guard_readonly("SELECT glob FROM t") and analytics.guard_readonly("SELECT 'drop table x' AS s")
    run = analytics.Runner(spark)
    r = run.run("SELECT id FROM range(20)", 5)
    assert len(r.rows) == 5 and r.truncated and run.run("SELECT id FROM range(20)", 5) is r
    assert run.run("SELECT id FROM range(20)", filters={"id": [3, 4], "other": [1]}).rows == [(3,), (4,)]
    said = analytics.evaluate_alert(spark.range(10), "id", ">=", 8)
    assert said == {"triggered": True, "matched": 2, "rows_evaluated": 10}
    with pytest.raises(analytics.QueryError):
        analytics.evaluate_alert(spark.range(1), "x", ">", 1)
    spark.range(1).createOrReplaceTempView("seen")
    assert analytics.catalogue(spark)["seen"] == [("id", "bigint")]
    assert "pipeline p (merge)" in analytics.preview("p", "merge", spark.range(3)).text()
