"""Queries that go through the library's own operators, with DuckDB SQL for what they must give."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import normalize as nz
from quern.functions.dialect import row_hash, translate
from quern.functions.udf import udaf, udf
from quern.operators import analytics, features, loads, quality, schema, strategies, windows
from quern.sources import connections, files, shared
from quern.sources.snapshot import Snapshot
from quern.streaming import cdc, dlq, events, pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A target that lacks every fifth customer, and a source in which every third balance is another."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = c.filter("c_custkey % 5 <> 0")
    source = c.filter("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return target, source


T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
_SOURCE = "s AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0), t AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0)"


# normalizers


@query("SELECT event_id, 'USER ' || user_id AS u, lower(event_type) AS l, left(event_type, 3) AS cut, nullif(event_type, 'view') AS n, coalesce(nullif(event_type, 'view'), 'none') AS d FROM events")
def norm_text(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" User "), "user_id", F.lit("  ")).alias("u"), F.upper("event_type").alias("l"), F.col("event_type").alias("cut"), F.col("event_type").alias("n"), F.col("event_type").alias("d"))
    return nz.normalize(df, {"u": [nz.trim(), nz.upper()], "l": [nz.lower()], "cut": [nz.truncate(3)], "n": [nz.nullif("view")], "d": [nz.nullif("view"), nz.default("none")]})


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'a' || event_id END AS e, replace(event_type, 'c', 'k') AS r, regexp_replace(props, '[^0-9]', '', 'g') AS digits, regexp_replace(props, '[0-9]', '#') AS first FROM events")
def norm_regex(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit("a"), "event_id")).alias("e"), F.col("event_type").alias("r"), F.col("props").alias("digits"), F.col("props").alias("first"))
    return nz.normalize(df, {"e": [nz.whitespace_to_null()], "r": [nz.replace("c", "k")], "digits": [nz.regex_replace("[^0-9]", "")], "first": [nz.regex_replace("[0-9]", "#", flags="")]})


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS i, CASE WHEN event_id % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) END AS d,
  CASE WHEN event_id % 3 = 1 THEN TRUE WHEN event_id % 3 = 2 THEN FALSE END AS b, least(greatest(value, 20.0E0), 60.0E0) AS c FROM events""")
def norm_parse(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    bad = F.col("event_id") % 3 == 0
    df = df.select("event_id", F.when(bad, "x1").otherwise(F.col("event_id").cast("string")).alias("i"), F.when(bad, "1.2.3").otherwise(F.format_string("%.2f", "value")).alias("d"), F.when(bad, "maybe").when(F.col("event_id") % 3 == 1, "Yes").otherwise("No").alias("b"), F.col("value").alias("c"))
    out = nz.normalize(df, {"i": [nz.parse_int()], "d": [nz.parse_numeric(12, 2, on_failure="default", default=-1)], "b": [nz.parse_bool()], "c": [nz.clamp(20.0, 60.0)]})
    return out.withColumn("d", F.col("d").cast("double"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 IN (1, 3) THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END AS t, CAST(ts AS DATE) AS d FROM events")
def norm_parse_timestamp(spark, sf_dir):
    df = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "MM/dd/yyyy")).when(k == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    df = df.select("event_id", text.alias("t"), F.date_format("ts", "yyyyMMdd").alias("d"))
    return nz.normalize(df, {"t": [nz.parse_timestamp()], "d": [nz.parse_date()]}).withColumn("t", F.col("t").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, value, value * 2 AS twice FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE value > 10) WHERE n = 1")
def norm_dedupe_derive(spark, sf_dir):
    df = nz.filter_where(read(spark, sf_dir, "events"), "value > 10")
    df = nz.deduplicate_by(df, "user_id", order_by=[F.desc("ts"), "event_id"]).select("event_id", "user_id", "value")
    return nz.normalize(df, {"twice": [nz.derive("value"), nz.sql("col * 2")]})


@query("SELECT c_custkey, sha256(c_custkey || chr(1) || c_mktsegment) AS h FROM customer")
def fn_row_hash(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", row_hash(["c_custkey", "c_mktsegment"]).alias("h"))


@query("SELECT user_id, arg_max(value, ts) AS v, CAST(count(*) AS BIGINT) AS \"n\" FROM events GROUP BY user_id")
def sql_dialect(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(translate('SELECT user_id, arg_max(value, ts) AS v, CAST(count(*) AS BIGINT) AS "n" FROM events GROUP BY user_id', "duckdb"))


@query("SELECT n_nationkey, CASE WHEN n_name LIKE '%1' THEN 1 ELSE 7 END AS a, CASE WHEN n_nationkey % 3 = 1 THEN 'true' WHEN n_nationkey % 3 = 2 THEN 'false' ELSE 'unknown' END AS b FROM nation")
def norm_default_and_bool(spark, sf_dir):
    """Nulls and texts that are no numbers get the default; ``t`` is neither true nor false."""
    n = read(spark, sf_dir, "nation")
    number = F.when(F.col("n_name").endswith("1"), "1").when(F.col("n_nationkey") % 2 == 0, "x")
    flag = F.when(F.col("n_nationkey") % 3 == 1, "YES").when(F.col("n_nationkey") % 3 == 2, "0").otherwise("t")
    return nz.normalize(n.select("n_nationkey", number.alias("a"), flag.alias("b")), {"a": [nz.parse_int(on_failure="default", default=7)], "b": [nz.parse_bool(), lambda c: c.cast("string"), nz.default("unknown")]})


# load strategies


@query(f"WITH {_SOURCE} SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS _batch_id FROM t UNION ALL SELECT c_custkey, c_name, c_acctbal, 'b1' FROM s")
def load_append(spark, sf_dir):
    target, source = customers(spark, sf_dir)
    return strategies.append(target, source, T1, "b1").drop("_loaded_at")


@query(f"WITH {_SOURCE} SELECT * FROM s")
def load_truncate(spark, sf_dir):
    target, source = customers(spark, sf_dir)
    table = Snapshot(spark, shared.folder(spark, "truncate"))
    table.write(target)
    table.update(lambda old: strategies.truncate(old, source))
    return table.read()


@query(f"WITH {_SOURCE} SELECT * FROM s UNION ALL SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s)")
def load_merge(spark, sf_dir):
    target, source = customers(spark, sf_dir)
    return strategies.merge(target, source, ["c_custkey"]).table


@query(f"WITH {_SOURCE} SELECT CAST(count(*) FILTER (WHERE t.c_custkey IS NULL) AS BIGINT) AS inserted, CAST(count(*) FILTER (WHERE t.c_custkey IS NOT NULL AND s.c_acctbal <> t.c_acctbal) AS BIGINT) AS updated FROM s LEFT JOIN t ON s.c_custkey = t.c_custkey")
def load_merge_counts(spark, sf_dir):
    target, source = customers(spark, sf_dir)
    changes = strategies.merge(target, source, ["c_custkey"]).changes
    return changes.agg(F.count_if(F.col("_change") == "insert").alias("inserted"), F.count_if(F.col("_change") == "update").alias("updated"))


@query(f"WITH {_SOURCE} SELECT * FROM s")
def load_merge_delete(spark, sf_dir):
    target, source = customers(spark, sf_dir)
    return strategies.merge(target, source, ["c_custkey"], delete_missing=True).table


@query(f"WITH {_SOURCE} SELECT * FROM t")
def load_merge_delete_null_key(spark, sf_dir):
    target, source = customers(spark, sf_dir)
    return strategies.hard_delete(target, source.withColumn("c_custkey", F.nullif("c_custkey", F.lit(1))), ["c_custkey"])


_CHANGED = "c AS (SELECT s.* FROM s LEFT JOIN t ON s.c_custkey = t.c_custkey WHERE t.c_custkey IS NULL OR s.c_acctbal <> t.c_acctbal)"
_SCD2 = f"""WITH {_SOURCE}, {_CHANGED}
SELECT t.*, TIMESTAMP '2024-01-01 00:00:00' AS valid_from, CASE WHEN c.c_custkey IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS valid_to, c.c_custkey IS NULL AS is_current FROM t LEFT JOIN c ON t.c_custkey = c.c_custkey
UNION ALL SELECT c.*, TIMESTAMP '2024-02-01 00:00:00', NULL, TRUE FROM c"""


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to") if c in df.columns}).drop("row_hash")


def _history(spark, sf_dir) -> DataFrame:
    target, source = customers(spark, sf_dir)
    return strategies.scd2(strategies.scd2(None, target, ["c_custkey"], now=T0), source, ["c_custkey"], now=T1)


@query(_SCD2)
def load_scd2(spark, sf_dir):
    return _plain(_history(spark, sf_dir))


@query("""WITH e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC) AS n, ts < TIMESTAMP '2024-01-15 00:00:00' AS early FROM events),
a AS (SELECT * FROM e WHERE n = 1 AND early), b AS (SELECT * FROM e WHERE n = 1 AND NOT early),
c AS (SELECT b.* FROM b LEFT JOIN a ON a.user_id = b.user_id WHERE a.user_id IS NULL OR a.event_type <> b.event_type)
SELECT a.user_id, a.event_type, a.ts AS valid_from, c.ts AS valid_to, c.user_id IS NULL AS is_current FROM a LEFT JOIN c ON a.user_id = c.user_id UNION ALL SELECT user_id, event_type, ts, NULL, TRUE FROM c""")
def load_scd2_event(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    split = F.col("ts") < F.lit(datetime(2024, 1, 15)).cast("timestamp")
    first = strategies.scd2(None, e.filter(split), ["user_id"], event_time="ts")
    return _plain(strategies.scd2(first, e.filter(~split), ["user_id"], event_time="ts"))


@query(f"WITH {_SOURCE} SELECT t.*, TIMESTAMP '2024-01-01 00:00:00' AS valid_from, CASE WHEN s.c_custkey IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS valid_to, s.c_custkey IS NOT NULL AS is_current FROM t LEFT JOIN s ON t.c_custkey = s.c_custkey")
def load_scd2_soft_delete(spark, sf_dir):
    target, source = customers(spark, sf_dir)
    return _plain(strategies.scd2_close_missing(strategies.scd2(None, target, ["c_custkey"], now=T0), source, ["c_custkey"], T1))


@query("""WITH e AS (SELECT user_id, max(ts) AS valid_from FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id)
SELECT user_id, valid_from, CASE WHEN valid_from < TIMESTAMP '2024-01-19 00:00:00' THEN TIMESTAMP '2024-01-20 00:00:00' END AS valid_to, valid_from >= TIMESTAMP '2024-01-19 00:00:00' AS is_current FROM e""")
def load_scd2_ttl(spark, sf_dir):
    now = datetime(2024, 1, 20)
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).filter(F.col("ts") < F.lit(now).cast("timestamp"))
    return _plain(strategies.scd2_expire(strategies.scd2(None, e, ["user_id"], event_time="ts"), 86400, now)).drop("event_type")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'")
def load_watermark(spark, sf_dir):
    return strategies.since(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", datetime(2024, 1, 20, 12))


@query(f"WITH {_SOURCE} SELECT TRUE AS raised, CAST(count(*) AS BIGINT) AS n FROM t")
def load_merge_duplicate(spark, sf_dir):
    """A source with two rows of one key raises, and the target stays as it was."""
    target, source = customers(spark, sf_dir)
    table = Snapshot(spark, shared.folder(spark, "duplicate"))
    table.write(target)
    try:
        loads.sync("duplicate", table, source.unionByName(source.limit(1)), "merge", ["c_custkey"])
        raised = False
    except strategies.DuplicateKeys:
        raised = True
    return table.read().agg(F.lit(raised).alias("raised"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SOURCE} SELECT c_custkey % 10 AS k, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_custkey FROM s UNION SELECT c_custkey FROM t) GROUP BY 1")
def load_post_transform(spark, sf_dir):
    """A merge, then SQL and a function that use what it made."""
    target, source = customers(spark, sf_dir)
    table = Snapshot(spark, shared.folder(spark, "transformed"))
    table.write(target)

    def publish(spark, parent):
        table.read().createOrReplaceTempView("merged")
        return {"rows": parent["rows"]}

    summary = "CREATE OR REPLACE TEMPORARY VIEW summary AS SELECT c_custkey % 10 AS k, count(*) AS n FROM merged GROUP BY 1"
    run = loads.sync("customers", table, source, "merge", ["c_custkey"], transforms=[publish, summary])
    if [s.status for s in run.steps] != ["success", "success"] or run.steps[0].metrics["rows"] != run.rows:
        raise ValueError(f"steps: {run.steps}")
    return spark.table("summary")


@query(f"WITH {_SOURCE} SELECT c_custkey, c_name, c_acctbal FROM s UNION ALL SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s)")
def load_online(spark, sf_dir):
    """The current versions of a history, in a table of their own after the second load."""
    target, source = customers(spark, sf_dir)
    table, online = Snapshot(spark, shared.folder(spark, "history")), Snapshot(spark, shared.folder(spark, "online"))
    for rows, now in ((target, T0), (source, T1)):
        loads.sync("history", table, rows, "scd2", ["c_custkey"], now=now, online=online)
    return online.read()


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) GROUP BY event_type UNION ALL SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY event_type")
def load_warehouse_sync(spark, sf_dir):
    """Two syncs with SQL in between; the second reads what is after the first one's watermark."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]
    table, store = Snapshot(spark, shared.folder(spark, "synced")), loads.Watermarks(Snapshot(spark, shared.folder(spark, "marks")))
    for rows in (e.filter(F.col("event_id") <= half), e):
        rows.createOrReplaceTempView("warehouse_events")
        loads.warehouse_sync("events", lambda sql: spark.sql(sql.replace('"', "`")), "SELECT * FROM warehouse_events;", lambda df: loads.write_df(df, table), "SELECT event_type, count(*) AS n FROM source GROUP BY event_type", "event_id", store)
    return table.read()


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def load_inferred(spark, sf_dir):
    """A DataFrame written without a declared table: its own columns, and no others."""
    table = Snapshot(spark, shared.folder(spark, "inferred"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    loads.write_df(rows.filter("s_suppkey % 2 = 0"), table)
    loads.write_df(rows.filter("s_suppkey % 2 = 1"), table)
    return table.read()


@query("SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def load_managed(spark, sf_dir):
    """A DataFrame merged into a declared table: normalized, cast and ordered as declared."""
    spec = schema.TableSpec("public", "suppliers", (schema.ColumnSpec("s_suppkey", schema.ColumnType("big_int"), False, True), schema.ColumnSpec("s_name", schema.ColumnType("text"), True, False, (nz.upper(),))))
    table = Snapshot(spark, shared.folder(spark, "managed"))
    rows = read(spark, sf_dir, "supplier").select("s_name", "s_acctbal", F.col("s_suppkey").cast("string").alias("s_suppkey"))
    for part in (rows.filter("s_suppkey % 3 <> 0").withColumn("s_name", F.lit("old")), rows):
        loads.write_df(part, table, schema.ManagedTable(spec), "merge")
    return table.read()


@query("SELECT n_nationkey, n_name || '!' AS n_name FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5")
def source_jdbc(spark, sf_dir):
    """Rows appended and merged into a database over JDBC, and read back by a query of two partitions."""
    import uuid

    base = connections.Connection("jdbc", {"url": f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true"})
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    db = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(base.jdbc_url)
    db.createStatement().executeUpdate('CREATE TABLE nations ("n_nationkey" BIGINT PRIMARY KEY, "n_name" VARCHAR(100))')
    loads.write_spark_df(nation.filter("n_nationkey < 10"), base, "nations", "append")
    changed = nation.filter("n_nationkey >= 5").withColumn("n_name", F.concat("n_name", F.lit("!")))
    loads.write_spark_df(changed, base, "nations", "merge", ["n_nationkey"])
    return files.query(spark, base.jdbc_url, "SELECT * FROM nations", partition=("n_nationkey", 0, 25, 2))


# features


@query("""WITH spine AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT event_id, value FROM spine ASOF LEFT JOIN f ON spine.user_id = f.user_id AND spine.ts >= f.ts""")
def join_asof(spark, sf_dir):
    """One sort of both sides carries the newest earlier row along; no pair is formed."""
    e = read(spark, sf_dir, "events")
    spine = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("as_of"))
    view = e.filter("event_type = 'view'").select("user_id", "value", F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return features.historical_features(spine, view, ["user_id"], ["value"]).select("event_id", "value")


@query("""WITH v AS (SELECT user_id, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE event_type = 'view'), s AS (SELECT event_id, user_id, ts AS as_of FROM events WHERE event_type = 'purchase')
SELECT event_id, s.user_id, as_of, value FROM s LEFT JOIN v ON s.user_id = v.user_id AND valid_from <= as_of AND (valid_to IS NULL OR valid_to > as_of)""")
def feat_historical(spark, sf_dir):
    spine, view = _features(spark, sf_dir, "view")
    return features.historical_features(spine, view, ["user_id"], ["value"])


def _features(spark, sf_dir, kind: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events")
    spine = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("as_of"))
    e.filter(F.col("event_type") == kind).createOrReplaceTempView("versions")
    return spine, spark.sql("SELECT user_id, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS is_current FROM versions")


@query("SELECT user_id, arg_max(value, ts) AS value FROM events WHERE event_type = 'view' GROUP BY user_id")
def feat_online(spark, sf_dir):
    return features.online_features(_features(spark, sf_dir, "view")[1], ["user_id"], ["value"])


@query("SELECT value FROM events WHERE event_type = 'view' AND user_id = 3 AND ts <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC LIMIT 1")
def feat_pit(spark, sf_dir):
    return features.point_in_time(_features(spark, sf_dir, "view")[1], {"user_id": 3}, datetime(2024, 1, 10), ["value"])


@query("""WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'), c AS (SELECT * FROM events WHERE event_type = 'click')
SELECT s.event_id, s.user_id, s.ts AS as_of, v.value AS views__value, c.value AS clicks__value FROM s ASOF LEFT JOIN v ON s.user_id = v.user_id AND s.ts >= v.ts ASOF LEFT JOIN c ON s.user_id = c.user_id AND s.ts >= c.ts""")
def feat_training_set(spark, sf_dir):
    spine, view = _features(spark, sf_dir, "view")
    _, click = _features(spark, sf_dir, "click")
    return features.training_set(spine, [("views", view, ["user_id"], ["value"]), ("clicks", click, ["user_id"], ["value"])])


# windows, sessions, streams

_SESSIONS = windows.WindowConfig("session", ("user_id",), (windows.Aggregate("count", name="n"), windows.Aggregate("max", "value", "top")), gap_ms=3_600_000, max_session_duration_ms=4 * 3_600_000, event_time_column="ts")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, ts, value, i, ts AS s FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.ts, e.value, e.i, CASE WHEN e.ts - w.ts > INTERVAL '1 hour' OR e.ts - w.s >= INTERVAL '4 hours' THEN e.ts ELSE w.s END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, s AS window_start, max(ts) AS window_end, CAST(count(*) AS BIGINT) AS n, max(value) AS top FROM w GROUP BY user_id, s""")
def evt_session_capped(spark, sf_dir):
    return windows.windowed(read(spark, sf_dir, "events"), _SESSIONS).drop("session_id")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.sources import files

    known = read(spark, sf_dir, "events").schema
    return files.stream(spark, f"{sf_dir}/events.parquet", known).withColumn("_event_ts", F.col("ts").cast("timestamp"))


def _finished(spark: SparkSession, name: str, stream: DataFrame, **more) -> DataFrame:
    path = shared.folder(spark, name)
    run = pipeline.StreamPipeline(name, stream, [pipeline.parquet_target(f"{path}/out")], f"{path}/checkpoint", **more)
    run.start().awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


def _in_steps(spark: SparkSession, sf_dir: str, name: str, parts: list[str], targets: list[pipeline.Target] | None = None, **more) -> DataFrame | None:
    """Events as a stream that gets those of one condition after the other, in as many files as they are read in.

    The pipeline goes to the stream's end after each, and on from its checkpoint after the next, so each step is a batch.
    """
    path, e, run = shared.folder(spark, name), read(spark, sf_dir, "events"), None
    for part in parts:
        e.filter(part).write.mode("append").parquet(f"{path}/in")
        if run is None:
            stream = files.stream(spark, f"{path}/in", e.schema).withColumn("_event_ts", F.col("ts").cast("timestamp"))
            run = pipeline.StreamPipeline(name, stream, targets or [pipeline.parquet_target(f"{path}/out")], f"{path}/checkpoint", **more)
        run.run()
    return spark.read.parquet(f"{path}/out").drop("batch") if targets is None else None


_EARLY, _MIDDLE = "ts < TIMESTAMP '2024-01-08 00:00:00'", "ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"
_HELD = "event_id % 10 = 0"
_PARTS = [f"{_EARLY} AND NOT {_HELD}", _MIDDLE, f"{_EARLY} AND {_HELD} OR ts >= TIMESTAMP '2024-01-20 00:00:00'"]
_DAYS = dict(kind="tumbling", group_by=("event_type",), aggregates=(windows.Aggregate("count", name="n"), windows.Aggregate("sum", "user_id", "users")), duration_ms=86_400_000)
_CLOSED = "HAVING time_bucket(INTERVAL '1 day', min(ts)) + INTERVAL '1 day' <= (SELECT max(ts) FROM events)"


@query(f"SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE NOT ({_EARLY} AND {_HELD}) GROUP BY 1, 2 {_CLOSED}")
def stream_late_drop(spark, sf_dir):
    """A tenth of the first week's events comes two weeks late and is dropped."""
    out = _in_steps(spark, sf_dir, "late_drop", _PARTS, window=windows.WindowConfig(**_DAYS))
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.col("users").cast("long").alias("users"))


@query(f"SELECT event_id, event_type FROM events WHERE {_EARLY} AND {_HELD}")
def stream_late_dlq(spark, sf_dir):
    """The same late events as dead letters."""
    letters = dlq.DeadLetters(Snapshot(spark, shared.folder(spark, "letters")))
    _in_steps(spark, sf_dir, "late_dlq", _PARTS, window=windows.WindowConfig(**_DAYS, late_data="dlq"), letters=letters)
    rows = letters.table().filter("stage = 'late_data'").select(F.from_json(F.col("payload").cast("string"), "event_id long, event_type string").alias("r"))
    return rows.select("r.*")


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1, 2")
def stream_reopen(spark, sf_dir):
    """With enough allowed lateness the late events correct their windows."""
    table = Snapshot(spark, shared.folder(spark, "reopened"))
    config = windows.WindowConfig(**_DAYS, late_data="reopen", allowed_lateness_ms=60 * 86_400_000)
    _in_steps(spark, sf_dir, "reopen", _PARTS, [pipeline.upsert_target(table, ["event_type", "window_start"])], window=config)
    return table.read().select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.col("users").cast("long").alias("users"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, ts, value, i, ts AS s FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.ts, e.value, e.i, CASE WHEN e.ts - w.ts > INTERVAL '1 hour' OR e.ts - w.s >= INTERVAL '4 hours' THEN e.ts ELSE w.s END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1),
f AS (SELECT user_id, s AS window_start, max(ts) AS window_end, CAST(count(*) AS BIGINT) AS n, max(value) AS top FROM w GROUP BY user_id, s)
SELECT user_id, window_start, window_end, n, top FROM (SELECT *, lead(window_start) OVER (PARTITION BY user_id ORDER BY window_start) AS following FROM f)
WHERE following IS NOT NULL OR window_end + INTERVAL '1 hour' < (SELECT max(ts) FROM events)""")
def stream_session(spark, sf_dir):
    """Capped sessions over three batches in order of time; their ids are those of finished tables."""
    parts = ["ts < TIMESTAMP '2024-01-10 12:00:00'", "ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'", "ts >= TIMESTAMP '2024-01-20 00:00:00'"]
    config = dataclasses.replace(_SESSIONS, event_time_column="_event_ts")
    out = _in_steps(spark, sf_dir, "session", parts, window=config)
    whole = windows.windowed(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), _SESSIONS).select("session_id")
    out = out.join(whole, "session_id", "left_semi")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "n", "top")


@query("SELECT event_id, 'all' AS route FROM events UNION ALL SELECT event_id, 'clicks' FROM events WHERE event_type = 'click'")
def stream_fanout(spark, sf_dir):
    """Two targets get each of three batches."""
    path = shared.folder(spark, "routes")
    clicks = pipeline.parquet_target(f"{path}/clicks")
    targets = [pipeline.parquet_target(f"{path}/all"), lambda df, i: clicks(df.filter("event_type = 'click'"), i)]
    _in_steps(spark, sf_dir, "fanout", _PARTS, targets)
    routes = [spark.read.parquet(f"{path}/{r}").select("event_id", F.lit(r).alias("route")) for r in ("all", "clicks")]
    return routes[0].unionByName(routes[1])


@query(f"SELECT event_id, 'kept' AS route FROM events WHERE NOT ({_MIDDLE}) UNION ALL SELECT event_id, 'transform' FROM events WHERE {_MIDDLE}")
def stream_transform_dlq(spark, sf_dir):
    """The SQL of one batch of three fails, and its rows become dead letters."""
    letters = dlq.DeadLetters(Snapshot(spark, shared.folder(spark, "letters")))
    sql = f"SELECT event_id, CASE WHEN {_MIDDLE} THEN raise_error('no such days') ELSE 'kept' END AS route FROM source"
    good = _in_steps(spark, sf_dir, "transform_dlq", _PARTS, sql=sql, transform_on_error="dlq", letters=letters).select("event_id", "route")
    return good.unionByName(letters.table().select(F.get_json_object(F.col("payload").cast("string"), "$.event_id").cast("long").alias("event_id"), F.col("stage").alias("route")))


@query("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, CAST(count(*) AS BIGINT) AS n, arg_max(value, ts) AS last FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL '1 day', min(ts)) + INTERVAL '1 day' <= (SELECT max(ts) FROM events)""")
def stream_tumbling(spark, sf_dir):
    config = windows.WindowConfig("tumbling", ("event_type",), (windows.Aggregate("count", name="n"), windows.Aggregate("last", "value", "last")), duration_ms=86_400_000)
    return _finished(spark, "tumbling", _streamed(spark, sf_dir), window=config).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "last")


@query("""SELECT user_id, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS window_start, CAST(count(*) AS BIGINT) AS n FROM events, (SELECT unnest(range(2)) AS k) GROUP BY 1, 2
HAVING time_bucket(INTERVAL '6 hours', min(ts)) IS NOT NULL AND any_value(time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours') + INTERVAL '12 hours' <= (SELECT max(ts) FROM events)""")
def stream_hopping(spark, sf_dir):
    config = windows.WindowConfig("hopping", ("user_id",), (windows.Aggregate("count", name="n"),), duration_ms=43_200_000, hop_ms=21_600_000)
    return _finished(spark, "hopping", _streamed(spark, sf_dir), window=config).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL '1 hour' AND a.ts + INTERVAL '1 hour'")
def stream_join(spark, sf_dir):
    left, right = _streamed(spark, sf_dir).filter("event_type = 'click'"), _streamed(spark, sf_dir).filter("event_type = 'purchase'")
    config = events.JoinConfig((("user_id", "user_id"),), window_ms=3_600_000)
    return _finished(spark, "joined", left, join=(right, config)).select(F.col("left_event_id").alias("left_id"), F.col("right_event_id").alias("right_id"))


@query("SELECT event_id, event_type, CAST(length(event_type) AS INTEGER) AS weight FROM events")
def stream_lookup(spark, sf_dir):
    weights = read(spark, sf_dir, "events").select("event_type").distinct().withColumn("weight", F.length("event_type"))
    return _finished(spark, "lookup", events.lookup_join(_streamed(spark, sf_dir).select("event_id", "event_type"), weights, ["event_type"]))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_batch_sql(spark, sf_dir):
    return _finished(spark, "sql", _streamed(spark, sf_dir).select("event_type"), sql="SELECT event_type, count(*) AS n FROM source GROUP BY event_type")


# change data and dead letters

_CDC = cdc.CDC("debezium")


def _envelopes(spark, sf_dir) -> DataFrame:
    """Customers as a log: created, every third updated later, every fifth deleted last; the update again, late."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    c = c.repartition(spark.sparkContext.defaultParallelism)  # the file is small beside what is made of it, and one task would read it
    row = F.struct("id", "name", "balance")
    more = F.struct("id", "name", (F.col("balance") + 10).alias("balance"))
    def envelope(op: str, ts: int, before, after):
        return F.to_json(F.struct(F.lit(op).alias("op"), before.alias("before"), after.alias("after"), F.struct(F.lit(ts).alias("ts_ms")).alias("source")))

    none = F.lit(None).cast("struct<id: bigint>")
    log = F.array(envelope("c", 1000, none, row), F.when(F.col("id") % 3 == 0, envelope("u", 2000, row, more)), F.when(F.col("id") % 5 == 0, envelope("d", 3000, row, none)), F.when(F.col("id") % 3 == 0, envelope("u", 1500, row, row)), F.lit(""))
    return c.select(F.explode(log).alias("value")).filter("value IS NOT NULL")


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 5 <> 0")
def cdc_debezium(spark, sf_dir):
    change = cdc.changes(_envelopes(spark, sf_dir), _CDC, "id long, name string, balance double", ["id"])
    once = cdc.apply(cdc.empty_target(change, ["id"], _CDC), change, ["id"], _CDC)
    return cdc.live(cdc.apply(once, change.filter("_ts < 2500"), ["id"], _CDC))  # old changes come again and have no effect


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 5 = 0 THEN make_timestamp(3000000) END AS gone FROM customer")
def cdc_soft_delete(spark, sf_dir):
    soft = cdc.CDC("debezium", delete_mode="soft", soft_delete_column="gone")
    change = cdc.changes(_envelopes(spark, sf_dir), soft, "id long, balance double", ["id"])
    first = cdc.apply(cdc.empty_target(change, ["id"], soft), change.filter("_ts < 2500"), ["id"], soft)
    return cdc.live(cdc.apply(first, change, ["id"], soft)).withColumn("gone", F.col("gone").cast("timestamp_ntz"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 5 <> 0")
def cdc_maxwell(spark, sf_dir):
    """Inserts, updates and deletes of another envelope, a delete's row being in its data."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    row, more = F.struct("id", "name", "balance"), F.struct("id", "name", (F.col("balance") + 10).alias("balance"))

    def envelope(kind: str, ts: int, data):
        return F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(ts).alias("ts"), data.alias("data")))

    log = F.array(envelope("bootstrap-insert", 10, row), F.when(F.col("id") % 3 == 0, envelope("update", 20, more)), F.when(F.col("id") % 5 == 0, envelope("delete", 30, row)))
    maxwell = cdc.CDC("maxwell")
    change = cdc.changes(c.select(F.explode(log).alias("value")).filter("value IS NOT NULL"), maxwell, "id long, name string, balance double", ["id"])
    return cdc.live(cdc.apply(cdc.empty_target(change, ["id"], maxwell), change, ["id"], maxwell))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 5 <> 0")
def cdc_idempotent(spark, sf_dir):
    """A stream of four batches whose later two are the first two again, into a table."""
    path = shared.folder(spark, "log")
    _envelopes(spark, sf_dir).withColumn("k", F.pmod(F.xxhash64("value"), F.lit(2)).cast("int")).write.partitionBy("k").parquet(f"{path}/whole")
    log, table, run = spark.read.schema("value string, k int").parquet(f"{path}/whole"), Snapshot(spark, f"{path}-table"), None
    for k in (0, 1, 0, 1):  # in as many files as there are; the stream goes to its end after each step
        log.filter(F.col("k") == k).drop("k").write.mode("append").parquet(f"{path}/in")
        run = run or pipeline.StreamPipeline("idempotent", files.stream(spark, f"{path}/in", "value string"), [cdc.sink(table, _CDC, "id long, name string, balance double", ["id"])], f"{path}-checkpoint")
        run.run()
    return cdc.live(table.read())


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus, o_orderpriority")
def dashboard_filter(spark, sf_dir):
    """Filters around a guarded query: one on a column that it has, one on a column that it has not."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    text = analytics.guard_readonly("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority;")
    analytics.guard_plan(spark, text)
    return analytics.filtered(spark.sql(text), {"o_orderstatus": ["F", "O"], "no_such_column": [1]})


@query("SELECT event_id, 'kept' AS route FROM events WHERE value >= 20 UNION ALL SELECT event_id, 'late_data' FROM events WHERE value < 20")
def dlq_split(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "value")
    letters = dlq.DeadLetters(Snapshot(spark, shared.folder(spark, "dlq")))
    good = dlq.split(e, F.col("value") >= 20, "value too small", "p", letters, "late_data")
    bad = letters.table().select(F.get_json_object(F.col("payload").cast("string"), "$.event_id").cast("long").alias("event_id"), F.col("stage").alias("route"))
    return good.select("event_id", F.lit("kept").alias("route")).unionByName(bad)


# functions, quality, alerts


@udf(args=("double", "double"), returns="double", name="net_price")
def net_price(price, discount):
    import pyarrow.compute as pc

    return pc.multiply(price, pc.subtract(1.0, discount))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0E0 - l_discount) AS net FROM lineitem")
def udf_scalar(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", net_price("l_extendedprice", "l_discount").alias("net"))


@udaf(args=("double", "double"), returns="double", name="vwap")
class Vwap:
    """Average price by quantity, in whole hundredths so that parts add up exactly."""

    def __init__(self) -> None:
        self.total = self.weight = 0

    def update_batch(self, price, quantity) -> None:
        cents, n = (price * 100).round().astype("int64"), quantity.astype("int64")
        self.total += int((cents * n).sum())
        self.weight += int(n.sum())

    def merge_batch(self, states) -> None:
        for total, weight in states:
            self.total += total
            self.weight += weight

    def state(self) -> tuple:
        return self.total, self.weight

    def evaluate(self) -> float | None:
        return self.total / 100 / self.weight if self.weight else None


@query("SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS HUGEINT) * CAST(l_quantity AS HUGEINT)) AS DOUBLE) / 100 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS vwap FROM lineitem GROUP BY l_returnflag")
def udaf_vwap(spark, sf_dir):
    return Vwap(read(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice", "l_quantity"])


@query("SELECT 'not_null(c_custkey)' AS name, 'pass' AS verdict UNION ALL SELECT 'positive', CASE WHEN count(*) FILTER (WHERE c_acctbal <= 0) > 0 THEN 'fail' ELSE 'pass' END FROM customer UNION ALL SELECT 'unique(c_custkey)', 'pass'")
def quality_expectations(spark, sf_dir):
    spec = schema.any_spec(c_custkey="big_int!", c_name="text")
    out = quality.run_expectations(read(spark, sf_dir, "customer"), spec, {"positive": "c_acctbal > 0"})
    return spark.createDataFrame([(a.name, a.verdict) for a in out.assertions], "name string, verdict string")


@query("SELECT count(*) > 0 AS triggered, CAST(count(*) AS BIGINT) AS matched FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 20")
def alert_threshold(spark, sf_dir):
    chart = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    said = analytics.evaluate_alert(chart, "n", ">", 20)
    return spark.createDataFrame([(said["triggered"], said["matched"])], "triggered boolean, matched long")


@query("SELECT event_id, event_type FROM events WHERE event_id = 77")
def scan_point_lookup(spark, sf_dir):
    from quern.sources import files

    path = shared.folder(spark, "indexed")
    files.write_indexed(read(spark, sf_dir, "events"), path, "event_id", 4)
    return files.lookup(spark, path, "event_id", 77).select("event_id", "event_type")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_formats(spark, sf_dir):
    """The same rows through CSV, JSON lines and ORC, one after the other."""
    from quern.sources import files

    df, path = read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), shared.folder(spark, "formats")
    for kind in ("csv", "json_lines", "orc"):
        files.write(df, f"{path}/{kind}", kind)
        df = files.read(spark, f"{path}/{kind}", kind, df.schema)
    return df
