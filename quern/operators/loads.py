"""Loads as whole runs: a strategy into a target, transforms after it, watermarks, online tables, DataFrame writes."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.normalize import normalize
from quern.operators import schema, strategies
from quern.sources import files
from quern.sources.snapshot import Snapshot

MODES = ("append", "truncate", "merge", "scd1", "scd2")


# transforms after a load


@dataclass(frozen=True)
class Step:
    """How one transform ended; ``metrics`` is what a function returned."""

    name: str
    status: str
    error: str | None = None
    metrics: Mapping[str, Any] | None = None


class TransformFailed(RuntimeError):
    def __init__(self, steps: Sequence[Step]) -> None:
        super().__init__(f"{steps[-1].name}: {steps[-1].error}")
        self.steps = list(steps)


@dataclass(frozen=True)
class Transform:
    """A named function of the session, and if it takes a second argument, of the load before it (None when run alone)."""

    name: str
    function: Callable

    def __call__(self, spark: SparkSession, parent: Mapping[str, Any] | None = None) -> Mapping[str, Any] | None:
        return self.function(spark, parent) if len(inspect.signature(self.function).parameters) > 1 else self.function(spark)


TRANSFORMS: dict[str, Transform] = {}


def transform(name: str | None = None) -> Callable[[Callable], Transform]:
    """Make a function a ``Transform``, known by its name."""

    def make(fn: Callable) -> Transform:
        made = Transform(name or fn.__name__, fn)
        TRANSFORMS[made.name] = made
        return made

    return make


def run_transforms(spark: SparkSession, steps: Sequence[str | Callable], parent: Mapping[str, Any] | None = None, continue_on_failure: bool = False) -> list[Step]:
    """Run SQL statements and functions one after the other, each by itself.

    The first failure raises ``TransformFailed`` with the steps so far; with
    ``continue_on_failure`` all run, and failures are told by their status.  What was done
    before a failure stays.
    """
    done: list[Step] = []
    for i, step in enumerate(steps):
        name = f"sql_{i}" if isinstance(step, str) else getattr(step, "name", None) or getattr(step, "__name__", f"step_{i}")
        try:
            if isinstance(step, str):
                said = spark.sql(step).collect() and None  # statements give no rows that anyone reads
            else:
                said = step(spark, parent) if isinstance(step, Transform) else Transform(name, step)(spark, parent)
            done.append(Step(name, "success", None, dict(said) if isinstance(said, Mapping) else None))
        except Exception as e:
            done.append(Step(name, "failed", str(e).split("\n")[0][:500]))
            if not continue_on_failure:
                raise TransformFailed(done) from e
    return done


# one load


@dataclass(frozen=True)
class Run:
    """A load that has ended: the target's new version, the rows it has, and the transforms' steps."""

    name: str
    mode: str
    version: str
    rows: int
    steps: list[Step] = field(default_factory=list)


def sync(
    name: str,
    target: Snapshot,
    source: DataFrame,
    mode: str = "append",
    keys: Sequence[str] = (),
    compare: Sequence[str] | None = None,
    event_time: str | None = None,
    delete_missing: bool = False,
    now: datetime | None = None,
    transforms: Sequence[str | Callable] = (),
    continue_on_failure: bool = False,
    online: Snapshot | None = None,
) -> Run:
    """Bring a source into a target by a strategy, then run the transforms.

    ``online`` is a second table that gets the current versions after each load of a
    history (``scd2``), or all rows of any other target.  The load stays if a transform fails.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode not in ("append", "truncate") and not keys:
        raise ValueError(f"{mode} needs keys")
    old = target.read()
    if mode == "append":
        new = strategies.append(old, source, now)
    elif mode == "truncate":
        new = strategies.truncate(old, source)
    elif mode == "scd2":
        new = strategies.scd2(old, source, keys, compare, now, event_time)
        if delete_missing and old is not None:
            new = strategies.scd2_close_missing(new, source, keys, now)
    else:
        new = strategies.merge(old if old is not None else source.limit(0), source, keys, delete_missing).table
    version = target.write(new)
    if online is not None:
        online.write(current(target.read()))
    rows = target.read().count()
    parent = {"name": name, "mode": mode, "version": version, "rows": rows}
    return Run(name, mode, version, rows, run_transforms(target.spark, transforms, parent, continue_on_failure))


def current(table: DataFrame) -> DataFrame:
    """Current versions of a history without its own columns; of another table all rows."""
    if "is_current" not in table.columns:
        return table
    return table.filter("is_current").drop("valid_from", "valid_to", "is_current", "row_hash")


def online_features(online: Snapshot | None, **keys: Any) -> dict | None:
    """The current row of one entity from an online table; None if there is none."""
    if online is None:
        raise ValueError("the table has no online copy; load it with online=")
    found = online.read()
    for k, v in keys.items():
        found = found.filter(F.col(k) == F.lit(v))
    row = found.limit(1).collect()
    return row[0].asDict() if row else None


# from one store to another


class Watermarks:
    """The largest value that each pipeline has loaded, as text, in a snapshot table."""

    def __init__(self, snapshot: Snapshot) -> None:
        self.snapshot = snapshot

    def get(self, pipeline: str) -> str | None:
        rows = self.snapshot.read()
        found = rows.filter(F.col("pipeline") == pipeline).collect() if rows is not None else []
        return found[0]["value"] if found else None

    def set(self, pipeline: str, value: str) -> None:
        row = self.snapshot.spark.createDataFrame([(pipeline, value)], "pipeline string, value string")
        self.snapshot.update(lambda old: row if old is None else old.filter(F.col("pipeline") != pipeline).unionByName(row))


def watermarked(sql: str, column: str, last: str | None) -> str:
    """A query as a subquery with the rows after a watermark; the whole query if there is none."""
    inner = sql.strip().rstrip(";").rstrip()
    if last is None:
        return inner
    quoted = last.replace("'", "''")
    return f"SELECT * FROM ({inner}) AS src WHERE \"{column}\" > '{quoted}'"


def warehouse_sync(
    pipeline: str,
    read: Callable[[str], DataFrame],
    sql: str,
    write: Callable[[DataFrame], None],
    transform_sql: str | None = None,
    incremental_column: str | None = None,
    store: Watermarks | None = None,
) -> int:
    """Read a query of one store, run SQL over it as ``source``, write it to another; how many rows were read.

    With ``incremental_column`` only rows after the stored watermark are read, and the
    watermark moves to the largest value read once the write has succeeded; an empty read
    leaves it.  The rows read are kept in a cache while they are used, so that what is
    written and what the watermark says agree.
    """
    if (incremental_column is None) != (store is None):
        raise ValueError("incremental_column and store go together")
    found = read(watermarked(sql, incremental_column, store.get(pipeline)) if store else watermarked(sql, "", None)).persist()
    try:
        if incremental_column is not None and incremental_column not in found.columns:
            raise ValueError(f"{incremental_column!r} is not among the columns of the source: {found.columns}")
        top = F.max(incremental_column).cast("string") if incremental_column else F.lit(None)
        rows, last = found.agg(F.count(F.lit(1)), top).first()
        out = found if transform_sql is None else files.in_memory(found.sparkSession, found, transform_sql)
        write(out)
        if store is not None and last is not None:
            store.set(pipeline, last)
        return rows
    finally:
        found.unpersist()


# DataFrames in and out


def _as_spark(spark: SparkSession, df: Any) -> DataFrame:
    if isinstance(df, DataFrame):
        return df
    kind = type(df).__module__.split(".")[0]
    if kind == "pandas":
        return spark.createDataFrame(df)
    if kind == "polars":
        return spark.createDataFrame(df.to_arrow())
    raise TypeError(f"expected a Spark, pandas or polars DataFrame, not {type(df).__name__}")


def write_df(df: Any, target: Snapshot, table: schema.ManagedTable | None = None, mode: str = "append", **more: Any) -> Run:
    """Write a DataFrame by a strategy.

    With a declared ``table`` its normalizers run, missing columns raise, columns are cast and
    ordered as declared, others are left out, and its keys are those of the strategy.
    Without one the target is made with the frame's own columns, and no metadata columns.
    """
    made = _as_spark(target.spark, df)
    if table is not None:
        made = schema.conform(normalize(schema.complete(made, table.spec), table.normalizers), table.spec)
        return sync(f"write_df:{table.spec.schema}.{table.spec.name}", target, made, mode, more.pop("keys", table.spec.keys), **more)
    if mode == "append":
        old = target.read()
        version = target.write(made if old is None else old.unionByName(made))
        return Run("write_df", mode, version, target.read().count())
    return sync("write_df", target, made, mode, **more)


def read_df(spark: SparkSession, sql: str, prefer: str = "auto") -> Any:
    """The rows of a query as a polars or pandas DataFrame on the driver; polars if it is there and nothing else is asked."""
    if prefer not in ("auto", "polars", "pandas"):
        raise ValueError(f"prefer must be auto, polars or pandas, not {prefer!r}")
    try:
        import polars
    except ImportError:
        polars = None
        if prefer == "polars":
            raise
    table = spark.sql(sql).toArrow()
    return polars.from_arrow(table) if polars is not None and prefer != "pandas" else table.to_pandas()


def read_spark_df(spark: SparkSession, connection, sql: str) -> DataFrame:
    """A query of a connection as a Spark DataFrame."""
    if not isinstance(spark, SparkSession):
        raise TypeError(f"expected a SparkSession, not {type(spark).__name__}")
    return connection.read(spark, sql)


def jdbc_statements(table: str, staging: str, columns: Sequence[str], mode: str, keys: Sequence[str] = ()) -> list[str]:
    """What brings staged rows into a table of a database, to be run in one transaction."""
    if mode not in ("append", "truncate", "merge", "scd1"):
        raise ValueError(f"a database takes append, truncate or merge, not {mode!r}")
    if mode in ("merge", "scd1") and not keys:
        raise ValueError("merge needs keys")
    names = ", ".join(f'"{c}"' for c in columns)
    insert = f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}"
    if mode == "append":
        return [insert]
    if mode == "truncate":
        return [f"DELETE FROM {table}", insert]
    # plain statements that every database has, in place of its own form of MERGE
    same = " AND ".join(f's."{k}" = {table}."{k}"' for k in keys)
    there = f"EXISTS (SELECT 1 FROM {staging} s WHERE {same})"
    values = ", ".join(f'"{c}" = (SELECT s."{c}" FROM {staging} s WHERE {same})' for c in columns if c not in keys)
    back = " AND ".join(f't."{k}" = {staging}."{k}"' for k in keys)
    missing = f"{insert} WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {back})"
    return ([f"UPDATE {table} SET {values} WHERE {there}"] if values else []) + [missing]


def write_spark_df(df: DataFrame, connection, table: str, mode: str = "append", keys: Sequence[str] = ()) -> None:
    """Stage a DataFrame in a database over JDBC, then bring it into a table in one transaction.

    Two staged rows of one key raise before anything is changed; the staging table goes in any case.
    A database in the driver's own process gets the rows from the driver.
    """
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a Spark DataFrame, not {type(df).__name__}")
    import uuid

    staging = f"quern_stage_{uuid.uuid4().hex[:12]}"
    statements = jdbc_statements(table, f'"{staging}"', df.columns, mode, keys)
    if keys:
        strategies.unique_keys(df, keys)
    login = {k: str(v) for k, v in connection.options.items() if k in ("user", "password", "driver")}
    db = files.connect(df.sparkSession, connection.jdbc_url, login)
    try:
        files.stage(df, connection.jdbc_url, f'"{staging}"', login)
        db.setAutoCommit(False)
        try:
            run = db.createStatement()
            for statement in statements:
                run.executeUpdate(statement)
            db.commit()
        except Exception:
            db.rollback()
            raise
        finally:
            db.setAutoCommit(True)
            db.createStatement().executeUpdate(f'DROP TABLE "{staging}"')
    finally:
        db.close()
