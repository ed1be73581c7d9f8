"""Load strategies as functions from tables to the target's next snapshot.

Spark's file tables have no row updates, so a strategy returns the whole new content;
``quern.sources.snapshot`` writes it beside the old one and then moves a pointer.
Joins are on declared keys, one shuffle a side; unchanged rows flow through.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dialect import row_hash


@dataclass(frozen=True)
class Merged:
    """A new snapshot, and how many rows were inserted, updated and are there."""

    table: DataFrame
    changes: DataFrame

    def counts(self) -> dict[str, int]:
        r = self.changes.agg(F.count_if(F.col("_change") == "insert").alias("inserted"), F.count_if(F.col("_change") == "update").alias("updated"), F.count_if(F.col("_change") == "delete").alias("deleted")).first()
        return r.asDict()


class DuplicateKeys(ValueError):
    pass


class OutOfOrder(ValueError):
    pass


def unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise ``DuplicateKeys`` if two rows have equal keys; looks at the keys alone."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKeys(f"source has several rows for {({k: twice[0][k] for k in keys})}")
    return df


def _now(now: datetime | Column | None) -> Column:
    return F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def append(target: DataFrame | None, source: DataFrame, now: datetime | None = None, batch_id: str | None = None) -> DataFrame:
    """All rows of the target and of the source, these marked with ``_loaded_at`` and ``_batch_id``."""
    new = source.withColumns({"_loaded_at": _now(now), "_batch_id": F.lit(batch_id or str(uuid.uuid4()))})
    return new if target is None else target.unionByName(new, allowMissingColumns=True)


def truncate(target: DataFrame | None, source: DataFrame) -> DataFrame:
    """The source instead of the target."""
    return source if target is None else source.select(*target.columns)


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], delete_missing: bool = False) -> Merged:
    """Insert new keys, update rows that differ in any other column (null-safe), keep the rest.

    Two source rows of one key raise ``DuplicateKeys``; keys alone are looked at for that.
    With ``delete_missing`` rows whose keys the source lacks go, unless a source key is
    null: then, as with NOT IN, nothing is known to be missing and nothing goes.
    """
    unique_keys(source.dropna(subset=list(keys)), keys)  # a null key matches nothing, so it repeats none
    values = [c for c in target.columns if c not in keys]
    t = target.select(*target.columns, F.lit(True).alias("_t")).alias("t")
    s = source.select(*target.columns, F.lit(True).alias("_s")).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    change = F.when(F.col("t._t").isNull(), "insert").when(F.col("s._s").isNull(), "delete" if delete_missing else "keep").when(differs, "update").otherwise("keep")
    joined = t.join(s, on, "full")
    if delete_missing:
        null_key = source.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).limit(1).count() > 0
        if null_key:
            change = F.when(F.col("s._s").isNull(), "keep").otherwise(change)
    joined = joined.withColumn("_change", change)
    take = F.col("_change").isin("insert", "update")
    out = joined.select(*[F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns], "_change")
    return Merged(out.filter("_change <> 'delete'").drop("_change"), out.filter("_change <> 'keep'"))


scd1 = merge


def scd2(target: DataFrame | None, source: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None, now: datetime | None = None, event_time: str | None = None, check_order: bool = True) -> DataFrame:
    """History of rows: a changed key's current version is closed and a new one opened.

    Versions differ if the hash of their ``compare`` columns (all but keys and event
    time) does.  Without ``event_time`` changes count from ``now`` and the source may
    have one row for each key.  With it the latest row of each key is taken, valid from
    its own time; a row older than the current version raises ``OutOfOrder``.
    """
    columns = [c for c in source.columns if c != event_time]
    compare = list(compare or [c for c in columns if c not in keys])
    moment = F.col(event_time).cast("timestamp") if event_time else _now(now)
    new = source.withColumn("row_hash", row_hash(compare)).withColumn("valid_from", moment)
    if event_time:
        w = Window.partitionBy(*keys).orderBy(F.desc(event_time), F.desc("row_hash"))
        new = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    else:
        unique_keys(source, keys)
    new = new.select(*columns, "valid_from", F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"), "row_hash")
    if target is None:
        return new
    current = target.filter("is_current")
    on = list(keys)
    changed = new.join(current.select(*on, F.col("row_hash").alias("_hash"), F.col("valid_from").alias("_from")), on, "left").filter(~F.col("row_hash").eqNullSafe(F.col("_hash")))
    if event_time and check_order:
        late = changed.filter("_from > valid_from").limit(1).collect()
        if late:
            raise OutOfOrder(f"{({k: late[0][k] for k in keys})}: {late[0]['valid_from']} is before the current version of {late[0]['_from']}")
    opened = changed.select(*new.columns)
    closing = opened.select(*on, F.col("valid_from").alias("_closed"))
    kept = target.join(closing, on, "left")
    closes = F.col("is_current") & F.col("_closed").isNotNull()
    kept = kept.withColumns({"valid_to": F.when(closes, F.col("_closed")).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & F.col("_closed").isNull()})
    return kept.select(*new.columns).unionByName(opened)


def scd2_close_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], now: datetime | None = None) -> DataFrame:
    """Close current versions whose keys the source lacks; a null source key closes nothing."""
    if source.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).limit(1).count():
        return target
    there = source.select(*keys).distinct().withColumn("_there", F.lit(True))
    gone = F.col("is_current") & F.col("_there").isNull()
    joined = target.join(there, list(keys), "left")
    return joined.withColumns({"valid_to": F.when(gone, _now(now)).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & F.col("_there").isNotNull()}).select(*target.columns)


def scd2_expire(target: DataFrame, ttl_seconds: float, now: datetime | None = None) -> DataFrame:
    """Close current versions that are older than a time to live."""
    old = F.col("is_current") & (F.col("valid_from") < _now(now) - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))
    return target.withColumns({"valid_to": F.when(old, _now(now)).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~old})


def since(source: DataFrame, column: str, last: object | None) -> DataFrame:
    """Rows strictly after a watermark; all on the first run."""
    return source if last is None else source.filter(F.col(column) > F.lit(last))


def advance(source: DataFrame, column: str, last: object | None) -> object | None:
    """The watermark after a read: the largest value, the old one if nothing was read."""
    top = source.agg(F.max(column)).first()[0]
    return last if top is None else top


def hard_delete(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the source has; with a null among the source's keys all rows stay."""
    if source.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).limit(1).count():
        return target
    return target.join(source.select(*keys).distinct(), list(keys), "left_semi")
