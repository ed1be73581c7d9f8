"""Change data: envelopes, the latest change of each key, and their idempotent application."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where envelopes keep their parts, and their operations' names.
ENVELOPES: dict[str, dict] = {
    "debezium": {"op": "op", "before": "before", "after": "after", "ts": "source.ts_ms", "ops": {"c": "create", "u": "update", "d": "delete", "r": "read"}},
    "maxwell": {"op": "type", "before": "old", "after": "data", "ts": "ts", "ops": {"insert": "create", "update": "update", "delete": "delete", "bootstrap-insert": "read"}},
}


@dataclass(frozen=True)
class CDC:
    envelope: str
    delete_mode: str = "hard"
    soft_delete_column: str | None = None
    schema_evolution: str = "skip"
    out_of_order_tolerance_ms: int = 5_000
    op_field: str | None = None
    before_field: str | None = None
    after_field: str | None = None
    key_field: str | None = None
    ts_field: str | None = None
    op_map: Mapping[str, str] | None = None

    def __post_init__(self) -> None:
        if self.envelope not in (*ENVELOPES, "custom"):
            raise ValueError("envelope must be debezium, maxwell or custom")
        if self.delete_mode not in ("hard", "soft"):
            raise ValueError("delete_mode must be hard or soft")
        if self.delete_mode == "soft" and not self.soft_delete_column:
            raise ValueError("delete_mode='soft' requires soft_delete_column")
        if self.schema_evolution not in ("skip", "fail"):
            raise ValueError("schema_evolution must be skip or fail")
        if self.envelope == "custom":
            missing = [n for n in ("op_field", "after_field", "key_field", "op_map") if not getattr(self, n)]
            if missing:
                raise ValueError(f"envelope='custom' requires {', '.join(missing)}")

    def part(self, name: str) -> str | None:
        return getattr(self, f"{name}_field") or ENVELOPES.get(self.envelope, {}).get(name)

    @property
    def ops(self) -> Mapping[str, str]:
        return self.op_map or ENVELOPES[self.envelope]["ops"]


def _path(column: Column, path: str) -> Column:
    return F.get_json_object(column, "$." + path)


def changes(messages: DataFrame, cdc: CDC, schema: str, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Typed changes of JSON envelopes: the row's columns, ``_op`` and ``_ts`` (milliseconds, may be null).

    Tombstones (null or empty payloads) and unknown operations are left out.  A delete has
    the row as it was before, or what the key field holds.  Fields that the schema lacks
    are skipped, or with ``schema_evolution="fail"`` raise at run time.
    """
    text = F.col(value).cast("string")
    path = lambda name: _path(text, cdc.part(name)) if cdc.part(name) else F.lit(None).cast("string")
    parts = F.struct(*[path(name).alias(f"_{name}") for name in ("op", "after", "before", "ts")])
    # made by a generator, parts are parsed once for each message, not where filters and cases name them
    found = messages.filter(text.isNotNull() & (text != "")).select(F.inline(F.array(parts)))
    op, after, before = F.lit(None).cast("string"), F.col("_after"), F.col("_before")
    for name, means in cdc.ops.items():
        op = F.when(F.col("_op") == name, means).otherwise(op)
    found = found.withColumn("_op", op)
    # a maxwell delete carries the row in data; its old part holds changed columns only
    body = F.when(F.col("_op") == "delete", F.coalesce(after, before) if cdc.envelope == "maxwell" else F.coalesce(before, after)).otherwise(after)
    out = found.select("_op", F.col("_ts").cast("long").alias("_ts"), body.alias("_body")).filter("_op IS NOT NULL AND _body IS NOT NULL")
    row = F.from_json("_body", schema)
    if cdc.schema_evolution == "fail":
        known = F.array(*[F.lit(f.name) for f in messages.sparkSession.createDataFrame([], schema).schema])
        extra = F.array_except(F.json_object_keys("_body"), known)
        row = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown columns: "), F.array_join(extra, ", ")))).otherwise(row)
    return out.withColumn("_row", row).select("_row.*", "_op", "_ts")


def latest(change: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last change of each key in a batch: by time, null times last of all."""
    w = Window.partitionBy(*keys).orderBy(F.col("_ts").desc_nulls_first(), F.when(F.col("_op") == "delete", 0).otherwise(1))
    return change.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def apply(target: DataFrame, change: DataFrame, keys: Sequence[str], cdc: CDC) -> DataFrame:
    """The target after a batch of changes.

    The target has the row's columns, ``_seen_ts`` (the time of the last change applied)
    and with soft deletes their column.  A change takes effect only if it is newer than
    that; one without a time always does.  Applying a batch again changes nothing.  Hard
    deletes keep a row with null values and ``_deleted`` true, so that older changes
    cannot bring the row back; ``live`` leaves these out.
    """
    values = [c for c in change.columns if c not in (*keys, "_op", "_ts")]
    extra = ["_seen_ts", "_deleted"] + ([cdc.soft_delete_column] if cdc.delete_mode == "soft" else [])
    new = latest(change, keys).alias("s")
    joined = target.withColumn("_t", F.lit(True)).alias("t").join(new, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full")
    effective = F.col("s._op").isNotNull() & (F.col("t._seen_ts").isNull() | F.col("s._ts").isNull() | (F.col("s._ts") > F.col("t._seen_ts")))
    deletes = effective & (F.col("s._op") == "delete")
    columns = [F.coalesce(F.col(f"t.{k}"), F.col(f"s.{k}")).alias(k) for k in keys]
    for c in values:
        gone = F.col(f"t.{c}") if cdc.delete_mode == "soft" else F.lit(None)
        columns.append(F.when(deletes, gone).when(effective, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    columns.append(F.when(effective, F.coalesce("s._ts", "t._seen_ts")).otherwise(F.col("t._seen_ts")).alias("_seen_ts"))
    hard = F.lit(cdc.delete_mode == "hard")
    columns.append(F.when(deletes, hard).when(effective, F.lit(False)).otherwise(F.coalesce("t._deleted", F.lit(False))).alias("_deleted"))
    if cdc.delete_mode == "soft":
        at = F.coalesce(F.timestamp_millis("s._ts"), F.current_timestamp())
        columns.append(F.when(deletes, at).when(effective, F.lit(None).cast("timestamp")).otherwise(F.col(f"t.{cdc.soft_delete_column}")).alias(cdc.soft_delete_column))
    out = joined.select(*columns)
    # a soft delete of a row that never was leaves no row
    return out.select(*keys, *values, *extra)


def empty_target(change: DataFrame, keys: Sequence[str], cdc: CDC) -> DataFrame:
    base = change.drop("_op", "_ts").limit(0).withColumns({"_seen_ts": F.lit(None).cast("long"), "_deleted": F.lit(False)})
    return base.withColumn(cdc.soft_delete_column, F.lit(None).cast("timestamp")) if cdc.delete_mode == "soft" else base


def live(target: DataFrame) -> DataFrame:
    return target.filter("NOT _deleted").drop("_seen_ts", "_deleted")


def sink(snapshot, cdc: CDC, schema: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies each micro-batch of envelopes to a snapshot table."""

    def run(batch: DataFrame, _: int) -> None:
        change = changes(batch, cdc, schema, keys)
        snapshot.update(lambda old: apply(empty_target(change, keys, cdc) if old is None else old, change, keys, cdc))

    return run
