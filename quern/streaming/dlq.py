"""Dead letters: records that a stage could not take, kept in a table with their life cycle."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.snapshot import Snapshot

STAGES = ("transform", "write", "late_data")
SCHEMA = "id string, pipeline string, stage string, error string, source_id string, offset_bytes binary, event_ts timestamp, failed_at timestamp, attempt int, payload_format string, payload binary, status string, leased_until timestamp"


def records(rows: DataFrame, pipeline: str, stage: str, error: str | Column, event_ts: str | None = None, now: datetime | None = None) -> DataFrame:
    """Rows as dead letters; the payload is the row as JSON, the id a hash of what it says."""
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    payload = F.to_json(F.struct(*rows.columns))
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    made = rows.select(
        F.sha2(F.concat_ws("\u0001", F.lit(pipeline), F.lit(stage), payload), 256).alias("id"), F.lit(pipeline).alias("pipeline"), F.lit(stage).alias("stage"),
        (F.lit(error) if isinstance(error, str) else error).alias("error"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("binary").alias("offset_bytes"),
        (F.col(event_ts).cast("timestamp") if event_ts else F.lit(None).cast("timestamp")).alias("event_ts"), moment.alias("failed_at"), F.lit(1).alias("attempt"),
        F.lit("json").alias("payload_format"), payload.cast("binary").alias("payload"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("leased_until"),
    )
    return made


#: Records that a task of ``DeadLetters.append`` sorts, about.
RECORDS_A_TASK = 100_000


class DeadLetters:
    """A table of dead letters in versioned snapshots: append, browse, take, ack, park, purge."""

    def __init__(self, snapshot: Snapshot) -> None:
        self.snapshot = snapshot

    def table(self) -> DataFrame:
        found = self.snapshot.read()
        return self.snapshot.spark.createDataFrame([], SCHEMA) if found is None else found

    def append(self, rows: DataFrame) -> None:
        """Add records; one that is there already (same id) counts another attempt.

        Records are dealt by id to as many tasks as their number asks for, so that what a task sorts does not grow with them.
        """
        old, rows = self.snapshot.read(), rows.select(*[f.name for f in T._parse_datatype_string(SCHEMA)])
        counted = rows.count() + (0 if old is None else old.count())
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted // RECORDS_A_TASK))
        dealt = lambda df: df.repartition(tasks, "id")
        new = dealt(rows).groupBy("id").agg(*[F.first(c).alias(c) for c in rows.columns if c != "id"]).select(*rows.columns)
        if old is not None:
            # by merging: a broadcast of ids goes through the driver
            old, ids = dealt(old).select(*rows.columns), dealt(rows.select("id")).groupBy("id").agg(F.lit(1).alias("_more"))
            again = old.join(ids.hint("merge"), "id", "left").withColumn("attempt", F.col("attempt") + F.coalesce("_more", F.lit(0))).select(*rows.columns)
            new = again.unionByName(new.join(old.select("id").hint("merge"), "id", "left_anti"))
        self.snapshot.write(new)

    def depth(self, pipeline: str | None = None) -> dict[str, int]:
        rows = self.table() if pipeline is None else self.table().filter(F.col("pipeline") == pipeline)
        return {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}

    def browse(self, n: int = 50, pipeline: str | None = None, status: str | None = None) -> DataFrame:
        rows = self.table()
        for column, value in (("pipeline", pipeline), ("status", status)):
            rows = rows if value is None else rows.filter(F.col(column) == value)
        return rows.orderBy("failed_at", "id").limit(n)

    def _change(self, chosen: Column, **to: Column) -> None:
        rows = self.table()
        self.snapshot.write(rows.withColumns({k: F.when(chosen, v).otherwise(F.col(k)) for k, v in to.items()}))

    def take(self, n: int, lease_seconds: int = 300, now: datetime | None = None) -> list[str]:
        """Lease the oldest ``n`` records that are pending or whose lease has run out; their ids."""
        moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        free = (F.col("status") == "pending") | ((F.col("status") == "leased") & (F.col("leased_until") <= moment))
        ids = [r["id"] for r in self.table().filter(free).orderBy("failed_at", "id").limit(n).select("id").collect()]  # n is the caller's bound
        if ids:
            self._change(F.col("id").isin(ids), status=F.lit("leased"), leased_until=moment + F.make_dt_interval(secs=F.lit(float(lease_seconds))))
        return ids

    def ack(self, ids: Sequence[str]) -> None:
        self.snapshot.write(self.table().filter(~F.col("id").isin(list(ids))))

    def release(self, ids: Sequence[str]) -> None:
        self._change(F.col("id").isin(list(ids)), status=F.lit("pending"), leased_until=F.lit(None).cast("timestamp"))

    def park(self, ids: Sequence[str]) -> None:
        self._change(F.col("id").isin(list(ids)), status=F.lit("parked"), leased_until=F.lit(None).cast("timestamp"))

    def purge(self, pipeline: str | None = None, ids: Sequence[str] | None = None) -> None:
        keep = F.lit(False)
        if pipeline is not None:
            keep = keep | (F.col("pipeline") != pipeline)
        if ids is not None:
            keep = keep | ~F.col("id").isin(list(ids))
        self.snapshot.write(self.table().filter(keep))

    def replay(self, ids: Sequence[str], schema: str) -> DataFrame:
        """The rows that records were made of."""
        rows = self.table().filter(F.col("id").isin(list(ids)))
        return rows.select(F.from_json(F.col("payload").cast("string"), schema).alias("r")).select("r.*")


def split(batch: DataFrame, good: Column, error: str, pipeline: str, letters: DeadLetters | None, stage: str = "transform", event_ts: str | None = None) -> DataFrame:
    """Rows that a condition holds for; the others become dead letters."""
    if letters is not None:
        bad = batch.filter(~F.coalesce(good, F.lit(False)))
        if bad.limit(1).count():
            letters.append(records(bad, pipeline, stage, error, event_ts))
    return batch.filter(good)


def guarded(transform: Callable[[DataFrame], DataFrame], on_error: str, pipeline: str, letters: DeadLetters | None = None) -> Callable[[DataFrame], DataFrame]:
    """A batch transform whose failure is raised, or drops or dead-letters the batch; its result is cached until it is unpersisted."""
    if on_error not in ("fail", "drop", "dlq"):
        raise ValueError("on_error must be fail, drop or dlq")

    def run(batch: DataFrame) -> DataFrame:
        out = None
        try:
            out = transform(batch).persist()
            out.count()
            return out
        except Exception as e:
            if out is not None:
                out.unpersist()
            if on_error == "fail":
                raise
            if on_error == "dlq":
                letters.append(records(batch, pipeline, "transform", str(e)[:500]))
            return transform(batch.limit(0)) if on_error == "drop" else batch.limit(0)

    return run


class TopicLetters:
    """Dead letters as messages of a broker's topic, one JSON document each; ``replay`` reads them back."""

    def __init__(self, format: str, **options: str) -> None:
        self.format, self.options = format, options

    def append(self, rows: DataFrame) -> None:
        text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c == "payload" else F.col(c) for c in rows.columns if c != "offset_bytes"]))
        rows.select(text.cast("binary").alias("value")).write.format(self.format).options(**self.options).mode("append").save()

    def messages(self, source: DataFrame) -> DataFrame:
        """Dead letters in the messages (``value``) of the topic, read as a table or as a stream."""
        kinds = ", ".join(f"{f.name} {'string' if f.name == 'payload' else f.dataType.simpleString()}" for f in T._parse_datatype_string(SCHEMA) if f.name != "offset_bytes")
        return source.select(F.from_json(F.col("value").cast("string"), kinds).alias("r")).select("r.*")

    def replay(self, source: DataFrame, schema: str, pipeline: str | None = None, stage: str | None = None) -> DataFrame:
        """The rows that the topic's dead letters were made of."""
        found = self.messages(source)
        for column, value in (("pipeline", pipeline), ("stage", stage)):
            found = found if value is None else found.filter(F.col(column) == value)
        return found.select(F.from_json("payload", schema).alias("r")).select("r.*")


def new_id() -> str:
    return str(uuid.uuid4())
