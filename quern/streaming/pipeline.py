"""Streaming pipelines: SQL on each batch, several targets, delivery checks, restarts, metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quern.operators.windows import WindowConfig
from quern.sources.snapshot import Snapshot
from quern.streaming.dlq import DeadLetters, guarded, records
from quern.streaming.events import JoinConfig, check_caps, stream_join, windowed_stream

Target = Callable[[DataFrame, int], None]


@dataclass
class StreamPipeline:
    """Source -> SQL (on the view ``source``, batch by batch) -> window or join -> targets.

    Spark runs each stream in a session of its own, so views of the same name in pipelines
    that run at once are not the same view.  A batch whose SQL fails is raised, dropped or
    made dead letters (``transform_on_error``).  With ``late_data="dlq"`` of the window a
    second query follows the source and makes rows dead letters whose windows the watermark
    has passed.
    """

    name: str
    source: DataFrame
    targets: Sequence[Target]
    checkpoint: str
    sql: str | None = None
    window: WindowConfig | None = None
    join: tuple[DataFrame, JoinConfig] | None = None
    output_mode: str | None = None
    trigger: dict = field(default_factory=lambda: {"availableNow": True})
    transform_on_error: str = "fail"
    letters: DeadLetters | None = None

    def __post_init__(self) -> None:
        if self.window and self.join:
            raise ValueError(f"{self.name}: a pipeline has a window or a join, not both")
        if not self.targets:
            raise ValueError(f"{self.name}: a pipeline needs a target")
        if self.transform_on_error not in ("fail", "drop", "dlq"):
            raise ValueError("transform_on_error must be fail, drop or dlq")
        if self.letters is None and (self.transform_on_error == "dlq" or self._late_letters):
            raise ValueError(f"{self.name}: dead letters need a table")

    @property
    def _late_letters(self) -> bool:
        return self.window is not None and self.window.late_data == "dlq"

    def stream(self) -> DataFrame:
        if self.join:
            return stream_join(self.source, *self.join)
        return windowed_stream(self.source, self.window) if self.window else self.source

    def start(self) -> StreamingQuery:
        """All targets get a batch before its offsets are committed; a repeated batch has the same id."""

        def transformed(batch: DataFrame) -> DataFrame:
            batch.createOrReplaceTempView("source")
            return batch.sparkSession.sql(self.sql)

        def run(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            out = batch
            try:
                if self.window:
                    check_caps(batch, self.window)
                if self.sql:
                    out = guarded(transformed, self.transform_on_error, self.name, self.letters)(batch)
                for target in self.targets:
                    target(out, batch_id)
            finally:
                out.unpersist()
                batch.unpersist()

        mode = self.output_mode or ("update" if self.window and self.window.late_data == "reopen" else "append")
        # with one stateful operator rows are late by the newest watermark; Spark would take that of the batch before for chains of them
        chained, spark = "spark.sql.streaming.statefulOperator.allowMultiple", self.source.sparkSession
        before = spark.conf.get(chained)
        spark.conf.set(chained, "true" if self.window is None else "false")
        try:
            return self._writer(run, mode).start()
        finally:
            spark.conf.set(chained, before)

    def _writer(self, run: Callable[[DataFrame, int], None], mode: str):
        return self.stream().writeStream.queryName(self.name).outputMode(mode).option("checkpointLocation", self.checkpoint).trigger(**self.trigger).foreachBatch(run)

    def start_late(self) -> StreamingQuery | None:
        """The query that makes late rows dead letters, if the window asks for it.

        It reads the source's batches as the main query does.  A batch's watermark is what
        the batches before it said, kept in a table beside the checkpoint with the batch's
        id, so a batch that is repeated is judged by the same one.
        """
        if not self._late_letters:
            return None
        config, held = self.window, Snapshot(self.source.sparkSession, f"{self.checkpoint}-late/watermark")
        ts = config.event_time_column

        def run(batch: DataFrame, batch_id: int) -> None:
            known = held.read()
            old = known.first() if known is not None else None
            before = None if old is None else old["before"] if old["batch"] >= batch_id else old["after"]
            batch = batch.persist()
            try:
                if before is not None:
                    late = batch.filter(F.unix_millis(_last_end(config)) <= before)
                    if late.limit(1).count():
                        self.letters.append(records(late, self.name, "late_data", "the watermark has passed its windows", ts))
                top = batch.agg(F.max(F.unix_millis(F.col(ts).cast("timestamp")))).first()[0]
                after = max((x for x in (before, None if top is None else top - config.lateness_ms) if x is not None), default=None)
                held.write(held.spark.createDataFrame([(batch_id, before, after)], "batch long, before long, after long"))
            finally:
                batch.unpersist()

        return self.source.writeStream.queryName(f"{self.name}_late").option("checkpointLocation", f"{self.checkpoint}-late/checkpoint").trigger(**self.trigger).foreachBatch(run).start()

    def run(self) -> None:
        """Start all queries of the pipeline and wait for their ends."""
        for query in [q for q in (self.start(), self.start_late()) if q is not None]:
            query.awaitTermination()


def _last_end(config: WindowConfig) -> Column:
    """When the last window that a row is in ends; of a session, when it ends if nothing follows."""
    ts = F.col(config.event_time_column).cast("timestamp")
    if config.kind == "session":
        return ts + F.expr("INTERVAL 1 MICROSECOND")
    step = config.hop_ms if config.kind == "hopping" else config.duration_ms
    return F.window(ts, f"{step} milliseconds")["start"] + F.expr(f"INTERVAL {config.duration_ms / 1000:.3f} SECONDS")


def rewind(spark, checkpoint: str, batch_id: int, confirm: bool = False) -> list[int]:
    """Make a stopped query read again from the batch after ``batch_id`` (-1: from the start); the batches forgotten.

    A checkpoint with state needs ``confirm``: what its targets got from the batches comes
    again, and its state goes back to that batch.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(checkpoint).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(f"{checkpoint}/state")) and not confirm:
        raise ValueError("the query has state; rewinding it needs confirm=True")
    forgotten = set()
    for part in ("commits", "offsets"):  # commits first: an offset without its commit is a batch to run again
        if not fs.exists(path(f"{checkpoint}/{part}")):
            continue
        for name in [s.getPath().getName() for s in fs.listStatus(path(f"{checkpoint}/{part}"))]:
            if name.isdigit() and int(name) > batch_id:
                fs.delete(path(f"{checkpoint}/{part}/{name}"), False)
                forgotten.add(int(name))
    if batch_id < 0:
        for part in ("state", "sources"):
            fs.delete(path(f"{checkpoint}/{part}"), True)
    return sorted(forgotten)


def parquet_target(path: str) -> Target:
    """Idempotent: a batch's folder is named by its id and replaced if the batch comes again."""
    return lambda df, batch_id: df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def upsert_target(snapshot, keys: Sequence[str]) -> Target:
    """Rows replace those with equal keys, as corrected windows do."""

    def run(df: DataFrame, _: int) -> None:
        snapshot.update(lambda old: df if old is None else old.join(df.select(*keys), list(keys), "left_anti").unionByName(df))

    return run


def ledger_target(read: Callable[[], int | None], write: Callable[[DataFrame, int], None]) -> Target:
    """For a store that keeps the last batch id with its rows: batches it has are skipped."""

    def run(df: DataFrame, batch_id: int) -> None:
        last = read()
        if last is None or batch_id > last:
            write(df, batch_id)

    return run


#: Sinks that take a batch and its offsets together or replace by batch id.
EXACT_SINKS = frozenset({"parquet", "delta", "postgres", "mysql", "sqlite", "snapshot"})
REPLAYABLE = frozenset({"kafka", "kinesis", "files", "delta"})


def delivery(source: str, sinks: Sequence[str], wanted: str = "auto", transform_on_error: str = "fail") -> str:
    """exactly_once or at_least_once; asking for more than can be had raises with all reasons."""
    reasons = [f"source {source} cannot be read again"] if source not in REPLAYABLE else []
    reasons += [f"sink {s} does not commit a batch once" for s in sinks if s not in EXACT_SINKS]
    if transform_on_error == "drop":
        reasons.append("failed batches are dropped")
    if wanted == "exactly_once" and reasons:
        raise ValueError("exactly once is not possible: " + "; ".join(reasons))
    return "at_least_once" if wanted == "at_least_once" or reasons else "exactly_once"


def supervised(start: Callable[[], StreamingQuery], attempts: int = 5, first_wait: float = 1.0, most_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query to its end; restart it after failures, waiting twice as long each time.  How often it was restarted."""
    wait = first_wait
    for attempt in range(attempts + 1):
        try:
            start().awaitTermination()
            return attempt
        except Exception:
            if attempt == attempts:
                raise
            sleep(wait)
            wait = min(2 * wait, most_wait)
    return attempts


class Metrics(StreamingQueryListener):
    """Numbers of each query's last batches: rows in, rows dropped as late, batch and watermark."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.rows[p.name] = self.rows.get(p.name, 0) + p.numInputRows
        self.last[p.name] = {"batch": p.batchId, "rows": p.numInputRows, "late": late, "watermark": p.eventTime.get("watermark")}

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def prometheus(self) -> str:
        return "".join(f'stream_rows_total{{query="{k}"}} {v}\n' for k, v in sorted(self.rows.items()))


class Migrations:
    """Forward-only steps between versions of a state's content."""

    def __init__(self) -> None:
        self.steps: dict[int, Callable] = {}

    def add(self, version: int, step: Callable) -> Migrations:
        if version in self.steps:
            raise ValueError(f"version {version} has a step already")
        self.steps[version] = step
        return self

    def run(self, state: object, version: int, target: int) -> object:
        if version > target:
            raise ValueError(f"state of version {version} is newer than {target}")
        for v in range(version, target):
            if v not in self.steps:
                raise ValueError(f"no step from version {v}")
            state = self.steps[v](state)
        return state


def late_rows(batch: DataFrame, ts: str, watermark_ms: int) -> tuple[DataFrame, DataFrame]:
    """Rows at or after a watermark, and those before it."""
    early = F.unix_millis(F.col(ts).cast("timestamp")) < watermark_ms
    return batch.filter(~F.coalesce(early, F.lit(False))), batch.filter(early)
