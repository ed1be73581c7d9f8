"""Windows and joins of streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.windows import WindowConfig, session_id, warn_of_state, whole_numbers


def with_event_time(df: DataFrame, column: str | None, lateness_ms: int, name: str = "_event_ts") -> DataFrame:
    """Event time from a column, or the time of arrival, with its watermark."""
    ts = F.col(column).cast("timestamp") if column else F.current_timestamp()
    return df.withColumn(name, ts).withWatermark(name, f"{lateness_ms} milliseconds")


def union_sources(sources: Sequence[DataFrame], column: str, lateness_ms: int, name: str = "_event_ts") -> DataFrame:
    """Several sources under one watermark, so that an idle one cannot hold the others back."""
    out = sources[0].withColumn("_source_id", F.lit(0))
    for i, df in enumerate(sources[1:], 1):
        out = out.unionByName(df.withColumn("_source_id", F.lit(i)), allowMissingColumns=True)
    return with_event_time(out, column, lateness_ms, name)


def windowed_stream(df: DataFrame, config: WindowConfig) -> DataFrame:
    """Windows of a stream; start it in append mode (drop, dlq) or update mode (reopen).

    With ``reopen`` the watermark is later by the allowed lateness, and each late row
    gives its window again, for a sink that replaces by key.
    """
    warn_of_state(config)
    ts = config.event_time_column
    delay = config.lateness_ms + (config.allowed_lateness_ms if config.late_data == "reopen" else 0)
    df = df.withWatermark(ts, f"{delay} milliseconds")
    if config.kind == "session":
        return capped_sessions(df, config)
    whole = whole_numbers(df)
    out = df.groupBy(*config.group_by, config.window().alias("_w")).agg(*[a.expression(ts, True, a.column in whole, config.max_distinct_values_per_group) for a in config.aggregates])
    start, end = config.names
    return out.select(*config.group_by, F.col("_w.start").alias(start), F.col("_w.end").alias(end), *[a.alias for a in config.aggregates])


def _finish(rows: pd.DataFrame, piece: np.ndarray, config: WindowConfig, whole: set[str]) -> dict[str, Any]:
    """The aggregates of rows in order of time by the number of their session, numbers ascending."""
    numbers, out = np.unique(piece), {}
    for a in config.aggregates:
        if a.kind == "count" and not a.column:
            out[a.alias] = np.unique(piece, return_counts=True)[1]
            continue
        there = rows[a.column].notna().to_numpy()
        known, at = rows[a.column][there], piece[there]
        groups = known.groupby(at)
        if a.kind == "count":
            made = groups.size()
        elif a.kind == "count_distinct":
            made = groups.nunique()
            if (made > config.max_distinct_values_per_group).any():
                raise ValueError(f"more than {config.max_distinct_values_per_group} distinct values of {a.column}")
        elif a.kind == "sum" and a.column in whole and known.dtype.kind in "iu":
            numerals = known.to_numpy().astype("int64")
            high, low = (pd.Series(half).groupby(at).sum() for half in (numerals >> 32, numerals & 0xFFFFFFFF))
            made = pd.Series([Decimal((int(h) << 32) + int(x)) for h, x in zip(high, low)], high.index, dtype=object)
        elif a.kind == "sum" and a.column in whole:
            made = pd.Series({k: Decimal(sum(map(int, v))) for k, v in groups}, dtype=object)
        elif a.kind in ("sum", "avg") and known.dtype == object:
            made = pd.Series({k: v.sum() if a.kind == "sum" else v.mean() for k, v in groups}, dtype=object)
        else:
            made = getattr(groups, {"avg": "mean"}.get(a.kind, a.kind))()
        out[a.alias] = made.reindex(numbers, fill_value=0) if a.kind.startswith("count") else made.reindex(numbers)
        out[a.alias] = out[a.alias].array
    return out


#: Fixed: groups that keys are dealt to by their hash. The state of a checkpoint belongs to this number.
GROUPS = 1024


def capped_sessions(df: DataFrame, config: WindowConfig) -> DataFrame:
    """Sessions of a stream, closed by the gap or the cap, with their ``session_id``.

    State holds the rows of open sessions (key, event time and aggregated columns, as an Arrow
    stream for each of ``GROUPS`` groups of keys, so that a batch costs a call for each group and
    not for each key) until the watermark passes the last event by the gap; rows below the
    watermark and rows without an event time are dropped.  With ``late_data="reopen"`` the
    watermark is later by the allowed lateness, and each session that got rows is given again at
    once, merged with those it now touches, for a sink that replaces by key and ``session_id``.
    """
    ts, keys, reopen = config.event_time_column, list(config.group_by), config.late_data == "reopen"
    start, end = config.names
    values = list(dict.fromkeys(a.column for a in config.aggregates if a.column))
    names = [f"_k{i}" for i in range(len(keys))]
    columns = ["_us", *names, *values]
    kinds, whole = {f.name: f.dataType for f in df.schema}, whole_numbers(df)
    results = {"count": T.LongType(), "count_distinct": T.LongType(), "avg": T.DoubleType()}
    kind = lambda a: T.DecimalType(38, 0) if a.kind == "sum" and a.column in whole else results.get(a.kind) or kinds[a.column]
    schema = T.StructType([*[T.StructField(n, kinds[k]) for n, k in zip(names, keys)], T.StructField("_start", T.LongType()), T.StructField("_end", T.LongType()), *[T.StructField(a.alias, kind(a)) for a in config.aggregates]])
    state = T.StructType([T.StructField("rows", T.BinaryType())])
    gap, cap = config.gap_ms * 1000, config.max_session_duration_ms * 1000

    def run(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        wm = held.getCurrentWatermarkMs() * 1000
        rows = [pa.ipc.open_stream(held.get[0]).read_pandas().assign(_new=False)] if held.exists else []
        rows += [(batch[columns][batch["_us"] >= wm] if wm else batch[columns]).assign(_new=True) for batch in batches]
        rows = [r for r in rows if len(r)]
        if not rows:
            return
        every = pd.concat(rows, ignore_index=True)
        key, us = every.groupby(names, sort=False, dropna=False).ngroup().to_numpy(), every["_us"].to_numpy()
        order = np.lexsort((us, key))  # stable
        every, key, us = every.take(order), key[order], us[order]
        n, other = len(us), key[1:] != key[:-1]
        first = np.flatnonzero(np.concatenate(([True], other | (np.diff(us) > gap))))
        stop = np.append(first[1:], n)
        cuts = []
        for k in np.flatnonzero(us[stop - 1] - us[first] >= cap):  # only those that are longer than the cap
            i, last = first[k], stop[k]
            while (i := i + np.searchsorted(us[i:last], us[i] + cap)) < last:
                cuts.append(i)
        if cuts:
            first = np.sort(np.concatenate((first, cuts)))
            stop = np.append(first[1:], n)
        capped = np.append((key[stop[:-1]] == key[first[:-1]]) & (us[stop[:-1]] - us[first[:-1]] >= cap), False)
        closed = capped | (us[stop - 1] + gap < wm)
        given = np.logical_or.reduceat(every["_new"].to_numpy(), first) if reopen else closed
        opened = np.repeat(~closed, stop - first)
        if opened.any():
            rest, sink = pa.Table.from_pandas(every.loc[opened, columns], preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_table(rest)
            held.update((sink.getvalue().to_pybytes(),))
            held.setTimeoutTimestamp(max(int((us[stop - 1][~closed].min() + gap) // 1000), held.getCurrentWatermarkMs(), 1))
        elif held.exists:
            held.remove()
        if given.any():
            there = np.repeat(given, stop - first)
            made = {name: every[name].array[first[given]] for name in names} | {"_start": us[first[given]], "_end": us[stop[given] - 1]}
            yield pd.DataFrame(made | _finish(every[there], np.repeat(np.arange(len(first)), stop - first)[there], config, whole))[[f.name for f in schema]]

    mode = "update" if reopen else "append"
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("_group")
    # null keys go apart, so that a frame's key column is all null or holds none
    null = [F.col(k).isNull().alias(f"_null{i}") for i, k in enumerate(keys)]
    rows = df.filter(F.col(ts).isNotNull()).select(*dict.fromkeys([ts, *values]), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), *[F.col(k).alias(n) for n, k in zip(names, keys)], group, *null)
    out = rows.groupBy("_group", *[f"_null{i}" for i in range(len(keys))]).applyInPandasWithState(run, schema, state, mode, GroupStateTimeout.EventTimeTimeout)
    out = out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[F.timestamp_micros(at).alias(name) for at, name in (("_start", start), ("_end", end))], *[a.alias for a in config.aggregates])
    return out.select(*keys, start, end, session_id(keys, start), *[a.alias for a in config.aggregates])


@dataclass(frozen=True)
class JoinConfig:
    """An inner join of two streams; ``left_ts - right_ts`` lies from ``-window_ms`` to ``window_ms`` or between own bounds."""

    keys: tuple[tuple[str, str], ...]
    window_ms: int | None = None
    min_delta_ms: int | None = None
    max_delta_ms: int | None = None
    lateness_ms: int = 0
    prefixes: tuple[str, str] = ("left_", "right_")
    event_time_column: str = "_event_ts"

    def bounds(self) -> tuple[int, int]:
        if self.window_ms is not None:
            return -self.window_ms, self.window_ms
        if self.min_delta_ms is None or self.max_delta_ms is None:
            raise ValueError("a stream join needs window_ms or min_delta_ms and max_delta_ms")
        return self.min_delta_ms, self.max_delta_ms


def stream_join(left: DataFrame, right: DataFrame, config: JoinConfig, how: str = "inner") -> DataFrame:
    """Join by keys and event-time distance; columns get the prefixes, null keys match nothing.

    Works on streams (state is dropped as the watermarks pass) and on tables alike.
    """
    a, b = config.prefixes
    low, high = config.bounds()
    ts = config.event_time_column
    if left.isStreaming:
        left, right = (d.withWatermark(ts, f"{config.lateness_ms} milliseconds") for d in (left, right))
    left, right = left.select(*[F.col(c).alias(a + c) for c in left.columns]), right.select(*[F.col(c).alias(b + c) for c in right.columns])
    on = F.lit(True)
    for x, y in config.keys:
        on = on & (F.col(a + x) == F.col(b + y))
    ms = lambda n: F.expr(f"INTERVAL {n / 1000:.3f} SECONDS")
    on = on & (F.col(b + ts) >= F.col(a + ts) + ms(low)) & (F.col(b + ts) <= F.col(a + ts) + ms(high))
    return left.join(right, on, how)


def lookup_join(stream: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", small: int = 10_000_000) -> DataFrame:
    """Join a stream with a table; the table is broadcast only if its statistics show it is small."""
    size = lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return stream.join(F.broadcast(lookup) if int(str(size)) <= small else lookup, list(keys), how)


def check_caps(batch: DataFrame, config: WindowConfig) -> None:
    """Raise if a window of a micro-batch's result has more groups than allowed."""
    start = config.names[0]
    worst = batch.groupBy(start).count().filter(F.col("count") > config.max_groups_per_window).limit(1).collect()
    if worst:
        raise ValueError(f"window {worst[0][0]} has {worst[0][1]} groups; the cap is {config.max_groups_per_window}")


def refreshing(load: Callable[[], DataFrame], every_seconds: float) -> Callable[[], DataFrame]:
    """A lookup that is loaded again once it is older than an interval; use it inside foreachBatch."""
    import time

    held: list[Any] = [None, 0.0]

    def get() -> DataFrame:
        if held[0] is None or time.monotonic() - held[1] >= every_seconds:
            held[0], held[1] = load(), time.monotonic()
        return held[0]

    return get
