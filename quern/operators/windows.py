"""Event-time windows over finished tables: tumbling, hopping, sessions with a cap."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("tumbling", "hopping", "session")
LATE = ("drop", "reopen", "dlq")


@dataclass(frozen=True)
class Aggregate:
    """``kind`` of count, sum, min, max, avg, first, last, count_distinct; nulls are skipped but by count of rows."""

    kind: str
    column: str | None = None
    name: str | None = None
    exact: bool = True

    @property
    def alias(self) -> str:
        return self.name or (f"{self.kind}_{self.column}" if self.column else self.kind)

    def expression(self, ts: str, streaming: bool = False, whole: bool = False, most: int | None = None) -> Column:
        """The aggregate; ``whole`` numbers are summed as decimals, and ``most`` distinct values are allowed in a stream's state."""
        c = F.col(self.column) if self.column else None
        if self.kind != "count" and c is None:
            raise ValueError(f"{self.kind} needs a column")
        when = F.when(c.isNotNull(), F.col(ts)) if c is not None else None
        made = {
            "count": lambda: F.count(c if c is not None else F.lit(1)),
            "sum": lambda: F.sum(c.cast("decimal(28,0)") if whole else c),
            "min": lambda: F.min(c),
            "max": lambda: F.max(c),
            "avg": lambda: F.avg(c),
            "first": lambda: F.min_by(c, when),
            "last": lambda: F.max_by(c, when),
            "count_distinct": lambda: F.approx_count_distinct(c, 0.0081) if not self.exact else _at_most(F.size(F.collect_set(c)), most, self.column).cast("long") if streaming else F.count_distinct(c),
        }
        if self.kind not in made:
            raise ValueError(f"unknown aggregate {self.kind!r}")
        return made[self.kind]().alias(self.alias)


def _at_most(size: Column, most: int | None, name: str) -> Column:
    return size if most is None else F.when(size > most, F.raise_error(F.lit(f"more than {most} distinct values of {name}"))).otherwise(size)


def whole_numbers(df: DataFrame) -> set[str]:
    """Columns of whole numbers, whose sums may pass 64 bits."""
    return {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}


@dataclass(frozen=True)
class WindowConfig:
    """A windowed aggregation; times are in milliseconds."""

    kind: str
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = (Aggregate("count"),)
    duration_ms: int | None = None
    hop_ms: int | None = None
    gap_ms: int | None = None
    max_session_duration_ms: int | None = None
    lateness_ms: int = 0
    allowed_lateness_ms: int = 0
    late_data: str = "drop"
    max_groups_per_window: int = 100_000
    max_distinct_values_per_group: int = 100_000
    event_time_column: str = "_event_ts"
    names: tuple[str, str] = field(default=("window_start", "window_end"))

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if self.late_data not in LATE:
            raise ValueError(f"late_data must be one of {LATE}")
        if self.kind == "session":
            if not self.group_by:
                raise ValueError("a session window needs group_by")
            if not self.gap_ms or not self.max_session_duration_ms:
                raise ValueError("a session window needs gap_ms and max_session_duration_ms")
        elif not self.duration_ms or self.duration_ms <= 0:
            raise ValueError("duration_ms must be positive")
        if self.kind == "hopping" and not (self.hop_ms and 0 < self.hop_ms <= self.duration_ms):
            raise ValueError("hop_ms must be positive and at most duration_ms")

    def window(self) -> Column:
        ts, ms = F.col(self.event_time_column), lambda n: f"{n} milliseconds"
        if self.kind == "session":
            return F.session_window(ts, ms(self.gap_ms))
        return F.window(ts, ms(self.duration_ms), ms(self.hop_ms)) if self.kind == "hopping" else F.window(ts, ms(self.duration_ms))


#: State of a window beyond which a warning is given.
STATE_WARNING_BYTES = 1 << 30


def state_bytes(config: WindowConfig) -> int:
    """Estimate of the state that a window's groups may take at their cap."""
    each = 96 + 24 * len(config.aggregates) + sum(16 + len(c) for c in config.group_by) + (64 if config.kind == "session" else 0)
    return config.max_groups_per_window * each


def warn_of_state(config: WindowConfig, most: int = STATE_WARNING_BYTES) -> bool:
    """Warn if a window's state may pass a bound at its cap of groups; whether it may."""
    size = state_bytes(config)
    if size > most:
        warnings.warn(f"the state of a window may take {size >> 20} MB at {config.max_groups_per_window} groups", ResourceWarning, stacklevel=2)
    return size > most


def windowed(df: DataFrame, config: WindowConfig) -> DataFrame:
    """Aggregate a finished table by event-time windows.

    Rows without an event time are in no window.  Sessions are cut at their cap; see
    ``sessions``.  Start is inclusive, end exclusive but for sessions, where it is the
    last event's time.
    """
    ts = config.event_time_column
    df = df.filter(F.col(ts).isNotNull())
    start, end = config.names
    if config.kind == "session":
        return sessions(df, config)
    whole = whole_numbers(df)
    out = df.groupBy(*config.group_by, config.window().alias("_w")).agg(*[a.expression(ts, whole=a.column in whole) for a in config.aggregates])
    return out.select(*config.group_by, F.col("_w.start").alias(start), F.col("_w.end").alias(end), *[a.alias for a in config.aggregates])


def sessions(df: DataFrame, config: WindowConfig) -> DataFrame:
    """Sessions by gap, cut where an event is the cap or more after its session's start.

    Gap sessions come from one sort by key and time.  Only those longer than the cap
    are cut further: their distinct event times (not their rows) are folded in order,
    and the starts found are joined back by range within the session.
    """
    ts, keys = config.event_time_column, list(config.group_by)
    start, end = config.names
    df = df.filter(F.col(ts).isNotNull())
    order = Window.partitionBy(*keys).orderBy(ts)
    gap = F.expr(f"INTERVAL {config.gap_ms / 1000:.3f} SECONDS")
    fresh = F.when(F.col(ts) > F.lag(ts).over(order) + gap, 1).when(F.lag(ts).over(order).isNull(), 1).otherwise(0)
    marked = df.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = marked.withColumn("_us", micros)
    cap = config.max_session_duration_ms * 1000
    spans = marked.groupBy(*keys, "_session").agg(F.min("_us").alias("_from"), F.max("_us").alias("_to"))
    long = spans.filter(F.col("_to") - F.col("_from") >= cap).select(*keys, "_session")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys] + [F.col("l._session") == F.col("m._session")]
    times = marked.alias("m").join(long.alias("l"), same, "left_semi").groupBy(*keys, "_session").agg(F.array_sort(F.collect_set("_us")).alias("_times"))
    zero = F.slice(F.col("_times"), 1, 1)
    starts = F.aggregate(F.col("_times"), zero, lambda acc, t: F.when(t - F.element_at(acc, -1) >= cap, F.concat(acc, F.array(t))).otherwise(acc))
    cuts = times.select(*keys, "_session", starts.alias("_starts"))
    joined = marked.alias("m").join(cuts.alias("l"), same, "left").select("m.*", "l._starts")
    part = F.coalesce(F.array_max(F.filter(F.col("_starts"), lambda s: s <= F.col("_us"))), F.lit(0))
    whole = whole_numbers(df)
    out = joined.withColumn("_part", part).groupBy(*keys, "_session", "_part").agg(F.min(ts).alias(start), F.max(ts).alias(end), *[a.expression(ts, whole=a.column in whole) for a in config.aggregates])
    return out.select(*keys, start, end, session_id(keys, start), *[a.alias for a in config.aggregates])


def session_id(keys: list[str], start: str) -> Column:
    """A hash of a session's key and start."""
    return F.xxhash64(*keys, F.unix_micros(F.col(start).cast("timestamp"))).alias("session_id")
