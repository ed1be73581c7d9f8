"""Data quality: expectations in one pass over a table, and freshness."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.schema import TableSpec

#: A pipeline is near its limit from this share of it on.
WARN_SHARE = 0.8


@dataclass(frozen=True)
class Assertion:
    name: str
    verdict: str
    failures: int | None
    message: str = ""


@dataclass(frozen=True)
class Outcome:
    table: str
    assertions: tuple[Assertion, ...]

    @property
    def verdict(self) -> str:
        """empty if nothing was checked, fail if a check failed, warn if one could not be made, else pass."""
        said = {a.verdict for a in self.assertions}
        return "empty" if not said else "fail" if "fail" in said else "warn" if "error" in said else "pass"


def run_expectations(df: DataFrame, spec: TableSpec | None = None, conditions: Mapping[str, str | Column] | None = None, unique: Sequence[Sequence[str]] = (), freshness: tuple[str, str | float | timedelta] | None = None, now: datetime | None = None, name: str = "") -> Outcome:
    """Check a table: declared not-null columns and keys, conditions that hold for each row, uniqueness, freshness.

    Row conditions are counted in one aggregation; a null condition is a failure.  Each
    uniqueness check is a grouping by its key.
    """
    checks: dict[str, Column] = {}
    keys = [tuple(u) for u in unique]
    if spec is not None:
        checks |= {f"not_null({c.name})": F.col(c.name).isNotNull() for c in spec.columns if not c.nullable and c.name in df.columns}
        keys += [tuple(spec.keys), *spec.unique]
    missing = [c.name for c in spec.columns if c.name not in df.columns] if spec else []
    out = [Assertion(f"column({c})", "fail", None, "missing") for c in missing]
    for k, v in (conditions or {}).items():
        checks[k] = F.expr(v) if isinstance(v, str) else v
    aggregates = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())]
    if freshness:
        aggregates.append(F.max(F.col(freshness[0]).cast("timestamp")).alias("fresh"))
    if aggregates:
        row = df.agg(*aggregates).first()
        out += [Assertion(k, "fail" if row[f"c{i}"] else "pass", row[f"c{i}"], f"{row[f'c{i}']} rows" if row[f"c{i}"] else "") for i, k in enumerate(checks)]
        if freshness:
            state = evaluate_freshness(row["fresh"], freshness[1], now)
            out.append(Assertion(f"freshness({freshness[0]})", "fail" if state["state"] == "breached" else "pass", None, state["state"]))
    for key in dict.fromkeys(keys):
        twice = df.groupBy(*key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).first()["n"]
        out.append(Assertion(f"unique({', '.join(key)})", "fail" if twice else "pass", twice, f"{twice} keys" if twice else ""))
    return Outcome(name, tuple(out))


def parse_duration(value: str | float | timedelta) -> timedelta:
    """Seconds, or a text such as 90s, 15m, 2h, 1d."""
    if isinstance(value, timedelta):
        return value
    if isinstance(value, (int, float)):
        return timedelta(seconds=value)
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhdw]?)\s*", value)
    if not found:
        raise ValueError(f"not a duration: {value!r}")
    return timedelta(seconds=float(found[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[found[2]])


def evaluate_freshness(last_success: datetime | None, sla: str | float | timedelta, now: datetime | None = None) -> dict:
    """healthy, warning (from four fifths of the limit) or breached (beyond it, or never)."""
    utc = lambda d: d.replace(tzinfo=UTC) if d.tzinfo is None else d
    now, limit = utc(now or datetime.now(UTC)), int(parse_duration(sla).total_seconds())
    if last_success is None:
        return {"state": "breached", "lag_seconds": None, "sla_seconds": limit}
    lag = int((now - utc(last_success)).total_seconds())
    return {"state": "breached" if lag > limit else "warning" if lag >= WARN_SHARE * limit else "healthy", "lag_seconds": lag, "sla_seconds": limit}
