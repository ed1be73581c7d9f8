"""Column normalizers and row-level preparation, as Spark expressions.

A normalizer is a function from Column to Column; a list of them is applied from left
to right.  ``transforms`` work on whole tables and run after the columns'.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Normalizer = Callable[[Column], Column]

#: Date and time patterns that are known, with the guard that a text must match.
FORMATS: dict[str, tuple[str, str]] = {
    "YYYY-MM-DD": (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    "YYYY-MM-DD HH24:MI:SS": (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    "YYYY-MM-DD HH24:MI:SS.MS": (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+$", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    "YYYY-MM-DDTHH24:MI:SS": (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    "YYYY-MM-DDTHH24:MI:SSOF": (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}(:?\d{2})?$", "yyyy-MM-dd'T'HH:mm:ss[XXX][XX][X]"),
    "MM/DD/YYYY": (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    "DD/MM/YYYY": (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    "MM-DD-YYYY": (r"^\d{2}-\d{2}-\d{4}$", "MM-dd-yyyy"),
    "DD-MM-YYYY": (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    "YYYYMMDD": (r"^\d{8}$", "yyyyMMdd"),
}
#: What is tried, in this order, where no format is given.
TIMESTAMP_FORMATS = ("YYYY-MM-DD HH24:MI:SS.MS", "YYYY-MM-DDTHH24:MI:SSOF", "YYYY-MM-DDTHH24:MI:SS", "YYYY-MM-DD HH24:MI:SS", "YYYY-MM-DD", "MM/DD/YYYY")
DATE_FORMATS = ("YYYY-MM-DD", "YYYYMMDD", "MM/DD/YYYY")


def trim() -> Normalizer:
    return F.trim


def lower() -> Normalizer:
    return F.lower


def upper() -> Normalizer:
    return F.upper


def empty_to_null() -> Normalizer:
    return lambda c: F.nullif(c, F.lit(""))


def whitespace_to_null() -> Normalizer:
    return lambda c: F.nullif(F.trim(c), F.lit(""))


def replace(old: str, new: str) -> Normalizer:
    return lambda c: F.replace(c, F.lit(old), F.lit(new))


def regex_replace(pattern: str, replacement: str, flags: str = "g") -> Normalizer:
    r"""Replace matches (``g``: all, else the first); ``i`` ignores case, ``\1`` names a group."""
    java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    pattern = f"(?i){pattern}" if "i" in flags else pattern
    if "g" in flags:
        return lambda c: F.regexp_replace(c, pattern, java)

    def first(c: Column) -> Column:
        at = F.regexp_instr(c, F.lit(pattern))
        found = F.regexp_substr(c, F.lit(pattern))
        tail = F.substring(c, at, F.length(c))
        rest = F.substring(tail, F.length(found) + 1, F.length(c))
        return F.when(F.coalesce(at, F.lit(0)) > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.regexp_replace(found, pattern, java), rest)).otherwise(c)

    return first


def truncate(n: int) -> Normalizer:
    return lambda c: F.left(c, F.lit(n))


def email_normalize() -> Normalizer:
    return lambda c: F.lower(F.trim(c))


def phone_normalize() -> Normalizer:
    return lambda c: F.regexp_replace(c, "[^0-9+]", "")


def _guarded(c: Column, cases: Iterable[tuple[str, Column]], on_failure: str, default: Any) -> Column:
    """The first case whose pattern a text matches; what gives none is null, an error or the default, which nulls become as well."""
    if on_failure not in ("null", "error", "default"):
        raise ValueError(f"on_failure must be null, error or default, not {on_failure!r}")
    if (on_failure == "default") != (default is not None):
        raise ValueError("a default goes with on_failure='default', and with that alone")
    out = None
    for pattern, value in cases:
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    if on_failure == "error":
        return F.when(c.isNull(), None).otherwise(F.coalesce(out, F.raise_error(F.concat(F.lit("cannot parse "), c))))
    return F.coalesce(out, F.lit(default)) if on_failure == "default" else out


def _formats(format: str | None, formats: Iterable[str] | None, known: tuple[str, ...], on_failure: str) -> tuple[str, ...]:
    if format is not None and formats is not None:
        raise ValueError("give format or formats, not both")
    wanted = (format,) if format is not None else tuple(formats) if formats is not None else known
    unknown = [f for f in wanted if f not in FORMATS]
    if unknown or not wanted:
        raise ValueError(f"unknown formats: {unknown}" if unknown else "formats is empty")
    if on_failure == "error" and len(wanted) != 1:
        raise ValueError("on_failure='error' requires a single format")
    return wanted


def parse_timestamp(format: str | None = None, formats: Iterable[str] | None = None, on_failure: str = "null", default: Any = None) -> Normalizer:
    """The first format whose shape fits; a text of that shape that is no date counts as one that cannot be parsed."""
    wanted = _formats(format, formats, TIMESTAMP_FORMATS, on_failure)
    return lambda c: _guarded(c, [(FORMATS[f][0], F.try_to_timestamp(c, F.lit(FORMATS[f][1]))) for f in wanted], on_failure, default)


def parse_date(format: str | None = None, formats: Iterable[str] | None = None, on_failure: str = "null", default: Any = None) -> Normalizer:
    wanted = _formats(format, formats, DATE_FORMATS, on_failure)
    return lambda c: _guarded(c, [(FORMATS[f][0], F.try_to_timestamp(c, F.lit(FORMATS[f][1])).cast("date")) for f in wanted], on_failure, default)


def to_timezone(tz: str) -> Normalizer:
    return lambda c: F.from_utc_timestamp(c, tz)


def date_trunc(part: str) -> Normalizer:
    return lambda c: F.date_trunc(part, c)


def parse_int(on_failure: str = "null", default: Any = None) -> Normalizer:
    return lambda c: _guarded(c, [(r"^-?\d+$", c.try_cast("bigint"))], on_failure, default)


def parse_numeric(precision: int, scale: int, on_failure: str = "null", default: Any = None) -> Normalizer:
    return lambda c: _guarded(c, [(r"^-?\d+(\.\d+)?$", c.try_cast(f"decimal({precision},{scale})"))], on_failure, default)


def round(n: int = 0) -> Normalizer:  # noqa: A001
    return lambda c: F.round(c, n)


def clamp(low: Any, high: Any) -> Normalizer:
    """Between two bounds; a null becomes the lower one."""
    return lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high))


def parse_bool(truthy: Iterable[str] = ("true", "1", "yes", "y"), falsy: Iterable[str] = ("false", "0", "no", "n")) -> Normalizer:
    return lambda c: F.when(F.lower(c).isin(*[x.lower() for x in truthy]), True).when(F.lower(c).isin(*[x.lower() for x in falsy]), False)


def default(value: Any) -> Normalizer:
    return lambda c: F.coalesce(c, F.lit(value))


not_null_or = default


def nullif(value: Any) -> Normalizer:
    return lambda c: F.nullif(c, F.lit(value))


class derive:
    """A new column from an SQL expression; must come first in a list of normalizers."""

    def __init__(self, expression: str) -> None:
        self.expression = expression


class sql:
    """An SQL expression in which the whole word ``col`` stands for the column so far."""

    def __init__(self, expression: str) -> None:
        self.expression = expression


def normalize(df: DataFrame, columns: Mapping[str, list]) -> DataFrame:
    """Apply each column's normalizers; columns not named pass through, derived ones are added."""
    for name, steps in columns.items():
        if any(isinstance(s, derive) for s in steps[1:]):
            raise ValueError(f"{name}: derive must be the first normalizer")
        for step in steps:
            if isinstance(step, derive):
                df = df.withColumn(name, F.expr(step.expression))
            elif isinstance(step, sql):
                df = df.withColumn(name, F.expr(re.sub(r"\bcol\b", f"`{name}`", step.expression)))
            else:
                df = df.withColumn(name, step(F.col(name)))
    return df


def deduplicate_by(df: DataFrame, *keys: str, order_by: Iterable[Column | str] = ()) -> DataFrame:
    """One row for each key, the first by ``order_by``; without it any one."""
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    if not order:
        return df.dropDuplicates(list(keys))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def filter_where(df: DataFrame, expression: str) -> DataFrame:
    return df.filter(expression)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def sample_pct(df: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """About ``percent`` of all rows (0 to 100), the same ones for equal partitions and seed."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must be from 0 to 100")
    return df.sample(percent / 100, seed)
