"""Python functions on columns: vectorised scalar functions, and aggregates with partial states."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERED: dict[str, Any] = {}


def udf(args: Sequence[str], returns: str, name: str | None = None) -> Callable:
    """A function of Arrow arrays; ``register`` makes it known to SQL."""

    def make(fn: Callable) -> Callable[..., Column]:
        held: list = []  # made on first use, as it needs a session

        def made_of():
            if not held:
                held.append(F.arrow_udf(fn, returns))
            return held[0]

        def call(*columns: str | Column) -> Column:
            if len(columns) != len(args):
                raise TypeError(f"{fn.__name__} takes {len(args)} columns, not {len(columns)}")
            return made_of()(*[(F.col(c) if isinstance(c, str) else c).cast(k) for c, k in zip(columns, args)])

        call.name, call.register, call.function = name or fn.__name__, lambda spark: spark.udf.register(name or fn.__name__, made_of()), fn
        REGISTERED[call.name] = call
        return call

    return make


def apply_to_batch(fn: Callable, *arrays: pa.Array) -> pa.Array:
    """Run a function of ``udf`` on one batch."""
    return fn.function(*arrays)


def udaf(args: Sequence[str], returns: str, name: str | None = None) -> Callable[[type], Callable]:
    """A class with ``update_batch(*series)``, ``merge_batch(states)``, ``state()`` and ``evaluate()``.

    Each task makes partial states of its rows; only these are shuffled, merged and
    evaluated, so a large group is not gathered anywhere.
    """

    def make(cls: type) -> Callable[[DataFrame, Sequence[str], Sequence[str], str], DataFrame]:
        def aggregate(df: DataFrame, keys: Sequence[str], columns: Sequence[str], alias: str = name or cls.__name__.lower()) -> DataFrame:
            if len(columns) != len(args):
                raise TypeError(f"{cls.__name__} takes {len(args)} columns")
            values = df.select(*keys, *[F.col(c).cast(k).alias(f"_v{i}") for i, (c, k) in enumerate(zip(columns, args))])
            key_schema = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
            partial_schema = f"{key_schema + ', ' if keys else ''}_state binary"
            most = 10_000

            def partial(batches):
                held: dict[tuple, Any] = {}
                for batch in batches:
                    groups = batch.groupby(list(keys), dropna=False, sort=False) if keys else [((), batch)]
                    for key, rows in groups:
                        key = key if isinstance(key, tuple) else (key,)
                        key = tuple(None if pd.isna(k) else k for k in key)
                        if key not in held:
                            if len(held) >= most:
                                yield out(held)
                                held = {}
                            held[key] = cls()
                        held[key].update_batch(*[rows[f"_v{i}"] for i in range(len(args))])
                if held:
                    yield out(held)

            def out(held: dict) -> pd.DataFrame:
                return pd.DataFrame([[*k, pickle.dumps(a.state())] for k, a in held.items()], columns=[*keys, "_state"])

            def merge(rows: pd.DataFrame) -> pd.DataFrame:
                acc = cls()
                acc.merge_batch([pickle.loads(s) for s in rows["_state"]])
                return pd.DataFrame([[*(rows[k].iloc[0] for k in keys), acc.evaluate()]], columns=[*keys, alias])

            schema = f"{key_schema + ', ' if keys else ''}`{alias}` {returns}"
            return values.mapInPandas(partial, partial_schema).groupBy(*keys).applyInPandas(merge, schema)

        aggregate.cls = cls
        REGISTERED[name or cls.__name__.lower()] = aggregate
        return aggregate

    return make


CALLBACKS: dict[str, Callable[..., Any]] = {}


def register_callback(name: str, fn: Callable[..., Any]) -> Callable[..., Any]:
    """Know a function by name; a later one of the same name takes its place."""
    if not callable(fn):
        raise TypeError(f"{name} is not callable")
    CALLBACKS[name] = fn
    return fn


def call_back(name: str, *args: Any, **more: Any) -> Any:
    if name not in CALLBACKS:
        raise KeyError(f"no callback named {name!r}")
    return CALLBACKS[name](*args, **more)


def aggregate_batch(cls: type, *series: pd.Series) -> Any:
    """What a class for ``udaf`` says of one batch."""
    made = cls()
    made.update_batch(*series)
    return made.evaluate()
