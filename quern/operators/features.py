"""Point-in-time features from tables with history (``valid_from``, ``valid_to``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_in_time(view: DataFrame, keys: Mapping[str, object], as_of: datetime, columns: Sequence[str] | None = None) -> DataFrame:
    """The version of one entity that was valid at a time; no row if none was."""
    for k, v in keys.items():
        view = view.filter(F.col(k) == F.lit(v))
    at = F.lit(as_of).cast("timestamp")
    found = view.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return found.orderBy(F.desc("valid_from")).limit(1).select(*(columns or view.columns))


def online_features(view: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Current versions only."""
    found = view.filter("is_current")
    return found.select(*keys, *columns) if columns else found


def historical_features(spine: DataFrame, view: DataFrame, keys: Sequence[str], columns: Sequence[str], as_of: str = "as_of", prefix: str = "") -> DataFrame:
    """Each row of the spine with the version of its entity that was valid at ``as_of``, else nulls.

    Both sides are merged and sorted by entity and time once, and the newest version so
    far is carried along, so no pair of a spine row and a version is formed.  Versions of
    an entity must not overlap (they do not, as ``scd2`` makes them).  Repeated spine
    rows stay; of versions from the same moment the one that ends last is taken.
    """
    from pyspark.sql import Window

    names = [f"{prefix}{c}" for c in columns]
    when = F.col(as_of).cast("timestamp")
    left = spine.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], when.alias("_at"), F.lit(1).alias("_kind"), F.struct(*spine.columns).alias("_row"))
    version = F.struct(F.col("valid_from").cast("timestamp").alias("_from"), F.col("valid_to").cast("timestamp").alias("_to"), *[F.col(c) for c in columns])
    right = view.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("valid_from").cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), version.alias("_version"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_at", "_kind", F.col("_version._to").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_v", F.last("_version", ignorenulls=True).over(w)).filter("_kind = 1")
    has_key = F.lit(True)
    for i in range(len(keys)):
        has_key = has_key & F.col(f"_k{i}").isNotNull()
    valid = has_key & (F.col("_v._to").isNull() | (F.col("_v._to") > F.col("_at")))
    return known.select("_row.*", *[F.when(valid, F.col(f"_v.{c}")).alias(n) for c, n in zip(columns, names)])


def training_set(spine: DataFrame, views: Sequence[tuple[str, DataFrame, Sequence[str], Sequence[str]]], as_of: str = "as_of") -> DataFrame:
    """The spine with features of several views (name, table, keys, columns); clashing names become ``name__column``."""
    if not views:
        raise ValueError("training_set needs a view")
    taken = list(spine.columns)
    every = [c for _, _, _, columns in views for c in columns]
    for name, view, keys, columns in views:
        clash = {c for c in columns if c in taken or every.count(c) > 1}
        if clash:
            spine = historical_features(spine, view.withColumnsRenamed({c: f"{name}__{c}" for c in clash}), keys, [f"{name}__{c}" if c in clash else c for c in columns], as_of)
        else:
            spine = historical_features(spine, view, keys, columns, as_of)
        taken = list(spine.columns)
    return spine
