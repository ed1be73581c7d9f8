"""Declared tables: column types, keys, fingerprints, drift, DDL."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Annotated, Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Declared type -> (SQL name used in fingerprints, Spark type).
TYPES: dict[str, tuple[str, T.DataType]] = {
    "small_int": ("SMALLINT", T.ShortType()),
    "integer": ("INTEGER", T.IntegerType()),
    "big_int": ("BIGINT", T.LongType()),
    "float": ("REAL", T.FloatType()),
    "double": ("DOUBLE PRECISION", T.DoubleType()),
    "boolean": ("BOOLEAN", T.BooleanType()),
    "text": ("TEXT", T.StringType()),
    "date": ("DATE", T.DateType()),
    "timestamp": ("TIMESTAMP", T.TimestampNTZType()),
    "timestamp_tz": ("TIMESTAMPTZ", T.TimestampType()),
    "json": ("JSON", T.StringType()),
    "jsonb": ("JSONB", T.StringType()),
    "uuid": ("UUID", T.StringType()),
    "bytes": ("BYTEA", T.BinaryType()),
}


@dataclass(frozen=True)
class ColumnType:
    name: str
    args: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if self.name == "numeric":
            p, s = self.args
            if not (p > 0 and 0 <= s <= p and p <= 38):
                raise ValueError(f"numeric({p},{s}): precision must be 1 to 38 and scale 0 to precision")
        elif self.name == "string":
            if self.args[0] <= 0:
                raise ValueError("string length must be positive")
        elif self.name not in TYPES:
            raise ValueError(f"unknown type {self.name!r}")

    @property
    def sql(self) -> str:
        if self.name == "numeric":
            return f"NUMERIC({self.args[0]},{self.args[1]})"
        return f"VARCHAR({self.args[0]})" if self.name == "string" else TYPES[self.name][0]

    @property
    def spark(self) -> T.DataType:
        if self.name == "numeric":
            return T.DecimalType(*self.args)
        return T.StringType() if self.name == "string" else TYPES[self.name][1]


def Numeric(precision: int, scale: int) -> ColumnType:  # noqa: N802
    return ColumnType("numeric", (precision, scale))


def String(n: int) -> ColumnType:  # noqa: N802
    return ColumnType("string", (n,))


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: ColumnType
    nullable: bool = True
    primary_key: bool = False
    normalizers: tuple = ()


@dataclass(frozen=True)
class TableSpec:
    """A table's name, columns and unique constraints."""

    schema: str
    name: str
    columns: tuple[ColumnSpec, ...]
    unique: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not self.schema.strip() or not self.name.strip():
            raise ValueError("schema and table need names")
        if not names:
            raise ValueError("a table needs a column")
        if len(set(names)) < len(names):
            raise ValueError(f"duplicate columns: {sorted({n for n in names if names.count(n) > 1})}")
        if not self.keys:
            raise ValueError("a table needs a primary key")
        if any(c.primary_key and c.nullable for c in self.columns):
            raise ValueError("primary key columns cannot be nullable")
        missing = {c for u in self.unique for c in u} - set(names)
        if missing:
            raise ValueError(f"unique constraint on unknown columns: {sorted(missing)}")

    @property
    def keys(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, c.nullable, {"pk": c.primary_key}) for c in self.columns])

    @property
    def fingerprint(self) -> str:
        """32 hexadecimal digits that change with any column; the order of unique constraints has no part."""
        parts = [f"{self.schema}.{self.name}"]
        parts += [f"|{c.name}:{c.type.sql}:{'n' if c.nullable else 'N'}:{'p' if c.primary_key else 'P'}" for c in self.columns]
        parts += [f"|U:{','.join(u)}" for u in sorted(self.unique)]
        return hashlib.sha256("".join(parts).encode()).hexdigest()[:32]

    def ddl(self, using: str = "parquet") -> str:
        columns = ", ".join(f"`{c.name}` {c.type.spark.simpleString()}{'' if c.nullable else ' NOT NULL'}" for c in self.columns)
        return f"CREATE TABLE IF NOT EXISTS `{self.name}` ({columns}) USING {using} TBLPROPERTIES ('fingerprint' = '{self.fingerprint}')"

    def to_json(self) -> str:
        return json.dumps({"schema": self.schema, "name": self.name, "fingerprint": self.fingerprint, "unique": self.unique, "columns": [{"name": c.name, "type": c.type.sql, "nullable": c.nullable, "primary_key": c.primary_key} for c in self.columns]})


@dataclass(frozen=True)
class Drift:
    """How a table differs from its declaration; false if it does not."""

    missing: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    types: tuple[tuple[str, str, str], ...] = ()
    nullability: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.missing or self.extra or self.types or self.nullability)


class SchemaDrift(ValueError):
    pass


def compare(spec: TableSpec, actual: T.StructType, check_nullable: bool = False) -> Drift:
    want, have = {f.name: f for f in spec.struct}, {f.name: f for f in actual}
    both = [n for n in want if n in have]
    return Drift(
        tuple(n for n in want if n not in have),
        tuple(n for n in have if n not in want),
        tuple((n, want[n].dataType.simpleString(), have[n].dataType.simpleString()) for n in both if want[n].dataType != have[n].dataType),
        tuple(n for n in both if check_nullable and want[n].nullable != have[n].nullable),
    )


def ensure(spark: SparkSession, spec: TableSpec, on_drift: str = "error") -> Drift:
    """Create the table if it is not there, else compare it; ``on_drift`` is error, warn or ignore."""
    if not spark.catalog.tableExists(spec.name):
        spark.sql(spec.ddl())
        return Drift()
    drift = compare(spec, spark.table(spec.name).schema)
    if drift and on_drift == "error":
        raise SchemaDrift(f"{spec.name}: {drift}")
    return drift


def complete(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The frame as it is; raises if a declared column is missing."""
    missing = [c.name for c in spec.columns if c.name not in df.columns]
    if missing:
        raise SchemaDrift(f"{spec.name}: columns missing: {missing}")
    return df


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The declared columns in their order, cast to their types; raises if one is missing."""
    complete(df, spec)
    return df.select(*[df[c.name].cast(c.type.spark).alias(c.name) for c in spec.columns])


@dataclass(frozen=True)
class PrimaryKey:
    pass


@dataclass(frozen=True)
class Unique:
    pass


#: Declared types of plain Python annotations.
PYTHON_TYPES = {"int": "big_int", "float": "double", "str": "text", "bool": "boolean", "bytes": "bytes", "date": "date", "datetime": "timestamp_tz", "Decimal": "numeric"}


@dataclass
class ManagedTable:
    """A declared table made from a class by ``table``."""

    spec: TableSpec
    cls: type = field(repr=False, default=object)

    @property
    def normalizers(self) -> dict[str, list]:
        return {c.name: list(c.normalizers) for c in self.spec.columns if c.normalizers}


def table(schema: str = "public", name: str | None = None, unique: tuple[tuple[str, ...], ...] = ()):
    """Class decorator: ``x: Annotated[int, PrimaryKey()]`` and the like become a ``ManagedTable``.

    An annotation ``T | None`` is nullable; a ``ColumnType`` among the markers sets the
    type; callables are the column's normalizers, from left to right.
    """

    def make(cls: type) -> ManagedTable:
        columns, more = [], list(unique)
        for column, hint in get_type_hints(cls, include_extras=True).items():
            base, markers = (get_args(hint)[0], get_args(hint)[1:]) if get_origin(hint) is Annotated else (hint, ())
            options = [a for a in get_args(base) if a is not type(None)] if type(None) in get_args(base) else [base]
            nullable = type(None) in get_args(base)
            kind = next((m for m in markers if isinstance(m, ColumnType)), None)
            if kind is None:
                plain = PYTHON_TYPES.get(options[0].__name__)
                if plain is None:
                    raise TypeError(f"{column}: no column type for {options[0]!r}")
                kind = ColumnType(plain, (38, 9) if plain == "numeric" else ())
            if any(isinstance(m, Unique) for m in markers):
                more.append((column,))
            steps = tuple(m for m in markers if not isinstance(m, (ColumnType, PrimaryKey, Unique)))
            columns.append(ColumnSpec(column, kind, nullable, any(isinstance(m, PrimaryKey) for m in markers), steps))
        return ManagedTable(TableSpec(schema, name or cls.__name__.lower(), tuple(columns), tuple(more)), cls)

    return make


def scd2_columns(struct: T.StructType) -> T.StructType:
    """A table's columns with those that history needs."""
    return struct.add("valid_from", T.TimestampType(), False).add("valid_to", T.TimestampType(), True).add("is_current", T.BooleanType(), False).add("row_hash", T.StringType(), False)


def any_spec(**columns: Any) -> TableSpec:
    """A quick specification: ``any_spec(id="big_int!", name="text")``, the mark meaning primary key."""
    return TableSpec("public", "t", tuple(ColumnSpec(n, ColumnType(k.rstrip("!")), not k.endswith("!"), k.endswith("!")) for n, k in columns.items()))
