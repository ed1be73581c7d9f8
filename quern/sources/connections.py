"""Named connections: typed options, a registry, resolution from files and the environment, redaction."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Kinds with the options each must have.
KINDS: dict[str, tuple[str, ...]] = {
    "postgres": ("host", "database"),
    "mysql": ("host", "database"),
    "sqlite": ("path",),
    "duckdb": ("path",),
    "snowflake": ("account", "database"),
    "bigquery": ("project",),
    "redshift": ("host", "database"),
    "jdbc": ("url",),
    "kafka": ("bootstrap_servers",),
    "kinesis": ("stream", "region"),
    "pubsub": ("project", "subscription"),
    "rabbitmq": ("url", "queue"),
    "delta_local": ("path",),
    "delta_s3": ("bucket", "prefix"),
    "object_store_local": ("path",),
    "object_store_s3": ("bucket", "prefix"),
}
SECRET = re.compile(r"password|secret|token|access_key|credential|private", re.I)
_PORTS = {"postgres": 5432, "redshift": 5439, "mysql": 3306}


@dataclass(frozen=True)
class Connection:
    kind: str
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown connection kind {self.kind!r}; known: {', '.join(sorted(KINDS))}")
        missing = [o for o in KINDS[self.kind] if not self.options.get(o)]
        if missing:
            raise ValueError(f"{self.kind}: missing {', '.join(missing)}")

    @property
    def path(self) -> str:
        o = self.options
        return f"s3a://{o['bucket']}/{o['prefix'].strip('/')}" if self.kind.endswith("_s3") else o["path"]

    @property
    def jdbc_url(self) -> str:
        o = self.options
        if self.kind in _PORTS:
            scheme = {"postgres": "postgresql"}.get(self.kind, self.kind)
            return f"jdbc:{scheme}://{o['host']}:{o.get('port', _PORTS[self.kind])}/{o['database']}"
        if self.kind in ("sqlite", "duckdb"):
            return f"jdbc:{self.kind}:{o['path']}"
        if self.kind == "jdbc":
            return o["url"]
        raise ValueError(f"{self.kind} is not reached over JDBC")

    def read(self, spark: SparkSession, sql: str | None = None) -> DataFrame:
        from quern.sources import files

        if self.kind.startswith("object_store"):
            return files.read(spark, self.path, self.options.get("format"))
        if self.kind.startswith("delta"):
            return spark.read.format("delta").load(self.path)
        if self.kind in ("snowflake", "bigquery"):
            return spark.read.format(self.kind).options(**{k: str(v) for k, v in self.options.items()}).option("query", sql).load()
        if sql is None:
            raise ValueError(f"{self.kind} needs a query")
        login = {k: str(v) for k, v in self.options.items() if k in ("user", "password")}
        return files.query(spark, self.jdbc_url, sql, self.options.get("driver"), **login)


@dataclass(frozen=True)
class Source:
    """A query of a connection, read when it is needed."""

    connection: Connection
    query: str

    @staticmethod
    def _of(kind: str, connection: Connection, query: str) -> Source:
        if connection.kind != kind:
            raise ValueError(f"expected a {kind} connection, not {connection.kind}")
        return Source(connection, query)

    @staticmethod
    def postgres_query(connection: Connection, query: str) -> Source:
        return Source._of("postgres", connection, query)

    @staticmethod
    def postgres_table(connection: Connection, schema: str, table: str, columns: Iterable[str] | None = None) -> Source:
        return Source._of("postgres", connection, f"SELECT {', '.join(columns) if columns is not None else '*'} FROM {schema}.{table}")

    @staticmethod
    def snowflake_query(connection: Connection, query: str) -> Source:
        return Source._of("snowflake", connection, query)

    @staticmethod
    def bigquery_query(connection: Connection, query: str) -> Source:
        return Source._of("bigquery", connection, query)

    @staticmethod
    def redshift_query(connection: Connection, query: str) -> Source:
        return Source._of("redshift", connection, query)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.connection.read(spark, self.query)


def redact(options: dict[str, Any]) -> dict[str, Any]:
    """Options with their secrets hidden, those inside URLs too."""
    hide = lambda v: re.sub(r"(://[^:/@]+):[^@]+@", r"\1:***@", v) if isinstance(v, str) else redact(v) if isinstance(v, dict) else v
    return {k: "***" if SECRET.search(k) and v else hide(v) for k, v in options.items()}


_REGISTRY: dict[str, Connection] = {}


def register(name: str, connection: Connection) -> None:
    _REGISTRY[name] = connection


def _expand(value: Any) -> Any:
    if isinstance(value, str):
        def named(m: re.Match) -> str:
            if m[1] not in os.environ:
                raise KeyError(f"environment variable {m[1]} is not set")
            return os.environ[m[1]]

        return re.sub(r"\$\{(\w+)\}", named, value)
    return value


def resolve(name: str | Connection, file: str | None = None) -> Connection:
    """A connection by name: registered, else from ``[connections.name]`` of a TOML file, else ``QUERN_CONN_NAME_OPTION``."""
    if isinstance(name, Connection):
        return name
    if name in _REGISTRY:
        return _REGISTRY[name]
    if file and os.path.exists(file):
        with open(file, "rb") as f:
            entry = tomllib.load(f).get("connections", {}).get(name)
        if entry:
            return Connection(entry["kind"], {k: _expand(v) for k, v in entry.items() if k != "kind"})
    start = f"QUERN_CONN_{name.upper()}_"
    found = {k[len(start) :].lower(): v for k, v in os.environ.items() if k.startswith(start)}
    if "kind" in found:
        return Connection(found.pop("kind"), found)
    raise KeyError(f"no connection named {name!r}")


def names() -> list[str]:
    return sorted(_REGISTRY)


__all__ = ["Connection", "KINDS", "Source", "names", "redact", "register", "resolve"]
