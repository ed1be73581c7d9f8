"""Message sources and sinks: Kafka options, payload decoding, schema-registry frames, broker data sources.

Kafka uses Spark's own connector.  Other brokers plug a client in by name: a
``BrokerSource`` deals ranges of offsets to tasks over the Python Data Source API.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: The registry frames' marks and lengths in bytes.
CONFLUENT_MAGIC, CONFLUENT_HEADER = 0, 5
GLUE_MAGIC, GLUE_HEADER, GLUE_CODECS = 3, 18, {0: "none", 5: "zlib"}


def kafka_stream(spark: SparkSession, servers: str, topic: str, start: str = "earliest", max_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A topic as a stream; ``start`` is earliest, latest or Spark's JSON of offsets."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).options(**options)
    return (reader.option("maxOffsetsPerTrigger", max_per_trigger) if max_per_trigger else reader).load()


def kafka_messages(df: DataFrame, key: Column | None = None, format: str = "json") -> DataFrame:
    """Rows as Kafka's ``key`` and ``value``: JSON of all columns, or the column ``value`` as it is."""
    if format not in ("json", "raw_bytes"):
        raise ValueError(f"unknown payload format {format!r}")
    value = F.to_json(F.struct(*df.columns)).cast("binary") if format == "json" else F.col("value").cast("binary")
    return df.select(*([key.cast("string").cast("binary").alias("key")] if key is not None else []), value.alias("value"))


def kafka_target(servers: str, topic: str, key: Column | None = None, format: str = "json", **options: str) -> Callable[[DataFrame, int], None]:
    """A pipeline's target that publishes each batch to a topic, at least once."""
    return lambda df, _: kafka_messages(df, key, format).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()


def decode(df: DataFrame, format: str, schema: str | None = None, message: str | None = None, frame: str | None = None) -> DataFrame:
    """Payloads in ``value`` as columns: json, raw_bytes, avro or protobuf, a registry's frame aside."""
    value = F.col("value")
    if frame == "confluent":
        value = confluent_payload(value)
    elif frame == "glue":
        value = glue_payload(value)
    if format == "raw_bytes":
        return df.withColumn("value", value)
    if format == "json":
        parsed = F.from_json(value.cast("string"), schema)
    elif format == "avro":
        from pyspark.sql.avro.functions import from_avro

        parsed = from_avro(value, schema)
    elif format == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf

        parsed = from_protobuf(value, message, schema)
    else:
        raise ValueError(f"unknown payload format {format!r}")
    return df.withColumn("_value", parsed).select(*[c for c in df.columns if c != "value"], "_value.*")


def confluent_payload(value: Column) -> Column:
    """What follows the magic byte and the schema's number; null for other bytes."""
    return F.when((F.length(value) >= CONFLUENT_HEADER) & (F.hex(F.substring(value, 1, 1)) == "00"), F.substring(value, F.lit(CONFLUENT_HEADER + 1), F.length(value)))


def _inflated(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.decompress(x))


def glue_payload(value: Column) -> Column:
    """What follows the header of 18 bytes, inflated if its codec byte says so; null for other bytes."""
    body, codec = F.substring(value, F.lit(GLUE_HEADER + 1), F.length(value)), F.hex(F.substring(value, GLUE_HEADER, 1))
    framed = (F.length(value) >= GLUE_HEADER) & (F.hex(F.substring(value, 1, 1)) == "03")
    packed = F.pandas_udf(_inflated, "binary")(F.when(framed & (codec == "05"), body))  # a batch at a time, and only what is compressed
    return F.when(framed & (codec == "00"), body).when(framed & (codec == "05"), packed)


@dataclass(frozen=True)
class GlueFrame:
    schema: uuid.UUID
    codec: str
    payload: bytes


def parse_glue_frame(data: bytes) -> GlueFrame:
    if len(data) < GLUE_HEADER:
        raise ValueError(f"a frame has at least {GLUE_HEADER} bytes, not {len(data)}")
    if data[0] != GLUE_MAGIC:
        raise ValueError(f"a frame starts with byte {GLUE_MAGIC}, not {data[0]}")
    if data[17] not in GLUE_CODECS:
        raise ValueError(f"unknown codec byte {data[17]}")
    codec = GLUE_CODECS[data[17]]
    return GlueFrame(uuid.UUID(bytes=data[1:17]), codec, zlib.decompress(data[18:]) if codec == "zlib" else data[18:])


def build_glue_frame(schema: uuid.UUID, payload: bytes, codec: str = "none") -> bytes:
    number = {v: k for k, v in GLUE_CODECS.items()}[codec]
    return bytes([GLUE_MAGIC]) + schema.bytes + bytes([number]) + (zlib.compress(payload) if codec == "zlib" else payload)


#: Broker clients by name: (latest() -> offset, fetch(start, end) -> payloads, publish(payloads)).
BROKERS: dict[str, Callable[[dict], tuple[Callable[[], int], Callable[[int, int], Iterator[bytes]], Callable[[list[bytes]], None]]]] = {}


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.make = BROKERS[self.options["broker"]]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"offset": self.make(self.options)[0]()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        size = int(self.options.get("rows_per_task", 10_000))
        return [_Range(i, min(i + size, end["offset"])) for i in range(start["offset"], end["offset"], size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for i, value in enumerate(self.make(self.options)[1](partition.low, partition.high), partition.low):
            yield i, value


class _Writer(DataSourceStreamWriter):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.make = BROKERS[self.options["broker"]]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        publish, held = self.make(self.options)[2], []
        for row in rows:
            held.append(bytes(row["value"]))
            if len(held) >= 1000:
                publish(held)
                held = []
        if held:
            publish(held)
        return WriterCommitMessage()

    def commit(self, messages: list, batch_id: int) -> None:
        pass

    def abort(self, messages: list, batch_id: int) -> None:
        pass


class _TableReader(DataSourceReader):
    """All messages that are there when the table is read."""

    def __init__(self, options: dict) -> None:
        self.stream = _Reader(options)

    def partitions(self) -> list[_Range]:
        return self.stream.partitions(self.stream.initialOffset(), self.stream.latestOffset()) or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from self.stream.read(partition)


class _TableWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.stream = _Writer(options)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        return self.stream.write(rows)


class BrokerSource(DataSource):
    """``format("broker").option("broker", name)``: offset and value of each message."""

    @classmethod
    def name(cls) -> str:
        return "broker"

    def schema(self) -> str:
        return "offset long, value binary"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Writer(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _TableReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TableWriter(self.options)
