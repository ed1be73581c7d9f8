"""Groups of whole documents, and packed key exchange between them.

Per-word rows cost a shuffle many times the text.  Instead documents are dealt to
groups of a bounded size as compressed Arrow blobs; each group sends one sorted,
delta-coded array of its distinct keys to each range of hashes, and each range
answers a group with as much as it needs to know.  Both sides work on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_rows, mix, release, slices

GROUP_BYTES = 4 << 20
RANGE_KEYS = 1 << 21
#: At most so many binary digits of ranges, as each group sends a row to each range.
RANGE_BITS = 13

_ZSTD = pa.Codec("zstd", compression_level=1)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; reads that column alone."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def group_count(size: int) -> int:
    return max(1, -(-size // GROUP_BYTES))


def range_bits(keys: int) -> int:
    """Binary digits of the number of hash ranges for so many keys."""
    return min(RANGE_BITS, (max(1, keys // RANGE_KEYS) - 1).bit_length())


#: Bytes of text that a task deals at once, so that a blob holds several documents.
DEALT_BYTES = 24 << 20


def dealt(ids: np.ndarray, size: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document, by its id and length alone."""
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def pack(docs: DataFrame, groups: int, text: str = "text", bounds: list[int] = []) -> DataFrame:
    """Rows (``grp``, ``blob``): documents dealt by id and length, in compressed Arrow streams.

    With ``bounds``, ids from one bound to the next are a batch, which has groups of its own
    (batch times ``groups`` and on); an id that is null is in the last one.
    """
    arrow_rows(docs.sparkSession)
    schema = docs.schema
    at = schema.fieldNames().index("doc_id")
    edges = np.array(bounds, dtype=np.int64)

    def blobs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        table = pa.Table.from_batches(batches)
        size = pa.compute.fill_null(pa.compute.binary_length(table.column(text)), 0).cast(pa.int64()).to_numpy()
        ids = ids_of(table)
        to = dealt(ids, size, groups) + np.searchsorted(edges, ids, side="right") * groups
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        names, made = [], []
        for low, high in zip(cuts, [*cuts[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.take(pa.array(order[low:high])).combine_chunks())
            names.append(int(to[order[low]]))
            made.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(made, pa.binary())], names=["grp", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in slices(batches, text, 8 << 20):
            held.append(batch)
            n += batch.nbytes
            if n >= DEALT_BYTES:
                yield blobs(held)
                held, n = [], 0
        if held:
            yield blobs(held)
        del held
        release()

    return docs.mapInArrow(run, "grp long, blob binary")


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Bounds of ``doc_id`` that cut the rows into about equal batches; fewer where ids repeat."""
    at = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(docs["doc_id"].cast("long"), F.array(*map(F.lit, at)), F.lit(10000))).first()[0] if at else None
    return sorted(set(found or []))


def released(make):
    """A function of a group that gives its memory back before the next group comes."""

    def run(*tables: pa.Table) -> pa.Table:
        out = make(*tables)
        del tables
        release()
        return out

    if make.__code__.co_argcount == 2:
        return lambda a, b: run(a, b)
    return lambda a: run(a)


def unpack(rows: pa.Table) -> pa.Table:
    """The documents of a group's blobs, by ascending ``doc_id``, null last."""
    table = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in rows.column("blob")])
    ids = table.column("doc_id")
    key = pa.compute.fill_null(ids.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()
    # ties by length and text, so that the order never depends on how blobs arrived
    size = pa.compute.fill_null(pa.compute.binary_length(table.column("text")), -1).cast(pa.int64()).to_numpy()
    order = np.lexsort((size, key))
    same = (np.diff(key[order]) == 0) & (np.diff(size[order]) == 0)
    if same.any():
        texts = table.column("text").to_pylist()
        order = np.array(sorted(range(len(key)), key=lambda i: (key[i], size[i], texts[i] or "")))
    return table.take(pa.array(order))


def ids_of(table: pa.Table) -> np.ndarray:
    return pa.compute.fill_null(table.column("doc_id").cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()


def code(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte by byte position, compressed; the first must be sorted and is delta-coded."""
    first = arrays[0].astype(np.uint64)
    deltas = np.diff(first, prepend=np.uint64(0))
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in (deltas, *arrays[1:])]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def decode(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little")), dtype=np.uint8)
    out, at = [], 0
    for kind in (np.uint64, *kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    with np.errstate(over="ignore"):
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def range_cuts_of(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ascending ``parts``, and where each begins; the last place is the end."""
    cuts = np.flatnonzero(np.diff(parts, prepend=-1))
    return parts[cuts], np.append(cuts, len(parts))


def range_cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which ranges sorted keys fall in, and where each begins; the last place is the end."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    return part[cuts], np.concatenate([cuts, [len(keys)]])
