"""Shared pieces: Arrow text access, vectorised word hashing, scratch tables.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  Hashing is done
on UTF-8 bytes with numpy; a Python object is made for words of over eight bytes only.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a pattern for Java, Python and DuckDB.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries have no such function
    _TRIM = None


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` well mixed 64-bit values; the same on every machine and version."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which every bit depends on every other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class Words:
    """The words of a batch of texts: byte ranges, and the first word of each text.

    ``first[i]:first[i + 1]`` are the words of text ``i``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self._digests: np.ndarray | None = None
        n = len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(n, dtype=bool)
        after = np.ones(n, dtype=bool)
        if n:
            before[1:] = ~word[:-1] | edge[1:n]
            after[:-1] = ~word[1:] | edge[1:n]
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; the two lanes (0 and 1) are independent.

        Words of up to eight bytes are told apart for certain: their bytes and number go
        through a bijection.  Longer ones have a half of a keyed 128-bit BLAKE2b digest.
        """
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        at_each_byte = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        short = np.minimum(size, 8)
        out = mix(mix((at_each_byte[self.starts] & _MASKS[short]) ^ _SIZE_KEYS[lane][short]) + _LANE_KEYS[lane])
        if self._digests is None:
            raw = self.data.tobytes()
            self._long = np.flatnonzero(size > 8)
            found = zip(self.starts[self._long].tolist(), self.ends[self._long].tolist())
            made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16, key=_DIGEST_KEY).digest() for a, b in found])
            self._digests = np.frombuffer(made, dtype="<u8").reshape(-1, 2)
        out[self._long] = self._digests[:, lane]
        return out

    def windows(self, hashes: np.ndarray, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` words of one text, by first word, and which words begin one."""
        n = len(hashes) - width + 1
        ok = np.zeros(len(hashes), dtype=bool)
        if n <= 0:
            return np.zeros(len(hashes), dtype=np.uint64), ok
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(hashes))
        ok[:] = left >= width
        factors = _factors(width, lane)
        out = np.zeros(len(hashes), dtype=np.uint64)
        total = out[:n]
        with np.errstate(over="ignore"):
            for j in range(width):
                total += hashes[j : j + n] * factors[j]
        out[:n] = mix(total)
        return out, ok


_SIZE_KEYS = [splitmix(9, 5), splitmix(9, 6)]
_LANE_KEYS = splitmix(2, 7)
_DIGEST_KEY = splitmix(2, 8).tobytes()


def _factors(width: int, lane: int) -> np.ndarray:
    """An odd factor for each place of a window: no two places share one, so no pattern of words cancels out."""
    return splitmix(width, 9 + lane) | np.uint64(1)


def shingle_sets(words: Words, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its shingle hashes by place, repeats included.

    A text of fewer words than ``width`` has all its words as its one shingle; a text
    without words has none.
    """
    hashes = words.hashes()
    made, _ = words.windows(hashes, width)
    for low, high in zip(words.first[:-1], words.first[1:]):
        if high - low >= width:
            yield made[low : high - width + 1]
        elif high > low:
            with np.errstate(over="ignore"):
                total = (hashes[low:high] * _factors(width, 0)[: high - low]).sum(dtype=np.uint64) + splitmix(width, 11)[high - low]
            yield mix(np.array([total], dtype=np.uint64))
        else:
            yield made[:0]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, places, data = array.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.concatenate([[0], np.cumsum(sizes)]) // most
        cuts = [0, *(np.flatnonzero(np.diff(part[:-1])) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def release() -> None:
    """Give memory that is free in this Python worker back to the machine; Spark keeps workers for later tasks.

    What lives at the first call, which is mostly modules, is not looked through again: that took
    longer than the work on a small group.
    """
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def settle(spark: SparkSession) -> None:
    """Give memory that is free in the executors' JVMs back to their machines; a heap grows with garbage and shrinks when it is collected."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


#: Rows of an Arrow batch, for tables that hold long texts.
ARROW_ROWS = 1000


def arrow_rows(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches by one figure for all operators, so that none changes another's memory.

    Batches are sized when a frame runs, not when it is made, so the bound stays; a smaller one of the session is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


@contextlib.contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with other settings, and afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files of a job that writes a table go when it has ended; a lost executor's are made again while it runs.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Writers look at the sizes of pages and row groups after a few rows, as a row may hold megabytes.
SMALL_PAGES = {"parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "64", "parquet.block.size.row.check.min": "4", "parquet.block.size.row.check.max": "64", "parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, named by the session's ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine gets a folder of its own, as in tests;
    on a cluster that is an error, as executors cannot see each other's folders.
    """
    name = "spark.checkpoint.dir"
    where = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{name} is not set; a cluster needs a folder that all its machines share")
        where = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set(name, where)
    return where.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    with configured(spark, CLEAN):
        df.write.options(**SMALL_PAGES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing needs any more."""
    for df in kept:
        delete(df.sparkSession, df._quern_path)
        _MADE[:] = [x for x in _MADE if x[1] != df._quern_path]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_end() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            try:
                delete(spark, path)
            except Exception:  # the session may be gone already
                return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sample(df: DataFrame, n: int, total: int, key: str, *more: str) -> DataFrame:
    """At most ``n`` of ``total`` rows, those of the smallest hashes of ``key``; ties by ``more``.

    A threshold leaves about a third more rows than that before they are put in order,
    so what meets in one place is bounded by ``n``, not by the number of partitions.
    """
    low = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 40))
    if total > 2 * n:
        df = df.filter(low < F.lit(int((1 << 40) * (1.3 * n + 60) / total)))
    return df.orderBy(low, key, *more).limit(n)


def crc_mod(column: str, n: int):
    """crc32 of the decimal text of a column, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
