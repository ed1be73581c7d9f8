"""Bottom-k sketches of word shingles.

A sketch holds the ``k`` smallest distinct 32-bit hashes of a text's shingles of five
words (a shorter text is one shingle; one without words has an empty sketch).  The
sketch of a union is the bottom of the union of sketches, so sketches of parts merge.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Words, arrow_rows, shingle_sets, slices, text_buffers

K, WIDTH = 128, 5


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct values; only as much is sorted as is likely needed."""
    if len(hashes) > 8 * k:
        low = hashes[hashes < np.uint32(min(2**32 - 1, int(2**32 / len(hashes) * 3 * k)))]
        found = np.unique(low)
        if len(found) >= k:
            return found[:k]
    return np.unique(hashes)[:k]


def sketches(data: np.ndarray, offsets: np.ndarray, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    words = Words(data, offsets)
    return [bottom((s >> np.uint64(32)).astype(np.uint32), k) for s in shingle_sets(words, width)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; exact while both sets fit their sketches, 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    same = both[1:][both[1:] == both[:-1]]
    union = both[np.concatenate([[True], both[1:] != both[:-1]])][:k]
    return float(np.searchsorted(same, union[-1], side="right")) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles, exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2**32)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a`` that is in ``b``; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    r, n, m = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, r / (1 + r) * (n + m) / n)


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """``doc_id``, ``sketch`` (array of long, ascending) and ``shingles`` (estimated number of distinct ones) of every row.

    A null or empty text has an empty sketch and no shingles; repeated rows have one row each;
    ids are passed on, null too; other columns are not read.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = sketches(*text_buffers(batch.column("text")), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int64) for s in made], pa.list_(pa.int64())), pa.array([distinct(s, k) for s in made], pa.float64())], names=["doc_id", "sketch", "shingles"])

    return docs.select(docs["doc_id"].cast("long"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, sketch array<long>, shingles double")


def merged(sketched: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """One sketch for each value of ``keys``, from the sketches of its rows.

    Values are deduplicated before the shuffle, and of each key no more than ``k`` go on.
    Null keys are a key; repeated rows change nothing; a key whose sketches are all empty
    or null has no row.
    """
    values = sketched.select(*keys, F.explode("sketch").alias("_h")).distinct()
    first = values.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).filter(F.col("_n") <= k)
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def _group(bounds: list[int]) -> Column:
    """The range that an id is in: how many bounds are not above it."""
    return F.size(F.filter(F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)


def successors(docs: DataFrame, fn, schema: str, text: str = "text", rows: int = 500, groups: int = 4096) -> DataFrame:
    """Run ``fn`` over (id, text, next text) batches, next by ascending ``doc_id``, after the last the first.

    Ids are cut into ranges at bounds taken from the ids themselves; the row that
    starts a range is sent to the range before it too (the first of all to the last),
    so texts are shuffled once.  Null ids come first; equal ids go by text.
    """
    arrow_rows(docs.sparkSession)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    ids = source.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id")).first()
    n, known, least = ids
    parts = max(1, min(groups, n // rows))
    bounds: list[int] = []
    if parts > 1 and known:
        at = [i / parts for i in range(1, parts)]
        bounds = sorted(set(source.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(20 * parts + 10000))).first()[0]))
    group = F.coalesce(_group(bounds), F.lit(0)) if known == n else F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_group(bounds))
    starts = F.array_contains(F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), F.col("doc_id")) if bounds else F.lit(False)
    first = F.col("doc_id").isNull() if known < n else F.col("doc_id") == F.lit(least)
    own = F.array(F.struct(group.alias("group"), F.lit(0).alias("kind")))
    before = F.when(starts, F.array(F.struct((group - 1).alias("group"), F.lit(1).alias("kind")))).otherwise(F.slice(own, 1, 0))
    wrap = F.when(first, F.array(F.struct(F.lit(len(bounds)).alias("group"), F.lit(2).alias("kind")))).otherwise(F.slice(own, 1, 0))
    dealt = source.withColumn("_to", F.explode(F.concat(own, before, wrap))).select("_to.*", "doc_id", "text")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "kind", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in slices(batches, "text", 2 << 20):
            out: list[tuple] = []
            for group, kind, doc, said in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and at == group:
                    out.append((*held, said))
                held, at = ((doc, said) if kind == 0 else None), group
            if out:
                yield fn(*map(list, zip(*out)))

    return dealt.mapInArrow(run, schema)


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last half replaced by as many first code points of the
    next document.  Null and empty texts have the empty fingerprint; every row has
    one row of output, repeated rows too; other columns are not read.
    """

    def run(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
        own, other, after = (sketches(*text_buffers(pa.array(x, pa.large_string())), k) for x in (texts, edited, following))
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(list(map(to_text, own))),
            pa.array(list(map(to_text, other))),
            pa.array([resemblance(a, b, k) for a, b in zip(own, other)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, after)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return successors(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
