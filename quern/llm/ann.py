"""Nearest neighbours by inner product, as a block matrix join.

Vectors are packed into blocks and quantised to int8 with one scale each.  A grid of
query and candidate groups of bounded size is joined, and only int8 tiles are sent there:
the int8 product gives every inner product up to a bound from the lengths of the
quantisation errors.  A pair whose upper bound does not reach the query's k-th best lower
bound is out, first by the bounds of its tile, then by the best bar of all tiles.  The
vectors of pairs that survive are fetched once, their products computed in double precision
in the order of the components, and merged by a heap for each query.  Nothing is
approximated away: a pair is dropped only where the bounds prove it.

Equal rows count once.  Of candidates with equal vectors the ``k + 1`` smallest ids take
part, as ties go to the smaller id and one of them may be the query's own; so a vector that
many rows share makes no more pairs than any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_rows, keep, mix

BLOCK = 1024
#: Query rows of a tile, and bytes of int8 candidates of one, at most; parts that smaller tables are cut into nevertheless.
QUERY_ROWS, CANDIDATE_BYTES = 8192, 16 << 20
LEAST_PARTS = 24

_BLOCKS = "query boolean, dim int, n int, place long, ids binary, small binary, bounds binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 vectors, and by row their scale, length, length as quantised, and the error's length."""
    scale = np.abs(x).max(1) / 127
    small = np.rint(x / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    length = lambda a: np.sqrt((a * a).sum(1)) * (1 + 1e-12)
    return small, np.stack([scale, length(x), length(back), length(x - back)])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _blocks(vectors: DataFrame) -> DataFrame:
    def packed(query: bool, ids: np.ndarray, x: np.ndarray) -> tuple:
        small, bounds = quantise(x)
        place = int(mix(ids[:1].astype(np.uint64) + np.uint64(query))[0] >> np.uint64(1))
        return query, x.shape[1], len(ids), place, ids.tobytes(), small.tobytes(), bounds.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], list] = {}

        def out(key: tuple[bool, int], rows: list) -> pa.RecordBatch:
            made = packed(key[0], np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, (pa.bool_(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=["query", "dim", "n", "place", "ids", "small", "bounds"])

        for batch in batches:
            lists = batch.column(1)
            size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
                for query in (False, True):
                    pick = np.flatnonzero(asked[at] == query)
                    key = (query, int(dim))
                    for low in range(0, len(pick), BLOCK):
                        some = pick[low : low + BLOCK]
                        rows = held.setdefault(key, [])
                        rows.append((ids[at[some]], x[some]))
                        if sum(len(r[0]) for r in rows) >= BLOCK:
                            yield out(key, held.pop(key))
        for key, rows in held.items():
            yield out(key, rows)

    return vectors.mapInArrow(run, _BLOCKS)


def _search(k: int):
    """Of a tile the pairs that may be among a query's ``k`` best, with their upper bounds and the query's bar."""

    def best(rows: pa.Table) -> pa.Table:
        blocks: dict[bool, list] = {True: [], False: []}
        for r in rows.select(["query", "dim", "n", "ids", "small", "bounds"]).to_pylist():
            blocks[r["query"]].append((np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["small"], dtype=np.int8).reshape(r["n"], r["dim"]), np.frombuffer(r["bounds"]).reshape(4, -1)))
        made: list[tuple] = []
        # sums of products of int8 values are whole numbers, exact in float32 up to 2**24
        kind = np.float32 if rows.column("dim")[0].as_py() * 127 * 127 < 1 << 24 else np.float64
        for ids, small, (scale, length, _, error) in blocks[True]:
            lows = np.full((len(ids), k), -np.inf)
            found: list[tuple] = []
            left = small.astype(kind)
            for c_ids, c_small, (c_scale, _, c_back, c_error) in blocks[False]:
                about = (left @ c_small.astype(kind).T).astype(np.float64)
                about *= scale[:, None]
                about *= c_scale[None, :]
                slack = (length[:, None] * c_error[None, :] + error[:, None] * c_back[None, :]) * (1 + 1e-9) + 1e-12 * length[:, None] * c_back[None, :]
                own = ids[:, None] == c_ids[None, :]
                low = np.where(own, -np.inf, about - slack)
                both = np.concatenate([lows, low], axis=1)
                lows = np.partition(both, -k, axis=1)[:, -k:]
                about += slack
                at, to = np.nonzero((about >= lows.min(1)[:, None]) & ~own)
                found.append((at, c_ids[to], about[at, to]))
            if found:
                at, to, high = (np.concatenate(x) for x in zip(*found))
                bar = lows.min(1)[at]
                may = high >= bar
                made.append((ids[at[may]], to[may], high[may], bar[may]))
        columns = [np.concatenate(x) for x in zip(*made)] if made else [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["query_id", "vec_id", "high", "bar"])

    return best


def _merged(k: int):
    """The ``k`` best of each query, from rows (query, its vector, candidate, its vector) sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heap = None, []

        def out() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            return pa.RecordBatch.from_arrays([pa.array([at] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-c for _, c in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(i).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (1, 3))
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            scores = np.empty(batch.num_rows)
            start = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                place = start[rows][:, None] + np.arange(dim)
                scores[rows] = exact(x[place], y[place])
            for query, item in zip(batch.column(0).to_pylist(), zip(scores.tolist(), (-batch.column(2).to_numpy()).tolist())):
                if query != at:
                    if heap:
                        yield out()
                    at, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        if heap:
            yield out()

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each row for which ``queries`` holds.

    Returns ``query_id``, ``rank`` (int, from 1), ``vec_id`` and ``score``, ties to the
    smaller id; fewer rows where fewer candidates are.  Null ids, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part; vectors of
    other lengths than a query's are no candidates for it.  A row is no candidate for
    a query of its own id; equal rows count once, rows of one id with other vectors each;
    queries of one id are one query with several vectors.  Other columns are not read.
    """
    arrow_rows(vectors.sparkSession)
    given = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector].alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    fit = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0)  # NaN is above infinity
    source = keep(given.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fit).distinct(), "vectors")
    asked = source.filter("asked").select("id", "v", F.lit(True).alias("asked"))
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    candidates = keep(source.select("id", "v").withColumn("_n", least).filter(F.col("_n") <= k + 1).select("id", "v", F.lit(False).alias("asked")), "candidates")
    blocks = keep(_blocks(asked.unionByName(candidates)), "blocks")
    # a row for each length of vectors
    sizes = blocks.groupBy("query", "dim").agg(F.sum("n").alias("n")).collect()
    rows = max([1, *(max(-(-r["n"] // QUERY_ROWS), min(LEAST_PARTS, -(-r["n"] // BLOCK))) for r in sizes if r["query"])])
    columns = max([1, *(max(-(-r["n"] * r["dim"] // CANDIDATE_BYTES), min(LEAST_PARTS // min(rows, LEAST_PARTS), -(-r["n"] // BLOCK))) for r in sizes if not r["query"])])
    mine = F.when(F.col("query"), F.pmod(F.col("place"), F.lit(rows))).otherwise(F.pmod(F.col("place"), F.lit(columns))).cast("long")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.lit(columns - 1)).otherwise(F.lit(rows - 1)).cast("long")))
    dealt = blocks.withColumn("mine", mine).withColumn("other", others)
    dealt = dealt.withColumns({"a": F.when(F.col("query"), F.col("mine")).otherwise(F.col("other")), "b": F.when(F.col("query"), F.col("other")).otherwise(F.col("mine"))})
    possible = dealt.groupBy("dim", "a", "b").applyInArrow(_search(k), "query_id long, vec_id long, high double, bar double")
    bar = F.max("bar").over(Window.partitionBy("query_id"))
    left = possible.withColumn("bar", bar).filter("high >= bar").select("query_id", "vec_id").distinct()
    fetched = left.join(candidates.select(F.col("id").alias("vec_id"), F.col("v").alias("b")), "vec_id")
    both = fetched.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id").filter(F.size("a") == F.size("b"))
    ready = both.select("query_id", "a", "vec_id", "b").repartition("query_id").sortWithinPartitions("query_id")
    return ready.mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")
