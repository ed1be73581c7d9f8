"""Removal of passages that an earlier document has, by an index of window hashes.

The index is log-structured: immutable runs of (hash, check bits, smallest doc_id),
sorted by hash, cut into hash ranges and stored in a table that is bucketed by range, so
that a run is never shuffled again.  Documents come in batches by ascending ``doc_id``.
Groups of a batch send the sorted hashes of their windows to the ranges; each range
merge-joins them with its runs, tells each group which of its windows begin in a smaller
document and in which one, and adds what is new as one more run.  Runs beyond ``RUNS``
are compacted into one.

A match is then verified by its words: consecutive matches in one document form a
passage, which is looked for, word by word, in the document that is said to have it.  If
any is not there, two hashes have clashed, and all is done anew with 128 bits of hash.
Equal words have equal hashes, so nothing is missed either way.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import groups
from quern.llm.common import CLEAN, SMALL_PAGES, Words, configured, delete, drop, keep, settle, shared_dir, text_buffers

WINDOW = 13
#: Batches that documents are cut into, and runs that the index may have before they are compacted.
BATCHES, RUNS = 3, 1
#: Times as many ranges as elsewhere, so that a run's rows stay below half a megabyte, which the JVM's collector handles well.
RANGES = 8
#: Bytes of text that a task packs.
TASK_BYTES = 64 << 20

_ENTRIES = "bucket long, grp long, n long, data binary"
#: Answers to groups have ``bits`` and ``sources``, runs have ``run`` and a negative ``grp``; answers to batch b are under the number -1 - b, so that runs can go without them.
_STORED = "bucket long, grp long, n long, hits long, bits binary, sources binary, run binary"
#: Kinds of what a group finds: where repeats begin, passages to verify, and its documents.
_BEGINS, _PASSAGE, _MEMBERS = 0, 1, 2
Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def check_bytes(windows: int) -> int:
    """Bytes of a second hash beside the 64 bits of the first, so that a clash among so many windows has odds of about 1 to 65,536."""
    return min(8, max(1, -(-(2 * max(1, windows).bit_length() + 16 - 64) // 8)))


def _order(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key and check, and which rows in it begin a new pair."""
    order = np.argsort(key)  # not stable, but several times as fast; rows of one key are put in order after it
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    tied = ~new
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    order[at] = order[at][np.lexsort((order[at], k[at]))]
    c = check[order]
    if (c[1:] != c[:-1])[~new[1:]].any():  # hashes that clash stand side by side
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new


class _Windows:
    """Windows of a group's documents and the first of each distinct one, by hash."""

    def __init__(self, table: pa.Table, width: int, check: int) -> None:
        self.ids = groups.ids_of(table)
        self.words = Words(*text_buffers(table.column("text")))
        key, ok = self.words.windows(self.words.hashes(0), width, 0)
        second, _ = self.words.windows(self.words.hashes(1), width, 1)
        self.at = np.flatnonzero(ok)
        key, second = key[self.at], second[self.at] >> np.uint64(64 - 8 * check)
        order, new = _order(key, second)  # of equal windows, that of the smallest doc_id comes first
        self.at, key, second = self.at[order], key[order], second[order]
        self.entry = np.cumsum(new) - 1  # of each window, its place among the distinct ones
        self.key, self.check = key[new], second[new]
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.words.first))[self.at]
        self.doc_id = self.ids[self.doc]
        self.least = self.doc_id[new]


def _coded(run: Run, check: int) -> bytes:
    return groups.code(run[0], run[1], *(((run[2] >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8) for i in range(check)))


def _decoded(data: bytes, n: int, check: int) -> Run:
    key, least, *planes = groups.decode(data, n, np.int64, *[np.uint8] * check)
    second = np.zeros(n, dtype=np.uint64)
    for i, plane in enumerate(planes):
        second |= plane.astype(np.uint64) << np.uint64(8 * i)
    return key, least, second


_NONE: Run = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def _compacted(runs: list[Run]) -> tuple[Run, np.ndarray]:
    """One sorted run with the smallest doc_id of each (hash, check), and where each entry of the runs went."""
    key, least, check = (np.concatenate(x) for x in zip(_NONE, *runs))
    order, new = _order(key, check)
    first = np.flatnonzero(new)
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return (key[order[first]], np.minimum.reduceat(least[order], first) if len(first) else least, check[order[first]]), where


def _looked_up(run: Run, asked: Run) -> np.ndarray:
    """The smallest doc_id that a run has for each entry asked, itself sorted; the largest number where it has none."""
    key, least, check = run
    none = np.iinfo(np.int64).max
    if not len(key):
        return np.full(len(asked[0]), none)
    at = np.minimum(np.searchsorted(key, asked[0]), len(key) - 1)
    same = (key[at] == asked[0]) & (check[at] == asked[2])
    out = np.where(same, least[at], none)
    for i in np.flatnonzero((key[at] == asked[0]) & ~same):
        j = at[i]
        while j < len(key) and key[j] == asked[0][i]:
            if check[j] == asked[2][i]:
                out[i] = least[j]
            j += 1
    return out


def _entries(packed: DataFrame, bits: int, width: int, check: int) -> DataFrame:
    def make(rows: pa.Table) -> pa.Table:
        grp, w = rows.column("grp")[0].as_py(), _Windows(groups.unpack(rows), width, check)
        part, cuts = groups.range_cuts(w.key, bits)
        made = [_coded((w.key[a:b], w.least[a:b], w.check[a:b]), check) for a, b in zip(cuts, cuts[1:])]
        return pa.table([pa.array(part, pa.int64()), pa.array([grp] * len(part), pa.int64()), pa.array(np.diff(cuts)[: len(part)], pa.int64()), pa.array(made, pa.binary())], names=["bucket", "grp", "n", "data"])

    return packed.groupBy("grp").applyInArrow(groups.released(make), _ENTRIES)


def _stored(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["bucket", "grp", "n", "hits", "bits", "sources", "run"])


def _joined(history: DataFrame, entries: DataFrame, check: int, keep_run: bool) -> DataFrame:
    """Of each range the answers to its groups and, if it is to be kept, the run of what the batch adds to history."""

    def make(old: pa.Table, rows: pa.Table) -> pa.Table:
        made: list[tuple] = []
        if rows.num_rows:
            bucket = rows.column("bucket")[0].as_py()
            asked = [_decoded(d.as_py(), n, check) for d, n in zip(rows.column("data"), rows.column("n").to_pylist())]
            batch, where = _compacted(asked)
            before = np.full(len(batch[0]), np.iinfo(np.int64).max)
            for d, n in zip(old.column("run"), old.column("n").to_pylist()):
                before = np.minimum(before, _looked_up(_decoded(d.as_py(), n, check), batch))
            least, at = np.minimum(before, batch[1]), 0
            for one, grp in zip(asked, rows.column("grp").to_pylist()):
                source = least[where[at : at + len(one[0])]]
                at += len(one[0])
                hit = source < one[1]
                said = source[hit]
                made.append((bucket, grp, len(hit), len(said), np.packbits(hit).tobytes(), groups.code(np.zeros(len(said), dtype=np.uint64), said), None))
            more = batch[1] < before
            if keep_run:
                made.append((bucket, -1, int(more.sum()), 0, None, None, _coded(tuple(x[more] for x in batch), check)))
        return _stored(made)

    return history.groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInArrow(groups.released(make), _STORED)


def _joined_words(words: Words, low: int, high: int) -> bytes:
    return b" ".join(words.data[words.starts[low] : words.ends[high - 1]].tobytes().split())


def _passages(w: _Windows, begins: np.ndarray, doc: np.ndarray, source: np.ndarray, width: int) -> dict[tuple[int, bytes], bytes]:
    """Runs of windows of one document that one source has, as text, by source and digest."""
    order = np.argsort(begins, kind="stable")
    begins, doc, source = begins[order], doc[order], source[order]
    new = np.ones(len(begins), dtype=bool)
    new[1:] = (begins[1:] != begins[:-1] + 1) | (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begins)) - 1
    made = {}
    for a, b in zip(first.tolist(), last.tolist()):
        said = _joined_words(w.words, int(begins[a]), int(begins[b]) + width)
        made[int(source[a]), hashlib.blake2b(said, digest_size=16).digest()] = said
    return made


def _found(packed: DataFrame, answers: DataFrame, width: int, check: int) -> DataFrame:
    """For each group the words at which a repeat begins, the passages to verify, and its documents' ids."""
    schema = "kind int, grp long, n long, places binary, source long, digest binary, passage binary"

    def make(rows: pa.Table, said: pa.Table) -> pa.Table:
        grp = rows.column("grp")[0].as_py()
        w = _Windows(groups.unpack(rows), width, check)
        source = [np.zeros(0, dtype=np.int64)]
        for _, bits, n, hits, more in sorted(zip(*(said.column(c).to_pylist() for c in ("bucket", "bits", "n", "hits", "sources")))):
            hit = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n).astype(bool)
            part = np.full(n, np.iinfo(np.int64).max)
            part[hit] = groups.decode(more, hits, np.int64)[1]
            source.append(part)
        least = np.concatenate(source)
        if len(least) != len(w.key):
            raise ValueError(f"{len(least)} answers for {len(w.key)} windows")
        # what no other group has in a smaller document, this one may have
        least = np.minimum(least, w.least)[w.entry] if len(w.at) else w.least
        hit = least < w.doc_id
        begins = np.sort(w.at[hit])
        made: list[tuple] = [(_BEGINS, grp, len(begins), groups.code(begins.astype(np.uint64)), None, None, None)]
        ids = np.unique(w.ids)
        made.append((_MEMBERS, grp, len(ids), groups.code(ids.astype(np.uint64)), None, None, None))
        made += [(_PASSAGE, grp, 0, None, of, digest, text) for (of, digest), text in _passages(w, w.at[hit], w.doc[hit], least[hit], width).items()]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["kind", "grp", "n", "places", "source", "digest", "passage"])

    return packed.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(groups.released(make), schema)


def _holds(texts: list[bytes], passage: bytes, width: int) -> bool:
    """Whether texts hold a passage, or as its windows may stand at several places, each of its windows."""
    if any(b" " + passage + b" " in whole for whole in texts):
        return True
    words = passage.split()
    windows = (b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1)))
    return all(any(w in whole for whole in texts) for w in windows)


def _unverified(packed: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """Passages (``source``, ``digest``) that no row of the document said to have them holds word by word."""

    def listed(batches):
        for batch in batches:
            for grp, n, data in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "places"))):
                ids = groups.decode(data, n)[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), grp))], names=["source", "grp"])

    passages = found.filter(f"kind = {_PASSAGE}").select("source", "digest", "passage").dropDuplicates(["source", "digest"])
    members = found.filter(f"kind = {_MEMBERS}").select("grp", "n", "places").mapInArrow(listed, "source long, grp long")
    asked = passages.join(members, "source")

    def make(rows: pa.Table, said: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.binary(), pa.bool_())
        made: list[tuple] = []
        if said.num_rows:
            table = groups.unpack(rows)
            ids, texts = groups.ids_of(table), table.column("text")
            wanted: dict[int, list[bytes]] = {}
            for i in np.flatnonzero(np.isin(ids, said.column("source").to_numpy())).tolist():
                wanted.setdefault(int(ids[i]), []).append(b" " + b" ".join((texts[i].as_py() or "").encode().split()) + b" ")
            for source, digest, text in zip(*(said.column(c).to_pylist() for c in ("source", "digest", "passage"))):
                made.append((source, digest, _holds(wanted.get(source, []), text, width)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*made) if made else [()] * 3, kinds)], names=["source", "digest", "there"])

    looked = packed.groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(groups.released(make), "source long, digest binary, there boolean")
    return looked.groupBy("source", "digest").agg(F.max("there").alias("there")).filter("NOT there")


def _kept(words: Words, gone: np.ndarray) -> pa.Array:
    """The words of each text that stay, joined by one space."""
    stay = ~gone
    starts, size = words.starts[stay], (words.ends - words.starts)[stay] + 1
    ends = np.cumsum(size)
    source = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - starts, size)
    data = np.append(words.data, np.uint8(0x20))[source]
    data[ends - 1] = 0x20
    count = np.concatenate([[0], np.cumsum(stay)])[words.first]
    places = np.concatenate([[0], ends])[count]
    raw = data.tobytes()
    return pa.array([raw[a : b - 1] if b > a else b"" for a, b in zip(places, places[1:])], pa.binary()).cast(pa.string())


def _applied(packed: DataFrame, found: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    schema = docs.schema.add("kept", "string").add("n_words", "long").add("n_removed", "long")

    def make(rows: pa.Table, said: pa.Table) -> pa.Table:
        table = groups.unpack(rows)
        words = Words(*text_buffers(table.column("text")))
        begins = groups.decode(said.column("places")[0].as_py(), said.column("n")[0].as_py())[0].astype(np.int64)
        cover = np.zeros(len(words) + width, dtype=np.int64)
        np.add.at(cover, begins, 1)
        np.add.at(cover, begins + width, -1)
        gone = np.cumsum(cover)[: len(words)] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
        return table.append_column("kept", _kept(words, gone)).append_column("n_words", pa.array(np.diff(words.first), pa.int64())).append_column("n_removed", pa.array(np.diff(removed), pa.int64()))

    begins = found.filter(f"kind = {_BEGINS}").select("grp", "n", "places")
    return packed.groupBy("grp").cogroup(begins.groupBy("grp")).applyInArrow(groups.released(make), schema)


def remove_repeats(docs: DataFrame, index: SubstringIndex | None = None, width: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """Remove each word covered by a window that also begins in a document with a smaller ``doc_id``.

    Windows are ``width`` words in a row of one document, judged on the input.  Returns
    all columns of ``docs`` (``doc_id`` and ``text`` among them) and ``kept`` (the
    words that stay, joined by one space), ``n_words`` and ``n_removed``; columns that
    have these names already come back as ``kept_in`` and so on.  Null and empty texts
    have no words and an empty ``kept``.  A null id is larger than any; rows with equal
    ids never remove each other's words.  An empty table gives an empty one.  With an
    ``index``, documents of earlier calls count too, and these are added to it; what
    earlier calls had is compared by the index's hashes, as their texts are not here.
    """
    clash = {"kept", "n_words", "n_removed"} & set(docs.columns)
    if clash:
        docs = docs.withColumnsRenamed({c: f"{c}_in" for c in clash})
    spark = docs.sparkSession
    size = groups.text_bytes(docs)
    bounds = groups.batch_bounds(docs, batches)
    per_batch = groups.group_count(-(-size // (len(bounds) + 1)))
    tasks = max(1, -(-size // TASK_BYTES))
    packed = keep(groups.pack(docs.coalesce(tasks), per_batch, bounds=bounds).sortWithinPartitions("grp"), "packed")
    settle(spark)
    for check in (index.check,) if index is not None else (check_bytes(size // 6), 8):
        own = index or SubstringIndex(spark, f"{shared_dir(spark)}/quern-index-{uuid.uuid4().hex}", groups.range_bits(RANGES * (size // 6)), check)
        known, answers = own.runs() > 0, None
        for k in range(len(bounds) + 1):
            batch = packed.filter(f"grp >= {k * per_batch} AND grp < {(k + 1) * per_batch}")
            # after the last batch nothing asks an index that is made for this call alone
            said = own.add(_entries(batch, own.bits, width, check), index is not None or k < len(bounds))
            answers = said if answers is None else answers.unionByName(said)
            if k < len(bounds) or index is not None:
                own.compact()
            settle(spark)
        if index is None:
            own.forget_merged()
        found = keep(_found(packed, answers, width, check).coalesce(tasks), "found")
        own.clean() if index is not None else own.remove()
        settle(spark)
        with configured(spark, CLEAN):
            wrong = 0 if known else _unverified(packed, found, width).limit(1).count()
        if not wrong:
            return _applied(packed, found, docs, width)
        drop(found)
    raise RuntimeError("documents have passages of different words with equal hashes of 128 bits")


class SubstringIndex:
    """Runs of window hashes under a folder; batches are added by ``remove_repeats``.

    ``bits`` fixes the number of hash ranges and ``check`` the bytes of the second hash when
    the index is made; use the same ever after.  Each generation is a bucketed table in
    a folder of its own, and compaction writes the next one, so a job that fails leaves the
    generation before as it was; runs that it has merged are deleted when it has ended.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 6, check: int = 4) -> None:
        self.spark, self.path, self.bits, self.check = spark, path.rstrip("/"), bits, check
        self.merged = -1  # the batch under which compaction has stored the merged run, and nothing else
        self.last = -1  # the number of the latest batch, though it had no entries
        self.buckets = 1 << max(bits - 4, min(bits, 3))
        self.generation = max((int(p.rsplit("-", 1)[1]) for p in self._folders()), default=0)
        self._open()

    def _folders(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # a generation that was not written to its end has no mark of success
        return [s.getPath().toString() for s in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(where) else []

    def _name(self, generation: int) -> str:
        return f"quern_index_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{generation}"

    def _open(self) -> None:
        columns = f"{_STORED}, batch int"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(self.generation)} ({columns}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{self.path}/gen-{self.generation}'")

    def _write(self, rows: DataFrame, batch: int, generation: int) -> None:
        with configured(self.spark, CLEAN):
            out = rows.withColumn("batch", F.when(F.col("grp") < 0, batch).otherwise(-1 - batch)).write.format("parquet").options(compression="uncompressed", **SMALL_PAGES)
            out.partitionBy("batch").bucketBy(self.buckets, "bucket").mode("append").option("path", f"{self.path}/gen-{generation}").saveAsTable(self._name(generation))

    def _table(self) -> DataFrame:
        return self.spark.table(self._name(self.generation))

    def _history(self) -> DataFrame:
        return self._table().filter("batch >= 0 AND grp < 0").select("bucket", "n", "run")

    def _latest(self) -> int:
        return self._table().agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def _batches(self) -> list[int]:
        """The batches under which runs are stored."""
        return [r.batch for r in self._table().filter("batch >= 0").select("batch").distinct().collect()]

    def runs(self) -> int:
        """How many runs there are."""
        return len(self._batches())

    def add(self, entries: DataFrame, keep_run: bool = True) -> DataFrame:
        """Merge a batch's entries with all runs, keep what is new as one more, and give the answers to its groups."""
        self.last = batch = max(self._latest(), self.last) + 1
        self._write(_joined(self._history(), entries, self.check, keep_run), batch, self.generation)
        return self._table().filter(f"batch = {-1 - batch} AND grp >= 0").select("bucket", "grp", "n", "hits", "bits", "sources")

    def compact(self, most: int = RUNS) -> None:
        """Merge all runs into one if there are more than ``most``.  These go then; answers of before stay in the old generation until ``clean``."""
        batches = self._batches()
        if len(batches) <= most:
            return
        check = self.check

        def merged(rows: pa.Table) -> pa.Table:
            run, _ = _compacted([_decoded(d.as_py(), n, check) for d, n in zip(rows.column("run"), rows.column("n").to_pylist())])
            return _stored([(rows.column("bucket")[0].as_py(), -1, len(run[0]), 0, None, None, _coded(run, check))])

        old, last = self.generation, self._latest()
        self._write(self._history().groupBy("bucket").applyInArrow(groups.released(merged), _STORED), last, old + 1)
        self.generation, self.merged = old + 1, last
        for batch in batches:
            self._forget_run(old, batch)

    def _forget_run(self, generation: int, batch: int) -> None:
        self.spark.sql(f"ALTER TABLE {self._name(generation)} DROP IF EXISTS PARTITION (batch = {batch})")
        delete(self.spark, f"{self.path}/gen-{generation}/batch={batch}")

    def forget_merged(self) -> None:
        """Delete the merged run, when nothing will ask the index any more; answers to groups stay."""
        if self.merged >= 0:
            self._forget_run(self.generation, self.merged)

    def clean(self) -> None:
        """Delete generations before this one, when nothing is to be read from them any more."""
        for path in self._folders():
            if (number := int(path.rsplit("-", 1)[1])) < self.generation:
                self._forget(number)

    def _forget(self, generation: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(generation)}")
        delete(self.spark, f"{self.path}/gen-{generation}")

    def remove(self) -> None:
        """Delete the index."""
        self.clean()
        self._forget(self.generation)
        delete(self.spark, self.path)
