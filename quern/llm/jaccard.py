"""Join of texts by the Jaccard likeness of their word shingles, by chosen paths.

Equal shingle sets form a class and are handled once.  In each of ``RUNS`` runs a set
takes every token whose hash falls below ``BRANCH / size``: the same tokens in all
sets that hold them and are of its size, so alike sets share some.  Sets that took one
token form a bucket.  A bucket of more than ``SMALL`` sets is split by further tokens, taken
by a hash of the path so far, again and again down to ``DEPTH`` tokens; one whose parts
would be more work than itself, as in a group of near copies that share most tokens, is left
whole.  Buckets are compared all with all, in tiles of ``TILE`` sets by as many where they
are larger: sets by sketches of 512 bits first, and those that may be alike by their whole
shingle sets.  A pair belongs to the smallest bucket that both sets are in, so no pair counts
twice and no list of pairs is made.

Two sets of likeness 0.8 share at least 1.6 expected tokens at each step of a path (at
1.6 the smaller set is part of the larger), so the number of paths that they share is a
branching process.  It survives any number of steps with the probability that solves
q = 1 - exp(-1.6 q), and in r runs a pair is lost with probability exp(-1.6 r q) at most:
the runs are repeated until ``RECALL`` is reached.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import groups
from quern.llm.common import Words, arrow_rows, drop, keep, mix, release, shingle_sets, slices, splitmix, text_buffers

WIDTH, LIKENESS = 5, 0.8
BRANCH = 2.0


def runs_for(recall: float, likeness: float = LIKENESS, branch: float = BRANCH) -> int:
    """Runs after which two sets of that likeness have met with that probability, however often buckets are split."""
    shared, survives = branch * likeness, 1.0
    for _ in range(200):
        survives = 1 - math.exp(-shared * survives)
    return math.ceil(-math.log(1 - recall) / (shared * survives))


#: The share of pairs of likeness 0.8 that are found at least; of likelier pairs it is more.
RECALL = 0.997
RUNS = runs_for(RECALL)
#: Sets that a bucket may have before it is split, tokens of a path at most, and sets that are compared with each other at once.
SMALL, DEPTH, TILE = 2048, 8, 1024
BITS = 512
#: Rows of an id and a digest (24 bytes) that are sent to all executors at most.
BROADCAST_ROWS = 1 << 20
#: Standard deviations by which a sketch may underrate a pair that is compared in full.
SLACK = 5.0

_FACTORS = splitmix(RUNS, 91) | np.uint64(1)
_CHUNK = 1 << 18
_BIT_SHIFT = np.uint64(64 - BITS.bit_length() + 1)
_BINS = np.arange(BITS)
_SALT = mix(np.arange(BITS, dtype=np.uint64))


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a set, from its sorted hashes."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _taken(shingles: np.ndarray, factors: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths of the tokens whose product with a factor (odd, modulo 2**64) is below branch / size, and the factors' numbers.

    Shingle hashes are mixed well already, so a product's high digits serve as a hash.
    """
    limit = np.uint64(min(2**64 - 1, int(branch / len(shingles) * 2**64)))
    rows = max(1, _CHUNK // len(shingles))
    made, numbers = [], []
    for low in range(0, len(factors), rows):
        product = shingles[None, :] * factors[low : low + rows, None]
        i, j = np.nonzero(product <= limit)
        made.append(mix(product[i, j] + factors[low + i]))
        numbers.append(low + i)
    return np.concatenate(made), np.concatenate(numbers)


def paths(shingles: np.ndarray, branch: float = BRANCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First paths, second paths, and of each second path its first one."""
    first = np.unique(_taken(shingles, _FACTORS, branch)[0])
    if not len(first):
        return first, first, first
    two, number = _taken(shingles, mix(first) | np.uint64(1), branch)
    return first, two, first[number]


def sketch(shingles: np.ndarray) -> bytes:
    """One bit of the smallest hash in each of 512 ranges; an empty range takes that of the next one that is not."""
    place = (shingles >> _BIT_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    filled = first[np.searchsorted(place[first], _BINS) % len(first)]
    return np.packbits((mix(shingles[filled] ^ _SALT) & np.uint64(1)).astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, text: str = "text", width: int = WIDTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``cls`` (digest of the shingle set), ``size``, ``sketch``, paths and the columns of ``carry``; no ``cls`` without words."""
    arrow_rows(docs.sparkSession)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *carry)
    schema = "doc_id long, cls binary, size long, sketch binary, one array<long>, two array<long>, parent array<long>"
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for found in shingle_sets(Words(*text_buffers(batch.column("text"))), width):
                s = np.unique(found)
                if not len(s):
                    rows.append((None, 0, None, None, None, None))
                    continue
                one, two, parent = (x.view(np.int64) for x in paths(s))
                rows.append((digest(s), len(s), sketch(s), one, two, parent))
            kinds = (pa.binary(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), *batch.columns[2:]], names=["doc_id", "cls", "size", "sketch", "one", "two", "parent", *carry])
        release()

    return source.mapInArrow(run, schema)


def _next_paths(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(``cls``, ``parent``, ``path``): the paths that members (``cls``, ``path``) go on by, from their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, known, size, shingles in zip(*(batch.column(c).to_pylist() for c in ("cls", "paths", "size", "shingles"))):
                parents = np.array(known, dtype=np.int64)
                made, number = _taken(groups.decode(shingles, size)[0], mix(parents.view(np.uint64)) | np.uint64(1), BRANCH)
                yield pa.RecordBatch.from_arrays([pa.array([cls] * len(made), pa.binary()), pa.array(parents[number]), pa.array(made.view(np.int64))], names=["cls", "parent", "path"])
        release()

    lists = members.groupBy("cls").agg(F.collect_list("path").alias("paths")).join(classes.select("cls", "size"), "cls")
    return _with_sets(lists, classes, docs, width).select("cls", "paths", "size", "shingles").mapInArrow(run, "cls binary, parent long, path long")


def _buckets(classes: DataFrame, docs: DataFrame, width: int, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Rows (``cls``, ``path``, ``n``): the buckets to compare and their numbers of members."""

    def sized(members: DataFrame, *keys: str) -> DataFrame:
        return keep(members.join(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), list(keys)), "paths")

    made = [sized(classes.select("cls", F.explode("one").alias("path")), "path")]
    leaves, big = [made[0].filter(f"n <= {small}")], made[0].filter(f"n > {small}")
    for level in range(2, depth + 1):
        if not big.limit(1).count():
            break
        if level == 2:
            pairs = F.filter(F.arrays_zip(F.col("parent"), F.col("two")), lambda x: x["parent"] == F.col("path"))
            found = big.join(classes.select("cls", "parent", "two"), "cls").select("cls", F.explode(pairs).alias("x")).select("cls", "x.parent", F.col("x.two").alias("path"))
        else:
            found = _next_paths(big, classes, docs, width)
        parts = sized(found.distinct(), "parent", "path")
        work = parts.groupBy("parent", "path").agg(F.first("n").alias("n")).groupBy(F.col("parent").alias("path")).agg(F.sum(F.col("n") * F.col("n")).alias("work"))
        whole = big.groupBy("path").agg(F.first("n").alias("n")).join(work, "path", "left").filter("work >= n * n").select("path")
        leaves.append(big.join(whole, "path", "left_semi"))
        parts = parts.join(whole.withColumnRenamed("path", "parent"), "parent", "left_anti").select("cls", "path", "n")
        parts = keep(parts, "paths")
        made.append(parts)
        leaves.append(parts.filter(f"n <= {small}"))
        big = parts.filter(f"n > {small}")
    out = big
    for leaf in leaves:
        out = out.unionByName(leaf.select(*out.columns))
    out = keep(out, "leaves")
    drop(*made)
    return out


def _tiles(leaves: DataFrame, classes: DataFrame, small: int = TILE) -> DataFrame:
    parts = F.ceil(F.col("n") / small).cast("int")
    mine = F.when(parts > 1, F.pmod(F.xxhash64("cls"), parts.cast("long")).cast("int")).otherwise(F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))
    mixed = leaves.withColumn("mine", mine).withColumn("other", other)
    tiles = mixed.select("cls", F.col("path").alias("leaf"), F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") != F.least("mine", "other")).alias("side"))
    lists = leaves.groupBy("cls").agg(F.sort_array(F.collect_list("path")).alias("leaves"))
    return tiles.join(classes.select("cls", "size", "sketch", "copies").join(lists, "cls"), "cls")


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "cls")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of a partition that is sorted by them, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        now = tuple(int(k[0]) for k in keys)
        new[0] = last is not None and now != last
        cuts = np.flatnonzero(new).tolist()
        low = 0
        for cut in cuts:
            if cut > low:
                held.append(batch.slice(low, cut - low))
            if held:
                yield pa.Table.from_batches(held)
            held, low = [], cut
        held.append(batch.slice(low))
        last = tuple(int(k[-1]) for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def _possible(sizes: np.ndarray, sketches: list[bytes], leaves: list, leaf: int, sides: np.ndarray | None, likeness: float) -> np.ndarray:
    """Which pairs of a tile are its own and may be alike: an upper triangular matrix."""
    n = len(sizes)
    signs = np.unpackbits(np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(n, -1), axis=1).astype(np.float32) * 2 - 1
    sizes = sizes.astype(np.float32)
    # of two sides, one is compared with the other; else all with all
    left, right = (np.arange(n),) * 2 if sides is None else (np.flatnonzero(~sides), np.flatnonzero(sides))
    guess = signs[left] @ signs[right].T
    guess /= BITS
    # of a pair the smaller set decides how far its sketch may be off
    bar = np.minimum(likeness - SLACK * 0.65 / np.sqrt(np.minimum(BITS, sizes)), 1)
    ok = guess >= bar[left][:, None]
    ok |= guess >= bar[right][None, :]
    del guess
    low = np.float32(likeness) * sizes * np.float32(1 - 1e-6)
    ok &= sizes[left][:, None] >= low[right][None, :]
    ok &= sizes[right][None, :] >= low[left][:, None]
    # a pair is compared in the smallest leaf that both have
    below = [[x for x in row if x < leaf] for row in leaves]
    names = {x: i for i, x in enumerate(sorted({x for row in below for x in row}))}
    if names and ok.any():
        has = np.zeros((n, len(names)), dtype=np.float32)
        for i, row in enumerate(below):
            has[i, [names[x] for x in row]] = 1
        ok &= has[left] @ has[right].T < 0.5
    if sides is None:
        return np.triu(ok, 1)
    full = np.zeros((n, n), dtype=bool)
    full[np.ix_(left, right)] = ok
    return np.triu(full | full.T, 1)


def _candidates(tiles: DataFrame, likeness: float) -> DataFrame:
    """Members of tiles with a possible partner; ``partners`` has a bit for each of the tile's ``chosen`` such members, by order of ``cls``."""
    schema = "leaf long, a int, b int, cls binary, size long, copies long, partners binary, chosen int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            if t.num_rows < 2:
                continue
            leaf, a, b = (t.column(i)[0].as_py() for i in range(3))
            sides = t.column("side").to_numpy() if a != b else None
            ok = _possible(t.column("size").to_numpy(), t.column("sketch").to_pylist(), t.column("leaves").to_pylist(), leaf, sides, likeness)
            chosen = np.flatnonzero(ok.any(0) | ok.any(1))
            if len(chosen):
                rows = t.select(["leaf", "a", "b", "cls", "size", "copies"]).take(pa.array(chosen)).combine_chunks()
                bits = np.packbits(ok[np.ix_(chosen, chosen)], axis=1)
                rows = rows.append_column("partners", pa.array([x.tobytes() for x in bits], pa.binary()))
                yield from rows.append_column("chosen", pa.array(np.full(len(chosen), len(chosen), dtype=np.int32))).to_batches()
        release()

    return _grouped(tiles.select("leaf", "a", "b", "cls", "size", "sketch", "copies", "side", "leaves")).mapInArrow(run, schema)


def _with_sets(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The shingle sets of members, read from the texts of their classes' first documents.

    Documents without an id cannot be found by it: all of them are read, and name their classes by their digests.
    """
    wanted = members.join(classes.select("cls", "rep"), "cls")
    source = docs.select(docs["doc_id"].cast("long").alias("rep"), docs["text"].cast("string").alias("text"))
    ids = keep(wanted.select("rep", "cls").distinct(), "wanted")
    few = ids.count() <= BROADCAST_ROWS  # else both sides are shuffled, texts too
    texts = source.join(F.broadcast(ids) if few else ids, "rep").unionByName(source.filter("rep IS NULL").withColumn("cls", F.lit(None).cast("binary")))
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for cls, found in zip(batch.column("cls").to_pylist(), shingle_sets(Words(*text_buffers(batch.column("text"))), width)):
                s = np.unique(found)
                if not len(s):
                    continue
                own = digest(s)
                if cls is None or own == cls:  # another row may have the same id
                    rows.append((own, groups.code(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*rows) if rows else ((), ()))], names=["cls", "shingles"])
        release()

    sets = texts.mapInArrow(run, "cls binary, shingles binary").dropDuplicates(["cls"])
    return wanted.drop("rep").join(sets, "cls")


def _alike(sets: list[np.ndarray], possible: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a tile that are alike, and how much; shared shingles are counted exactly."""
    n = len(sets)
    left, right = np.nonzero(possible)
    sizes = np.array([len(s) for s in sets])
    if len(left) <= 4 * n:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], dtype=np.int64)
    else:
        token, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), sizes)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        total = np.zeros((n, n), dtype=np.float32)
        for low in range(0, len(token), 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            has = np.zeros((n, min(4096, len(token) - low)), dtype=np.float32)
            has[row[a:b], column[a:b] - low] = 1
            total += has @ has.T
        shared = total[left, right].astype(np.int64)
    union = sizes[left] + sizes[right] - shared
    ok = shared >= likeness * union - 1e-9
    return left[ok], right[ok], shared[ok] / union[ok]


def _verified(members: DataFrame, likeness: float, pairs: bool) -> DataFrame:
    schema = "a binary, b binary, likeness double" if pairs else "cls binary, root binary, classes long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            n = t.num_rows
            if t.column("chosen")[0].as_py() != n:
                raise ValueError(f"{n} sets in a tile of {t.column('chosen')[0]}")
            names, copies = t.column("cls").to_pylist(), t.column("copies").to_numpy()
            sets = [groups.decode(x, k)[0] for x, k in zip(t.column("shingles").to_pylist(), t.column("size").to_pylist())]
            possible = np.unpackbits(np.frombuffer(b"".join(t.column("partners").to_pylist()), dtype=np.uint8).reshape(n, -1), axis=1)[:, :n].astype(bool)
            left, right, how = _alike(sets, possible, likeness)
            if not len(left):
                continue
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in left], pa.binary()), pa.array([names[i] for i in right], pa.binary()), pa.array(how)], names=["a", "b", "likeness"])
                continue
            links, docs = np.bincount(left, minlength=n) + np.bincount(right, minlength=n), np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
            root = np.arange(n)
            while True:  # smallest member of each component
                low = np.minimum(root[left], root[right])
                new = root.copy()
                np.minimum.at(new, left, low)
                np.minimum.at(new, right, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.binary()), pa.array([names[i] for i in root[at]], pa.binary()), pa.array(links[at].astype(np.int64)), pa.array(docs[at].astype(np.int64))], names=["cls", "root", "classes", "docs"])

    return _grouped(members).select("leaf", "a", "b", "cls", "size", "copies", "partners", "chosen", "shingles").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(``cls``, ``label``): the smallest node of each component of ``edges`` (``cls``, ``root``).

    Each round takes the smallest label next to a node, then that label's own label,
    so paths shorten by half and more; rounds are written to the shared folder.
    """
    both = keep(edges.select("cls", "root").filter("cls <> root").distinct(), "edges")
    step = both.unionByName(both.select(F.col("root").alias("cls"), F.col("cls").alias("root")))
    labels = keep(step.groupBy("cls").agg(F.min("root").alias("m")).select("cls", F.least("cls", "m").alias("label")), "labels")
    while True:
        near = step.join(labels.select(F.col("cls").alias("root"), "label"), "root").select("cls", "label").unionByName(labels).groupBy("cls").agg(F.min("label").alias("near"))
        jump = near.join(labels.select(F.col("cls").alias("near"), F.col("label").alias("far")), "near", "left")
        old = labels.withColumnRenamed("label", "old")
        new = keep(jump.select("cls", F.least("near", F.coalesce("far", "near")).alias("label")).join(old, "cls"), "labels")
        moved = new.filter("label <> old").limit(1).count()
        drop(labels)
        labels = new.drop("old")
        labels._quern_path = new._quern_path
        if not moved:
            drop(both)
            return labels


def _candidates_of(docs: DataFrame, text: str, width: int, likeness: float, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    if text != "text":
        docs = docs.select("doc_id", F.col(text).alias("text"), *carry)
    sig = keep(signatures(docs, "text", width, carry), "signatures")
    same = sig.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("size", "sketch", "one", "two", "parent")))
    classes = keep(same, "classes")
    members = keep(sig.select("doc_id", "cls", *carry), "members")
    drop(sig)
    leaves = _buckets(classes, docs, width)
    possible = keep(_candidates(_tiles(leaves, classes), likeness), "possible")
    drop(leaves)
    return members, classes, _with_sets(possible, classes, docs, width)


def pairs(docs: DataFrame, text: str = "text", width: int = WIDTH, likeness: float = LIKENESS) -> DataFrame:
    """Pairs of class representatives (``a`` < ``b``) that are alike, with their ``likeness``."""
    _, classes, found = _candidates_of(docs, text, width, likeness)
    rep = classes.select("cls", "rep")
    made = _verified(found, likeness, True).join(rep.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b")
    return made.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "likeness")


def join(docs: DataFrame, text: str = "text", width: int = WIDTH, likeness: float = LIKENESS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: its class of near copies and its links.

    Returns ``doc_id``, ``class_id`` (the smallest id of all documents that it is linked
    to, directly or over others), ``copy_of`` (the smallest id with an equal shingle
    set), ``n_links`` (other documents whose likeness is at least ``likeness``, equal
    ones included), ``class_key`` (a digest that names the class, as ids may repeat) and the
    columns of ``carry``.  A text of fewer words than ``width`` is one shingle; null and
    empty texts are linked to none, and each is a class of its own without a key.  Rows are
    documents: repeated rows are linked.  Ids that are null count as larger than any.  An empty
    table gives an empty one.
    """
    members, classes, found = _candidates_of(docs, text, width, likeness, carry)
    linked = keep(_verified(found, likeness, False), "linked")
    label = components(linked)
    counts = linked.groupBy("cls").agg(F.sum("docs").alias("docs"))
    near = classes.select("cls", "rep", "copies").join(counts, "cls", "left").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = near.groupBy("label").agg(F.min("rep").alias("class_id"))
    info = near.join(least, "label").select("cls", "class_id", F.col("rep").alias("copy_of"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.hex("label").alias("class_key"))
    out = members.join(info, "cls", "left")
    own = F.col("cls").isNull()
    ids = [F.when(own, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "copy_of")]
    return out.select("doc_id", *ids, F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), "class_key", *carry)


def first_of_each(docs: DataFrame, text: str = "text", width: int = WIDTH, likeness: float = LIKENESS) -> DataFrame:
    """Of each class of near copies one row of ``docs``, with all its columns.

    It is that of the smallest id, of equal ids that of the smallest hash of the text, and of
    repeated rows one.  Rows are told apart by id and text, so of rows that share an id
    each goes or stays by its own class.  Null and empty texts all stay.
    """
    row = F.struct(F.xxhash64(text), F.length(text))
    named = docs.withColumn("_row", row)
    classes = keep(join(named, text, width, likeness, ("_row",)).select("class_key", "doc_id", "_row"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    least = classes.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.min(order).alias("first"))
    rows = classes.groupBy("class_key", "doc_id", "_row").agg(F.count(F.lit(1)).alias("n"))
    chosen = keep(rows.join(least, "class_key").filter(F.col("first") == order).select("doc_id", "_row", "n"), "chosen")
    wordless = rows.filter("class_key IS NULL").select("doc_id", "_row", F.lit(1).cast("long").alias("n"))
    both = chosen.unionByName(wordless).withColumnsRenamed({"doc_id": "_id", "_row": "_key"})

    def of(which: str) -> DataFrame:
        found = both.filter(which).select("_id", "_key")
        return named.join(found, named["doc_id"].cast("long").eqNullSafe(F.col("_id")) & named["_row"].eqNullSafe(F.col("_key")), "left_semi")

    return of("n = 1").unionByName(of("n > 1").dropDuplicates(["doc_id", "_row"])).select(*docs.columns)
