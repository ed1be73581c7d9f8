"""Token counts that follow edits.

A document keeps its pre-tokens (lengths and token counts) in a segment tree over
blocks of them.  Whether a pre-token begins at a place depends only on the text from
the last boundary on, so after an edit it is enough to split again from a boundary
before it (one pre-token of context more, as a match may look one character ahead)
until a new boundary past the edit falls on an old one.  Those pre-tokens alone are
encoded, and the sums on the paths to their blocks are updated.  A special token is a
pre-token of its own that ends those beside it; an edit can make or break one that begins
up to its length before, so the new split begins that much earlier.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import TrieBPE, model
from quern.llm.common import arrow_rows, slices

BLOCK = 64
_ZSTD = pa.Codec("zstd", compression_level=1)


class CountTree:
    """Pre-tokens of one text in blocks, with sums of characters and tokens by subtree."""

    def __init__(self, lengths: list[int], counts: list[int]) -> None:
        self.fill([lengths[i : i + BLOCK] for i in range(0, len(lengths), BLOCK)] or [[]], [counts[i : i + BLOCK] for i in range(0, len(counts), BLOCK)] or [[]])

    def fill(self, lengths: list[list[int]], counts: list[list[int]]) -> None:
        self.lengths, self.counts = lengths, counts
        self.size = 1 << (len(lengths) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(zip(lengths, counts)):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(a), sum(b)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """The block that holds the character at ``place``, and where the block begins."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return min(node - self.size, len(self.lengths) - 1), start

    def put(self, block: int, lengths: list[int], counts: list[int]) -> None:
        self.lengths[block], self.counts[block] = lengths, counts
        node = self.size + block
        self.chars[node], self.tokens[node] = sum(lengths), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def before(self, place: int) -> tuple[int, int, int]:
        """Block, index and start of the pre-token that a new split begins at for an edit at ``place``."""
        block, start = self.find(max(0, place - 2))
        if place - 2 >= self.chars[1]:
            block, start = len(self.lengths) - 1, self.chars[1] - self.chars[self.size + len(self.lengths) - 1]
        index = 0
        row = self.lengths[block]
        while index < len(row) and start + row[index] < place - 1:
            start += row[index]
            index += 1
        # one pre-token of context more
        if index:
            index -= 1
            start -= row[index]
        else:
            while block and not index:
                block -= 1
                index = len(self.lengths[block])
            if index:
                index -= 1
                start -= self.lengths[block][index]
        return block, index, start

    def rebalance(self) -> None:
        if max(map(len, self.lengths)) > 4 * BLOCK:
            self.__init__([x for b in self.lengths for x in b], [x for b in self.counts for x in b])


class EditCounter:
    """Counts tokens of texts and keeps them up to date."""

    def __init__(self, bpe: TrieBPE) -> None:
        self.bpe = bpe
        self.known: dict[str, int] = {}
        #: Characters around an edit that may belong to a special token with it.
        self.reach = max(map(len, bpe.special), default=0)

    def learn(self, words: set[str]) -> None:
        """Know the token counts of all these words."""
        known = self.known
        new = [w for w in words if w not in known]
        if new and len(known) > 400_000:
            known.clear()
            new = list(words)
        if new:
            known.update(self.bpe.sizes(new))

    def counts(self, words: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(set(words))
        return list(map(self.known.__getitem__, words))

    def build(self, text: str) -> CountTree:
        return self.build_all([text])[0]

    def build_all(self, texts: list[str]) -> list[CountTree]:
        """Trees of texts, whose words are encoded at once, so that they share one trie."""
        words = [self.bpe.pieces(t) for t in texts]
        self.learn(set().union(*words))
        return [CountTree(list(map(len, w)), self.counts(w)) for w in words]

    def edit(self, tree: CountTree, text: str, start: int, end: int, new: str) -> tuple[str, int]:
        """Replace ``text[start:end]``; returns the new text and how many pre-tokens were encoded again.

        Places beyond the text are cut to it.
        """
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        out = text[:start] + new + text[end:]
        block, index, at = tree.before(max(0, start - self.reach))
        shift = len(out) - len(text)
        made: list[str] = []
        b, i, old, new_at = block, index, at, at  # the next old pre-token, where it begins, where the next new one does
        step, done = 256 + self.reach, False
        past = start + len(new)
        while not done:
            stop = min(len(out), max(past, new_at) + step)
            for word in self.bpe.pieces(out[new_at:stop]):
                if stop < len(out) and new_at + len(word) + 1 + self.reach >= stop:
                    break  # it may go on, or look beyond the part that was split
                if new_at >= past:
                    while b < len(tree.lengths) and (i >= len(tree.lengths[b]) or old + shift < new_at or old < end):
                        if i >= len(tree.lengths[b]):
                            b, i = b + 1, 0
                        else:
                            old += tree.lengths[b][i]
                            i += 1
                    if b < len(tree.lengths) and old + shift == new_at:
                        done = True
                        break
                made.append(word)
                new_at += len(word)
            if not done and stop == len(out):
                b, i, done = len(tree.lengths), 0, True
            step *= 2
        kept = (tree.lengths[block][:index], tree.counts[block][:index])
        rest: tuple[list[int], list[int]] = ([], [])
        if b < len(tree.lengths):
            rest = tree.lengths[b][i:], tree.counts[b][i:]
        counts = self.counts(made)
        for x in range(block + 1, min(b + 1, len(tree.lengths))):
            tree.put(x, [], [])
        tree.put(block, kept[0] + list(map(len, made)) + rest[0], kept[1] + counts + rest[1])
        tree.rebalance()
        return out, len(made)


def _packed(tree: CountTree) -> bytes:
    raw = array("i", list(chain(*tree.lengths, *tree.counts))).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(data: bytes) -> CountTree:
    rows = array("i")
    rows.frombytes(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))
    half = len(rows) // 2
    return CountTree(rows[:half].tolist(), rows[half:].tolist())


_COUNTERS: dict[str, EditCounter] = {}


def counter(path: str) -> EditCounter:
    return _COUNTERS.setdefault(path, EditCounter(model(path)))


def build(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text``, ``n_tokens`` and ``tree`` (the leaves of the count tree) of every row, then the columns of ``carry``.

    A null text counts as empty: no tokens.  Repeated rows are counted each; other
    columns are not read.
    """
    arrow_rows(docs.sparkSession)
    source = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), *carry)
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches, "text"):
            trees = count.build_all(batch.column(1).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([t.total for t in trees], pa.int64()), pa.array(map(_packed, trees), pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_tokens", "tree", *carry])

    return source.mapInArrow(run, f"doc_id long, text string, n_tokens long, tree binary{extra}")


def edit(built: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """Apply each row's ``edits`` (array of start, end, text; code points; one after the other).

    Returns ``doc_id``, ``text``, ``n_tokens`` and ``tree`` as they are then, with
    ``tokens_before``, ``pretokens`` and ``reencoded`` (pre-tokens encoded again).
    Null edits and null fields of an edit change nothing.
    """
    arrow_rows(built.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches, "text"):
            rows = []
            for text, packed, todo in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
                tree = _unpacked(packed)
                before, again = tree.total, 0
                for e in todo or ():
                    if e is not None and None not in e.values():
                        text, n = count.edit(tree, text, e["start"], e["end"], e["text"])
                        again += n
                rows.append((text, tree.total, _packed(tree), before, sum(map(len, tree.lengths)), again))
            columns = list(zip(*rows))
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "text", "n_tokens", "tree", "tokens_before", "pretokens", "reencoded"])

    source = built.select("doc_id", "text", "n_tokens", "tree", F.col(edits).cast("array<struct<start: long, end: long, text: string>>").alias("edits"))
    return source.mapInArrow(run, "doc_id long, text string, n_tokens long, tree binary, tokens_before long, pretokens long, reencoded long")
