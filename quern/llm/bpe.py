"""Byte-level BPE by traversing the prefix trie of distinct words.

For byte-pair merges the encoding of every prefix of a word is known from one
state, its last token: token ``t`` ends the encoding of a prefix exactly if ``t``
is a suffix of it and the pair (last token of what stands before, ``t``) is one
that merging leaves alone.  The distinct pre-tokens are laid out as a trie (their
sorted order is its depth-first order, the common prefix with the previous word
the part of the path that is kept), and each node's state is computed once from
its ancestors' states.  Encodings are read back from the states.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import arrow_rows, release, slices

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies, with white space written out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
#: The same for texts below U+0250, whose letters and numbers are listed, so that a faster matcher serves.
LETTER, NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = rf"""'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""

#: Distinct pre-tokens whose encodings a worker remembers before it starts anew.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies use."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder for a ``tokenizers`` file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.vocab = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        #: Lengths to try for the token that ends a prefix, likely ones first; just one of them fits.
        likely = [3, 2, 4, 1, *range(5, self.longest + 1)]
        self.lengths = [tuple(n for n in likely if n <= end) for end in range(self.longest + 1)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (k, self.vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.words_any, self.words_latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.kept: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the encodings of words; pair decisions stay, their number is bounded by the vocabulary."""
        self.ids: dict[str, str] = {s: str(i) for s, i in self.special.items()}
        self.back: dict[str, str] = {}  # decoded pre-tokens that differ from what was encoded

    def merged(self, data: bytes) -> list[int]:
        """Plain pair merging; used only on the bytes of two tokens."""
        seq = [self.vocab[data[i : i + 1]] for i in range(len(data))]
        while len(seq) > 1:
            best = min((self.rank[p] for p in zip(seq, seq[1:]) if p in self.rank), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(seq):
                if i + 1 < len(seq) and self.rank.get((seq[i], seq[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(seq[i])
                    i += 1
            seq = out
        return seq

    def stands(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens ``a`` and ``b`` gives these two tokens again."""
        key = a << 24 | b
        known = self.kept.get(key)
        if known is None:
            known = self.kept[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def states(self, words: Iterable[str]) -> Iterator[tuple[str, bytes, list[int]]]:
        """Distinct pre-tokens in the depth-first order of their trie, each with its bytes and the last token of each of its prefixes."""
        vocab, longest, known, stands, lengths = self.vocab.get, self.longest, self.kept, self.stands, self.lengths
        last: list[int] = [-1]  # by depth: the last token of the path's prefix of that length
        path = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            n, depth, most = len(raw), 0, min(len(raw), len(path))
            while depth < most and raw[depth] == path[depth]:
                depth += 1
            del last[depth + 1 :]
            for end in range(depth + 1, n + 1):
                for size in lengths[end if end < longest else longest]:
                    start = end - size
                    token = vocab(raw[start:end])
                    if token is None:
                        continue
                    if not start:
                        # a whole prefix is one token only if merging it gives that token
                        if end == 1 or self.whole(token):
                            break
                        continue
                    before = last[start]
                    ok = known.get(before << 24 | token)
                    if ok or ok is None and stands(before, token):
                        break
                last.append(token)
            path = raw
            yield word, raw, last

    def sizes(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Distinct pre-tokens or special tokens, each with its number of tokens; none are remembered."""
        length, special = self.length, self.special
        yield from ((w, 1) for w in words if w in special)
        for word, raw, last in self.states([w for w in words if w not in special]):
            n, end = 0, len(raw)
            while end:
                n += 1
                end -= length[last[end]]
            yield word, n

    def learn(self, words: set[str]) -> None:
        """Encode distinct pre-tokens."""
        bytes_of = self.bytes_of
        for word, raw, last in self.states(words):
            out, end = [], len(raw)
            while end:
                out.append(last[end])
                end -= len(bytes_of[last[end]])
            out.reverse()
            self.ids[word] = ",".join(map(str, out))
            decoded = b"".join([bytes_of[t] for t in out])
            if decoded != raw:
                self.back[word] = decoded.decode("utf-8", "replace")

    def whole(self, token: int) -> bool:
        known = self.kept.get(-1 - token)
        if known is None:
            known = self.kept[-1 - token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a whole text."""
        if self.split is None or not any(s in text for s in self.special):
            return self.words(text)
        return [w for i, part in enumerate(self.split(text)) for w in ([part] if i % 2 else self.words(part))]

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; where all characters are Latin, the two patterns agree."""
        return (self.words_latin if text.isascii() or max(text) < "\u0250" else self.words_any)(text)

    def prepare(self, texts: list[list[str]]) -> None:
        if len(self.ids) > REMEMBERED:
            self.reset()
        new: set[str] = set()
        for words in texts:
            new.update(words)
        self.learn({w for w in new if w not in self.ids})

    def encode(self, text: str) -> list[int]:
        words = self.pieces(text)
        self.prepare([words])
        return [int(i) for w in words for i in self.ids[w].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids if i in self.bytes_of]).decode("utf-8", "replace")


_MODELS: dict[str, TrieBPE] = {}


def model(path: str) -> TrieBPE:
    if path not in _MODELS:
        _MODELS[path] = TrieBPE(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", ids: bool = True, digests: bool = False) -> DataFrame:
    """Token ids, their number and the decoded text of every row.

    Returns ``id_column`` (as it is, null too), ``n_tokens``, then ``ids`` (array of
    int) and ``decoded``, or with ``digests`` their SHA-256 digests (of the decimal
    ids joined by commas, and of the UTF-8 text).  A null or empty text has no ids;
    repeated rows are encoded each; other columns are not read.  Texts are streamed,
    and only the encodings of distinct pre-tokens are remembered, up to a bound.
    """
    arrow_rows(docs.sparkSession)
    source = docs.select(docs[id_column], docs[text].cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long" + (", ids array<int>, decoded string" if ids and not digests else "") + (", ids_sha256 string, decoded_sha256 string" if digests else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in slices(batches, "text"):
            texts = [bpe.pieces(t or "") for t in batch.column("text").to_pylist()]
            bpe.prepare(texts)
            joined = [",".join(map(bpe.ids.__getitem__, w)) for w in texts]
            back = ("".join(map(bpe.back.get, w, w)) if bpe.back else "".join(w) for w in texts)
            columns = [batch.column(0), pa.array([x.count(",") + 1 if x else 0 for x in joined], pa.int64())]
            names = [id_column, "n_tokens"]
            if digests:
                columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
                names += ["ids_sha256", "decoded_sha256"]
            elif ids:
                columns += [pa.array([[int(i) for i in x.split(",")] if x else [] for x in joined], pa.list_(pa.int32())), pa.array(list(back), pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.reset()
        release()

    return source.mapInArrow(run, schema)
