"""Toxicity of texts after noisy-channel deobfuscation.

A *character model* (interpolated trigrams over lower-case Latin letters) is counted
over all texts.  A token that holds leet characters, separators or letters repeated
three times or more, and a run of short tokens with single letters among them, is a noisy
reading of words: its lattice has an arc for each reading of each character, with a channel
cost: itself, the letters it may stand for, nothing, and for spaces and separators the edge
of a word.  Viterbi decoding under the character model finds the likeliest words, so where
a word begins among spaced letters is decided by the model.  Other tokens have one path only,
which is the token itself, so no search is made for them; nor is it for neighbouring tokens
and for tokens with double letters, unless joined or shortened they are a word that the
classifier knows.

The *classifier* looks at restored words: the whole word, and its first 4, 5 and 6
letters (the words of a language's slurs share stems).  From labelled rows it keeps
those that toxic texts hold significantly more often; a text's evidence is the sum
of its strongest words, mapped to a probability by logistic regression.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_rows, hashed_sample, release, slices

#: At most so many labelled rows are learned from, chosen by a hash of their id.
TRAINING_ROWS = 20_000
#: Words and stems are kept that make labels so many nats likelier than a share as in all rows.
GAIN = 10.0
#: A text's evidence is the sum of its so many strongest distinct words.
STRONGEST = 3

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
SYMBOLS = 2 + len(LETTERS)  # 0: a word's edge, 1: anything else
CODE = {c: i + 2 for i, c in enumerate(LETTERS)}

#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h"}
SEPARATORS = "._-*~'/\\,:;`^\""
#: Costs, in nats, of reading a character as a letter, of skipping it, of shortening a run of one letter,
#: of dropping a space, and of reading a separator as the edge of a word.
LEET_COST, SKIP_COST, RUN_COST, SPACE_COST, EDGE_COST = 1.0, 2.0, 0.5, 0.5, 1.0
OTHER_COST = 4.0

_PLAIN = re.compile(rf"[{LETTERS}]*\Z").match
_THRICE = re.compile(r"([^\W\d_])\1\1").search
_TWICE = re.compile(r"([^\W\d_])\1")
#: Tokens that may be pieces of a spaced word have so many characters at most, in runs of so many at least.
PIECE, PIECES = 2, 3
_ENDS = ".,;:?\"')]}"

_TABLE = np.ones(0x250, dtype=np.int64)
for _c, _i in CODE.items():
    _TABLE[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _TABLE[ord(_c.upper())] = _i
_TABLE[[0x20, *range(9, 14), 0xA0, *map(ord, ".,;:!?\"()")]] = 0


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of symbol trigrams, each text standing between edges."""
    codes = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = _TABLE[np.minimum(codes, 0x24F)]
    symbols[codes >= 0x250] = 1
    return np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), trigrams interpolated with bigrams, single symbols and the uniform one."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 50 * p1) / (bi.sum(1, keepdims=True) + 50)
    p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
    return -np.log(p3)


@dataclass
class Channel:
    """Restores words; remembers what it has restored, up to a bound."""

    costs: np.ndarray
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def arcs(self, token: str) -> list[list[tuple[str, float]]]:
        """The readings of each character, or of each run of one letter."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            if c in CODE:
                n = j - i
                out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, RUN_COST)] if n == 2 else [(c, RUN_COST), (c * 2, RUN_COST)])
                i = j
                continue
            i += 1
            if c == " ":
                out.append([(" ", 0.0), ("", SPACE_COST)])
                continue
            readings = [(x, LEET_COST) for x in LEET.get(c, "")]
            if c in SEPARATORS or c in LEET:
                readings.append(("", SKIP_COST))
            if c in SEPARATORS:
                readings.append((" ", EDGE_COST))
            out.append([*readings, (c, OTHER_COST)])
        return out

    def restore(self, token: str) -> str:
        """The likeliest words for a token or a run of tokens, parted by spaces; itself if nothing reads better."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for readings in self.arcs(token):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                for read, more in readings:
                    total, x, y = cost + more, a, b
                    for c in read:
                        z = 0 if c == " " else CODE.get(c, 1)
                        total += self.costs[x, y, z]
                        x, y = y, z
                    old = step.get((x, y))
                    if old is None or total < old[0]:
                        step[x, y] = (total, (path, read))
            best = step
        _, path = min((cost + self.costs[a, b, 0], path) for (a, b), (cost, path) in best.items())
        out = []
        while path:
            path, read = path
            out.append(read)
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """The restored words of a lower-case token, or of a run of them."""
        word = token.strip(_ENDS)
        if " " not in word and _PLAIN(word) and not _THRICE(word):
            return [word]
        return self.restore(token if _THRICE(word) is None and len(word) < 2 else word).split()

    def features(self, token: str, remember: bool = True) -> tuple[str, ...]:
        """What the classifier sees of a lower-case token, or of a run of them."""
        made = self.known.get(token)
        if made is None:
            if len(self.known) > 100_000:
                self.known.clear()
            made = tuple(dict.fromkeys(f for w in self.words(token) for f in stems(w)))
            if remember:
                self.known[token] = made
        return made


def stems(word: str) -> tuple[str, ...]:
    """The whole word, and if it has four letters or more, its first 4, 5 and 6."""
    return (word[:4], word[:5], word[:6], "=" + word) if len(word) >= 4 else ("=" + word,) if len(word) == 3 else ()


def runs(found: list[str]) -> list[str]:
    """Runs of short tokens with two single characters among them, joined by spaces."""
    out, low = [], 0
    for high in [i for i, t in enumerate(found) if len(t) > PIECE] + [len(found)]:
        if high - low >= PIECES and sum(len(t) == 1 for t in found[low:high]) >= 2:
            out.append(" ".join(found[low:high]))
        low = high + 1
    return out


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens, and the runs of them that may be spaced words."""
    found = text.lower().split()
    out = set(found)
    if sum(len(t) == 1 for t in out) and len(found) >= PIECES:
        out.update(runs(found))
    return out


@dataclass
class Model:
    """A character model, weights of words and stems, and the logistic mapping."""

    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    slope: float = 1.0

    def scorer(self):
        channel, known, weights = Channel(self.costs), {}, self.weights
        whole = {f[1:] for f in weights if f[0] == "="}

        def weight(token: str) -> float:
            found = channel.features(token, False)
            if _TWICE.search(token) and (short := _TWICE.sub(r"\1", token.strip(_ENDS))) in whole and channel.restore(token.strip(_ENDS)) == short:
                found = (*found, *stems(short))
            return max((weights.get(f, 0.0) for f in found), default=0.0)

        def evidence(text: str) -> float:
            if len(known) > 200_000:
                known.clear()
            low = text.lower().split()
            found = []
            for t in tokens(text):
                w = known.get(t)
                if w is None:
                    w = known[t] = weight(t)
                if w:
                    found.append(w)
            if not whole.isdisjoint(map(operator.add, low, low[1:])):
                for a, b in set(zip(low, low[1:])):
                    if a + b in whole and channel.restore(f"{a} {b}") == a + b:
                        found.append(max(weights.get(f, 0.0) for f in stems(a + b)))
            return sum(sorted(found)[-STRONGEST:])

        return evidence

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * evidence, -40, 40)))


def _texts(docs: DataFrame, *more) -> DataFrame:
    arrow_rows(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *more)


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs of the character model of all texts; what reaches the driver is bounded by the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in slices(batches, "text"):
            total += trigram_counts(batch.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])
        release()

    rows = _texts(docs).select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["at"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return character_costs(counts)


def train(docs: DataFrame, labels: DataFrame, keep_label=None, rows: int = TRAINING_ROWS) -> Model:
    """Fit a model to ``labels`` (doc_id, toxic), of which at most ``rows`` are used.

    ``keep_label`` is a condition on labels to learn from.  Labels that are null are
    left out; of rows with equal ids each counts.  Without any toxic or any other row,
    the model scores all texts low and alike.
    """
    spark = docs.sparkSession
    labels = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if keep_label is not None:
        labels = labels.filter(keep_label)
    sample = hashed_sample(labels, rows, labels.count(), "doc_id", "toxic")
    model = Model(character_model(docs))
    costs = spark.sparkContext.broadcast(model.costs)
    chosen = _texts(docs).join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(costs.value)
        for batch in slices(batches, "text"):
            total: dict[tuple[str, int], int] = {}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: set[str] = {""}
                for t in tokens(text):
                    seen.update(channel.features(t))
                for f in seen:
                    total[f, toxic] = total.get((f, toxic), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["f", "toxic", "n"])
        del channel
        release()

    counted = chosen.mapInArrow(count, "f string, toxic int, n long").groupBy("f").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("c"))
    rows_all = labels.join(F.broadcast(sample), ["doc_id", "toxic"], "left_semi")  # for the priors only
    sizes = dict(rows_all.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return model
    # the likelihood ratio against a share as in all rows: rare words must be rarer than chance
    t, c, base = F.col("t"), F.col("c"), n_toxic / (n_toxic + n_clean)
    share = t / (t + c)
    gain = t * F.log(share / base) + F.when(c > 0, c * F.log(F.greatest(1 - share, F.lit(1e-12)) / (1 - base))).otherwise(0.0)
    odds = F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    best = counted.filter((t >= 3) & (t >= c) & (gain > GAIN) & (F.length("f") > 0)).select("f", odds.alias("w")).filter("w > 0").toPandas()
    model.weights = dict(zip(best["f"], best["w"].astype(float)))
    weighed = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = weighed.value.scorer()
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([evidence(x) for x in batch.column(1).to_pylist()], pa.float64())], names=["toxic", "x"])

    fit = chosen.mapInArrow(weigh, "toxic int, x double").toPandas()
    model.bias, model.slope = _logistic(fit["x"].to_numpy(dtype=float), fit["toxic"].to_numpy(dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge on the slope, so that separable data have an answer."""
    beta = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    rows = np.stack([np.ones_like(x), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -40, 40)))
        w = p * (1 - p)
        step = np.linalg.solve((rows * w[:, None]).T @ rows + np.diag([1e-6, 0.1]), rows.T @ (y - p) - np.array([0, 0.1 * beta[1]]))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of every row.

    Null and empty texts get the score of a text without evidence; repeated rows are
    scored each; other columns are not read.  Texts are streamed whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = model.scorer()
        for batch in slices(batches, "text"):
            p = model.probability(np.array([evidence(x) for x in batch.column(1).to_pylist()], dtype=float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
        del evidence
        release()

    return _texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = model.scorer()
        for batch in slices(batches, "text"):
            p = model.probability(np.array([evidence(x or "") for x in batch.column("text").to_pylist()], dtype=float))
            yield batch.filter(pa.array(p < 0.5))
        del evidence
        release()

    return docs.mapInArrow(run, docs.schema)
