"""Sketches against exact sets, and edited texts against a plain loop."""

import hashlib
import random

import numpy as np

from quern.llm import bottomk


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def sketch(text):
    return bottomk.sketches(*bottomk.text_buffers(bottomk.pa.array([text])))[0]


def test_estimates():
    rng = random.Random(3)
    a = [str(rng.randint(0, 10**6)) for _ in range(3000)]
    b = a[:2000] + [str(rng.randint(0, 10**6)) for _ in range(1000)]
    x, y = shingles(" ".join(a)), shingles(" ".join(b))
    s, t = sketch(" ".join(a)), sketch(" ".join(b))
    assert abs(bottomk.resemblance(s, t) - len(x & y) / len(x | y)) < 0.13
    assert abs(bottomk.containment(s, t) - len(x & y) / len(x)) < 0.2
    assert abs(bottomk.distinct(s) / len(x) - 1) < 0.3
    assert np.array_equal(bottomk.from_text(bottomk.to_text(s)), s)
    # small sets are exact, and parts merge to the whole
    s, t = sketch("a b c d e f g"), sketch("a b c d e f x")
    assert bottomk.resemblance(s, t) == 2 / 4 and bottomk.distinct(s) == 3
    assert np.array_equal(bottomk.merge(sketch("a b c d e"), sketch("b c d e f")), sketch("a b c d e f"))
    assert bottomk.resemblance(sketch(""), sketch(" \n")) == 1.0 and bottomk.resemblance(sketch("a"), sketch("")) == 0.0


def test_edited_pairs(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 3, 9, 60]))), "s") for i in range(300)]
    rows += [(7, None, "s"), (7, "twice", "s"), (7, "twice", "s"), (None, "no id", "s"), (10**12, "é" * 5001, "s")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = bottomk.edited_pairs(docs).collect()
    order = sorted(((r[0] is not None, r[0] or 0), r[1] or "") for r in rows)
    want = []
    for i, (key, text) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((key[1] if key[0] else None, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    assert len({r.fingerprint for r in got if r.n_chars == 5}) >= 1 and all(0 <= r.near_next <= 1 for r in got)
    assert bottomk.edited_pairs(docs.limit(0)).count() == 0
    assert bottomk.edited_pairs(docs.filter("doc_id = 0")).count() == 1


def test_merged(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "b c d e f"), (3, None)], "doc_id long, text string")
    made = bottomk.merged(bottomk.fingerprint(docs).withColumn("g", bottomk.F.lit(1)), "g").first()
    assert made.sketch == sketch("a b c d e f").tolist()
