"""Decoding of obfuscated words, and accuracy on texts held out."""

import itertools
import random

import numpy as np

from quern.llm import toxicity

CLEAN = "the of and in to that with from there they this have other ready stone river paper window garden market winter summer".split()
BAD = "idiot moron scum pathetic".split()


def corpus(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(20, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_words_are_restored():
    rows, _ = corpus(random.Random(1))
    channel = toxicity.Channel(toxicity.character_costs(toxicity.trigram_counts([t for _, t in rows])))
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("p@thetic", "pathetic"), ("iiidiooot", "idiot"), ("$cum", "scum"), ("i.d.i.o.t", "idiot"), ("m-o-r-o-n", "moron"), ("garden", "garden")):
        assert "=" + word in channel.features(token), token
    for token in ("you-idiot", "well...idiot", "the/1d10t", "i d i o t", "in i d i o t", "s c u m", "m o r o n s c u m"):
        assert "=" + ("scum" if token.endswith("m") else "idiot") in channel.features(token), token
    assert "=moron" in channel.features("m o r o n s c u m")
    assert "i d i o t" in toxicity.tokens("you i d i o t there") and toxicity.tokens("a\ny") == {"a", "y"}
    assert "a b c" in toxicity.tokens("A  b\n\tc") and "x ab c d" in toxicity.tokens("x ab c d long")
    assert channel.features("") == () and channel.features("ok") == ()


def test_decoding_against_all_paths():
    rows, _ = corpus(random.Random(5), 60)
    channel = toxicity.Channel(toxicity.character_costs(toxicity.trigram_counts([t for _, t in rows])))

    def cost(path):
        total, a, b = 0.0, 0, 0
        for read, more in path:
            total += more
            for c in read:
                z = 0 if c == " " else toxicity.CODE.get(c, 1)
                total, a, b = total + channel.costs[a, b, z], b, z
        return total + channel.costs[a, b, 0]

    for token in ("1d10t", "i d i", "a-1!t", "scuuumm", "s.c u", "no-1$ ab", "||", "ee tt ooo", "中x1"):
        best = min(itertools.product(*channel.arcs(token)), key=cost)
        assert cost(best) == min(map(cost, itertools.product(*channel.arcs(token))))
        assert channel.restore(token) == "".join(r for r, _ in best), token


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows, labels = corpus(rng)
    hidden = [(5000 + i, f"the river {w} and the stone") for i, w in enumerate(("1d10t", "m0r0n", "p a t h e t i c", "scuuum", "IDIOT!!", "moron,", "a  i d\ni o t", "the-idiot", "id iot", "mor on", "sccum", "s c u m i d i o t"))]
    more = [(6000, None), (6001, ""), (1, rows[1][1]), (None, "the garden")]
    docs = spark.createDataFrame([(*r, "en", 0.5) for r in rows + hidden + more], "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame([*labels, (7777, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known, toxicity.F.crc32(toxicity.F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) + len(hidden) + len(more)
    by = {r.doc_id: r for r in out}
    assert np.mean([by[i].predicted == y for i, y in labels]) > 0.99
    assert all(by[i].predicted == 1 for i, _ in hidden)
    assert all(by[i].predicted == 0 and 0 <= by[i].score < 0.5 for i in (6000, 6001, None))
    kept = {r.doc_id for r in toxicity.clean(docs, model).collect()}
    assert kept == {r.doc_id for r in out if not r.predicted}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
