"""Registered queries without SQL, on the smallest tables, against plain versions of what they must give."""

import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import pytest

from quern.llm import bottomk, queries

tokenizers = pytest.importorskip("tokenizers")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_language_model(spark, documents):
    got = {r.doc_id: r for r in queries.op2_lm_scoring(spark, DATA).collect()}
    words = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in t.split()] + ["\0end"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in documents if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(documents)
    for i, t in documents:
        w = words(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert -math.inf < r.score < 0


def test_token_counts(spark, documents, whole):
    got = {r.doc_id: r for r in queries.op3_token_counts(spark, DATA).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        n, now = len(text), text
        for at, size, new in ((n // 4, 7, ""), (n // 2, 0, " re-edited "), (n * 3 // 4, 5, "X1 y")):
            now = now[:at] + new + now[at + size :]
        r = got[i]
        count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
        assert (r.tokens_before, r.tokens_after, r.edited_sha256) == (count(text), count(now), sha(now))
        assert r.reencoded <= r.pretokens + 100


def test_toxicity(spark):
    """On tables with labels enough to learn from, by those held out."""
    data = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, data).collect()}
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    said = Counter((r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if got[r.doc_id].held_out)
    assert said[1, 1] >= 0.9 * (said[1, 0] + said[1, 1]) and said[0, 0] >= 0.99 * (said[0, 0] + said[0, 1])


def test_fingerprints(spark, documents):
    got = {r.doc_id: r for r in queries.op8_document_fingerprints(spark, DATA).collect()}
    assert len(got) == len(documents)
    off = []
    for k, (i, text) in enumerate(documents):
        following = documents[(k + 1) % len(documents)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r, a, b, c = got[i], *map(shingles, (text, edited, following))
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        for said, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
            exact = likeness(x, y)
            off.append(abs(said - exact))
            assert abs(said - exact) < (1e-12 if len(x | y) <= bottomk.K else 0.25)
        for print_, x in ((r.fingerprint, a), (r.edited_fingerprint, b)):
            assert len(bottomk.from_text(print_)) == min(bottomk.K, len(x))
    assert sum(off) / len(off) < 0.02
    by_text = {}
    assert all(by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint for i, t in documents)


def test_encoding(spark, documents, whole):
    got = {r.doc_id: r for r in queries.op9_bpe_encoding(spark, DATA).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        ids = whole.encode(text, add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False)))


def test_jaccard(spark, documents):
    got = {r.doc_id: r for r in queries.op10_ngram_jaccard(spark, DATA).collect()}
    assert len(got) == len(documents)
    sets = [(i, shingles(t)) for i, t in documents]
    links = Counter()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 0.8 * len(b) <= len(a) <= len(b) / 0.8 and likeness(a, b) >= 0.8:
                links[i] += 1
                links[j] += 1
                assert got[i].class_id == got[j].class_id
    assert {i: r.n_links for i, r in got.items()} == {i: links[i] for i, _ in documents}
