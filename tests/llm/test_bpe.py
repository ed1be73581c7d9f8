"""The trie encoder against the tokenizers library, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest

from quern.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_random_texts():
    whole, own, rng = tokenizers.Tokenizer.from_file(PATH), bpe.TrieBPE(PATH), random.Random(1)
    letters = list("ab'st re\x1c\x85\xa0 \n\t1²¼ªäß𝟘中<|>") + ["<|endoftext|>", "ing", "'re", "  ", "tion", "😀"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = own.encode(text)
        assert ids == whole.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text == whole.decode(ids, skip_special_tokens=False)
    long = "ab" * 20_000
    assert own.encode(long) == whole.encode(long).ids


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    own, whole = bpe.TrieBPE(PATH), tokenizers.Tokenizer.from_file(PATH)
    for i in range(40):
        text = f"word{i} other{i * 7} and the rest"
        assert own.encode(text) == whole.encode(text).ids
    assert len(own.ids) < 40


def test_rows(spark):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (2, None), (3, ""), (None, "no id"), (4, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    whole = tokenizers.Tokenizer.from_file(PATH)
    out = bpe.encode(df, PATH).collect()
    assert sorted(map(repr, ((r.doc_id, list(r.ids), r.decoded, r.n_tokens) for r in out))) == sorted(repr((i, whole.encode(t or "").ids, t or "", len(whole.encode(t or "").ids))) for i, t in rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, PATH, digests=True).collect()}
    assert got == {(i, sha(",".join(map(str, whole.encode(t or "").ids))), sha(t or "")) for i, t in rows}
    assert bpe.encode(df.limit(0), PATH).count() == 0
