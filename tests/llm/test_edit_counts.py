"""Edit-aware counts against full encoding, and trees against their sums."""

import random

import public_tokenizers
import pytest

from quern.llm import edit_counts
from quern.llm.bpe import TrieBPE

tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_random_edits_match_full_encoding():
    bpe = TrieBPE(PATH)
    whole = tokenizers.Tokenizer.from_file(PATH)
    count, rng = edit_counts.EditCounter(bpe), random.Random(5)
    letters = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "1", "12", "!", "é", "中", "😀", "\t"]
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(400):
        text = make(rng.choice([0, 1, 5, 40, 400, 1500]))
        tree = count.build(text)
        for _ in range(6):
            start = rng.randint(0, len(text) + 2)
            text, _ = count.edit(tree, text, start, start + rng.choice([0, 1, 3, 50]), make(rng.choice([0, 1, 4, 30])))
            assert tree.total == len(whole.encode(text, add_special_tokens=False).ids)
            assert tree.chars[1] == len(text) == sum(map(sum, tree.lengths))
            again = edit_counts._unpacked(edit_counts._packed(tree))
            assert again.total == tree.total


def test_special_tokens_are_boundaries_in_the_tree():
    bpe = TrieBPE(PATH)
    whole = tokenizers.Tokenizer.from_file(PATH)
    count, rng = edit_counts.EditCounter(bpe), random.Random(7)
    letters = ["<|endoftext|>", "<|endof", "text|>", "<|", "|>", "text", "endoftext", " ", "  ", "\n\n", "a", "12"]
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(300):
        text = make(rng.choice([0, 2, 30, 200]))
        tree = count.build(text)
        for _ in range(6):
            start = rng.randint(0, len(text))
            text, _ = count.edit(tree, text, start, start + rng.choice([0, 1, 3, 20]), make(rng.choice([0, 1, 3])))
            assert tree.total == len(whole.encode(text, add_special_tokens=False).ids)
            assert [x for b in tree.lengths for x in b] == list(map(len, bpe.pieces(text)))
    text = "some words and <|endoftext|> " * 3000
    tree = count.build(text)
    text, again = count.edit(tree, text, 40_000, 40_002, "x")
    assert again < 40 and tree.total == len(whole.encode(text, add_special_tokens=False).ids)


def test_work_is_local(spark):
    docs = spark.createDataFrame([(1, "some words " * 5000, "x"), (2, None, None), (None, "", "y"), (1, "a", "z")], "doc_id long, text string, tree string")
    built = edit_counts.build(docs, PATH).withColumn("edits", edit_counts.F.expr("array(named_struct('start', 30000L, 'end', 30003L, 'text', 'ab cd'))"))
    rows = edit_counts.edit(built, PATH).collect()
    by = {(r.doc_id, r.tokens_before): r for r in rows}
    assert len(rows) == 4 and by[1, 10001].reencoded < 12 and by[1, 10001].pretokens > 9000
    assert by[2, 0].n_tokens > 0 and by[2, 0].text == "ab cd"


def test_words_of_a_batch_share_one_trie(spark, monkeypatch):
    """A batch's words go through one trie and no ids are spelt out; a memory that is full starts anew."""
    bpe = TrieBPE(PATH)
    whole = tokenizers.Tokenizer.from_file(PATH)
    count, calls, states = edit_counts.EditCounter(bpe), [], bpe.states
    monkeypatch.setattr(bpe, "states", lambda words: calls.append(len(words)) or states(words))
    texts = [f"word{i} and wording é{i}'s <|endoftext|> 中 " * 2 for i in range(50)] + ["", "<|endoftext|>"]
    trees = count.build_all(texts)
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [t.total for t in trees] == want and len(calls) == 1 and set(bpe.ids) == set(bpe.special)
    count.known.update((str(-i), 1) for i in range(400_001))
    assert count.build(texts[3] + " new").total == len(whole.encode(texts[3] + " new", add_special_tokens=False).ids)
    assert len(count.known) < 100
