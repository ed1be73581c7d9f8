"""Removal of repeats against a plain loop over all windows."""

import gc
import random
import weakref

import numpy as np

from quern.llm import common, groups, substring


def brute(rows, width=13):
    words = {i: (text or "").split() for i, (_, text) in enumerate(rows)}
    first = {}
    big = 1 << 62
    for i, (doc, _) in enumerate(rows):
        for j in range(len(words[i]) - width + 1):
            key = tuple(words[i][j : j + width])
            first[key] = min(first.get(key, big), big if doc is None else doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        gone = set()
        for j in range(len(words[i]) - width + 1):
            if first[tuple(words[i][j : j + width])] < (big if doc is None else doc):
                gone.update(range(j, j + width))
        out.append((doc, len(words[i]), len(gone), " ".join(w for k, w in enumerate(words[i]) if k not in gone)))
    return sorted(out, key=repr)


def corpus(rng, n=120):
    text = lambda k: " ".join(rng.choice(["a", "bb", "é", "中x", "d"]) + str(rng.randint(0, 40)) for _ in range(k))
    passages = [text(k) for k in (12, 13, 20, 60)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i * 2, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(i, rows[5][1]) for i in range(1001, 1030)]
    rows += [(None, rows[7][1]), (3, None), (9, ""), (11, "  "), (14, rows[7][1]), (14, rows[7][1]), (2000, "same " * 500)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(2))
    monkeypatch.setattr(groups, "GROUP_BYTES", 4000)
    monkeypatch.setattr(groups, "RANGE_KEYS", 500)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, kept int")
    got = substring.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "source", "kept_in", "kept", "n_words", "n_removed"]
    assert result(got) == brute(rows)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_batches_and_compaction(spark, tmp_path):
    rows = sorted((r for r in corpus(random.Random(4)) if r[0] is not None), key=lambda r: r[0])
    index = substring.SubstringIndex(spark, str(tmp_path / "index"), bits=2)
    got = []
    for low, high in ((0, 60), (60, 150), (150, 1010), (1010, 5000)):
        batch = [r for r in rows if low <= r[0] < high]
        got += result(substring.remove_repeats(spark.createDataFrame(batch, "doc_id long, text string"), index))
    assert sorted(got, key=repr) == brute(rows)
    assert index.runs() <= 2 and index.generation > 0
    reopened = substring.SubstringIndex(spark, str(tmp_path / "index"), bits=2)
    assert reopened.generation == index.generation and reopened.runs() == index.runs()
    index.remove()


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_polynomials_stay(spark):
    one, other = thue_morse(2048)
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}
    # windows of two words in the same pattern
    pattern, inverse = (" ".join({"a": "left", "b": "right"}[c] for c in w[:13]) for w in (one, other))
    docs = spark.createDataFrame([(1, pattern), (2, inverse)], "doc_id long, text string")
    assert {r.n_removed for r in substring.remove_repeats(docs).collect()} == {0}


def test_passages_are_verified_by_words(spark):
    docs = spark.createDataFrame([(1, "a b  c\nd"), (1, "x y z"), (1, "z x"), (2, "a b")], "doc_id long, text string")
    packed = groups.pack(docs, 1)
    member = (2, 0, 2, groups.code(np.array([1, 2], dtype=np.uint64)), None, None, None)
    passages = [(1, b"there", b"b c d"), (1, b"other row", b"x y z"), (1, b"half a word", b"b c"), (2, b"not", b"b c"), (1, b"cut", b"y"), (1, b"two places", b"z x y")]
    found = spark.createDataFrame([member, *((1, 0, 0, None, *p) for p in passages)], "kind int, grp long, n long, places binary, source long, digest binary, passage binary")
    assert [bytes(r.digest) for r in substring._unverified(packed, found, 2).collect()] == [b"not"]
    assert substring.check_bytes(1 << 20) == 1 and substring.check_bytes(1 << 45) == 6


def test_heaps_are_given_back_between_steps(spark, monkeypatch):
    """Garbage of one step does not stand beside the next step's memory."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    collected = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    before = collected()
    docs = spark.createDataFrame([(i, f"some words {i % 3} " * 20) for i in range(12)], "doc_id long, text string")
    assert substring.remove_repeats(docs, batches=1).count() == 12
    assert collected() > before


def test_a_run_that_nothing_asks_is_deleted(spark, monkeypatch):
    """Answers are read when the index of a single call no longer holds its merged run."""
    rows, held = corpus(random.Random(6)), []
    found = substring._found

    def watched(packed, answers, width, check):
        made = [x for x in spark.catalog.listTables() if x.name.startswith("quern_index_")]
        held.extend(spark.table(x.name).filter("grp < 0 AND n > 0").select("batch").distinct().count() for x in made if x.name.endswith("_1"))
        return found(packed, answers, width, check)

    monkeypatch.setattr(substring, "_found", watched)
    assert result(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert held == [0]


def test_runs_that_are_merged_are_deleted(spark, monkeypatch):
    """A compaction leaves the answers of the generation before, not its runs, so that these do not stand beside the next batch."""
    rows, runs, answers = corpus(random.Random(8)), [], []
    compact = substring.SubstringIndex.compact

    def watched(index, *args):
        old = index.generation
        compact(index, *args)
        if index.generation > old:
            before = spark.table(index._name(old))
            runs.append(before.filter("grp < 0").count())
            answers.append(before.filter("grp >= 0").count())

    monkeypatch.setattr(substring.SubstringIndex, "compact", watched)
    assert result(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert runs == [0] and answers[0] > 0


def test_release_leaves_out_what_lives_all_along():
    """Modules are looked through once, not after every group; what a group leaves is still collected."""

    class Node:
        pass

    gc.unfreeze()
    try:
        common.release()
        known = len(gc.get_objects())
        assert gc.get_freeze_count() > known
        node = Node()
        node.me, gone = node, weakref.ref(node)
        del node
        common.release()
        assert gone() is None
    finally:
        gc.unfreeze()  # this process ends like any other


def test_order_of_hashes_that_tie_or_clash():
    rng = np.random.default_rng(3)
    for kinds in (1, 7, 1 << 40):
        key = rng.integers(0, kinds, 2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for check in (key >> np.uint64(56), rng.integers(0, 3, 2000).astype(np.uint64)):
            order, new = substring._order(key, check)
            assert (order == np.lexsort((check, key))).all()
            assert new.sum() == len(set(zip(key.tolist(), check.tolist())))
