"""The similarity join against all pairs."""

import random

from quern.llm import jaccard


def shingles(text):
    words = (text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset({tuple(words)}) if words else frozenset())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups, equal = {}, {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
        if sets[i]:
            equal.setdefault(sets[i], []).append(doc)
    least = lambda x: min((d for d in x if d is not None), default=None)
    return sorted(((doc, least(groups[find(i)]), least(equal[sets[i]]) if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(rows)), key=repr)


def corpus(rng, n=150, cluster=60):
    text = lambda k: [rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(k)]
    line, big = text(9), text(300)
    rows = []
    for i in range(n):
        words = text(rng.choice([3, 7, 40, 200]))
        rows.append(line + words)
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(line + words)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice("xyz")
            rows.append(near)
    for _ in range(cluster):
        near = list(big)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = rng.choice("xyz")
        rows.append(near)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rows += [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "one two"), (10_004, "one  two"), (5, rows[5][1]), (10_005, "x " * 400)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in df.collect()), key=repr)


def test_against_all_pairs(spark, monkeypatch):
    rows = corpus(random.Random(8))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rep string")
    assert result(jaccard.join(docs)) == brute(rows)


def test_large_buckets_are_split_and_tiled(spark, monkeypatch):
    rows = corpus(random.Random(9), 60, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    split, tiled = jaccard._buckets, jaccard._tiles
    levels = []
    monkeypatch.setattr(jaccard, "_buckets", lambda classes, docs, width: split(classes, docs, width, 12))
    deeper = jaccard._next_paths
    monkeypatch.setattr(jaccard, "_next_paths", lambda *a: levels.append(1) or deeper(*a))
    monkeypatch.setattr(jaccard, "_tiles", lambda leaves, classes: tiled(leaves, classes, 12))
    got, want = result(jaccard.join(docs)), brute(rows)
    assert sum(r[3] for r in got) >= 0.99 * sum(r[3] for r in want)
    assert sum(a[:3] != b[:3] for a, b in zip(got, want)) <= 2
    assert levels  # some buckets took three tokens and more
    made = jaccard.pairs(docs).collect()
    assert len({(r.a, r.b) for r in made}) == len(made)


def test_recall_on_documents(spark):
    """Pairs of likeness 0.8 and more that are found, of all that there are on the smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got, want = result(jaccard.join(docs)), brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[3] for r in got) >= jaccard.RECALL * sum(r[3] for r in want) > 0
    assert jaccard.runs_for(0.99) < jaccard.RUNS < jaccard.runs_for(0.9999)


def test_first_of_each(spark):
    long = " ".join(f"w{i}" for i in range(80))
    near = long.replace("w5 ", "x ")
    rows = [(7, "quite another text that stays", "a"), (1, long, "b"), (7, near, "c"), (9, long, "d"), (1, long, "b"), (None, long, "e"), (None, "alone without an id in here", "f"), (4, None, "g"), (4, "", "h"), (4, "", "h"), (8, "two texts of one id are two rows", "i"), (8, "and so this one stays here as well", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    assert sorted(r.n for r in jaccard.first_of_each(docs).collect()) == ["a", "b", "f", "g", "h", "h", "i", "j"]
    assert jaccard.first_of_each(docs.limit(0)).columns == docs.columns


def test_empty_and_alone(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert result(jaccard.join(docs)) == [(1, 1, 1, 0)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_near_copies_without_id(spark):
    rng = random.Random(10)
    rows = corpus(rng, 60, 40)
    near = lambda t: " ".join(["x", *t.split()[1:]])
    long = [t for _, t in rows if t and len(t.split()) > 40]
    alone = " ".join(f"w{k}" for k in range(90))
    rows += [(None, near(t)) for t in long[:50]] + [(None, long[0]), (None, alone), (None, near(alone)), (None, near(alone)), (None, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(jaccard.join(docs)) == want
    assert result(jaccard.join(docs.withColumn("doc_id", jaccard.F.lit(None).cast("long")))) == sorted(((None, None, None, r[3]) for r in want), key=repr)
