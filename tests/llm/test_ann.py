"""Nearest neighbours against all inner products."""

import numpy as np

from quern.llm import ann


def brute(rows, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in {(q, tuple(x)): (q, x) for q, x in good if q % 5 == 0}.values():
        scored = sorted({(-float(ann.exact(x[None], y[None])[0]), c) for c, y in good if c != q and len(y) == len(x)})
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(7, rows[7][1]), (2000, None), (2005, [0.0] * 16), (2010, [float("nan")] * 16), (2015, [1.0] * 15 + [None]), (None, rows[3][1]), (2020, [1e30] + [1e-3] * 15), (2025, [1.0, 2.0]), (2026, [3.0, 4.0]), (2030, [])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    want = brute([(r.vec_id, r.embedding) for r in docs.collect()], 20)
    for block in (1024, 32):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = sorted(tuple(r) for r in ann.nearest(docs, ann.F.col("vec_id") % 5 == 0).collect())
        assert got == want
    assert ann.nearest(docs.limit(0), ann.F.lit(True)).count() == 0
    assert [tuple(r)[:3] for r in ann.nearest(docs.filter("vec_id IN (2025, 2026)"), ann.F.col("vec_id") == 2025).collect()] == [(2025, 1, 2026)]


def test_rows_repeated_more_than_k_times(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    best = [3 * x for x in rows[0][1]]
    rows += [(501, best)] * 25 + [(502, [2.9 * x for x in rows[0][1]])] * 30 + [(7, rows[7][1])] * 22
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    want = brute([(r.vec_id, r.embedding) for r in docs.collect()], 20)
    got = sorted(tuple(r) for r in ann.nearest(docs, ann.F.col("vec_id") % 5 == 0).collect())
    assert got == want and len(got) == 20 * 40
