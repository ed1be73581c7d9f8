"""Budgets against a plain water-filling, selections against a plain scan."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quern.llm import mixing
from quern.llm.queries import DOMAIN_SQL

F = mixing.F


def fill(total, children):
    """Shares by weight, none above its cap; children: name -> (cap, weight)."""
    out, left, open_ = {}, total, dict(children)
    while open_:
        level = left / sum(w for _, w in open_.values())
        full = {n for n, (c, w) in open_.items() if c / w <= level}
        if not full:
            return out | {n: level * w for n, (_, w) in open_.items()}
        for n in full:
            out[n] = open_.pop(n)[0]
            left -= out[n]
    return out


def budgets(leaves, weights, total, epochs):
    def share(prefix, amount):
        if len(prefix) == 3:
            return {prefix: amount}
        caps = defaultdict(float)
        for path, n in leaves.items():
            if path[: len(prefix)] == prefix:
                caps[path[: len(prefix) + 1]] += n * epochs
        got = fill(amount, {p: (c, max(1e-9, weights.get(p, 1.0))) for p, c in caps.items()})
        out = {}
        for p, a in got.items():
            out |= share(p, a)
        return out

    return {p: int(a + 1e-6) for p, a in share((), min(total, sum(leaves.values()) * epochs)).items()}


@pytest.mark.parametrize("share,epochs", [(0.4, 1), (1.3, 3), (9.0, 2)])
def test_against_a_plain_scan(spark, share, epochs):
    rng = random.Random(5)
    rows = []
    for i in range(700):
        source = rng.choice(["src0", "src0", "src0", "src2", "src9", None])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["en", "de", None]), source))
    rows += [(900, None, "en", "src0"), (5, *rows[5][1:]), (None, "a b", "en", "src2")]
    weights = [("web", None, None, 0.2), ("books", None, None, 0.7), ("forums", None, None, 0.0), ("web", "en", None, 3.0)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, epoch int")
    given = spark.createDataFrame(weights, "domain string, lang string, source string, weight double")
    out = mixing.mix(docs, given, F.expr(DOMAIN_SQL), share, epochs, 7).collect()

    def leaf(lang, source):
        domain = "web" if source == "src0" else "books" if source in {f"src{i}" for i in range(1, 7)} else "forums"
        return domain, lang or "(none)", source or "(none)"

    size = lambda t: len((t or "").split())
    leaves = defaultdict(int)
    for _, t, lang, s in rows:
        leaves[leaf(lang, s)] += size(t)
    asked = budgets(leaves, {tuple(x for x in w[:3] if x): w[3] for w in weights}, int(sum(leaves.values()) * share), epochs)
    want = Counter()
    for path, budget in asked.items():
        mine = [(i, size(t)) for i, t, lang, s in rows if leaf(lang, s) == path]
        whole, rest = divmod(budget, leaves[path]) if leaves[path] else (0, 0)
        for i, n in mine:
            want.update((i, path, e, n) for e in range(whole))
        units = defaultdict(list)
        for i, n in mine:
            units[hashlib.md5(f"7:{whole}:{'' if i is None else i}".encode()).hexdigest()].append((i, n))
        start = 0
        for key in sorted(units):
            n = sum(x for _, x in units[key])
            if start < rest:
                each = (rest - start) // len(units[key])
                want.update((i, path, whole, min(x, each) if rest <= start + n else x) for i, x in units[key])
            start += n
    have = Counter((r.doc_id, leaf(r.lang, r.source), r.epoch, r.take_tokens) for r in out)
    assert have == want
    assert mixing.mix(docs.limit(0), given, F.expr(DOMAIN_SQL), share, epochs).count() == 0
    cut = [r for r in docs.withColumns({"n": mixing.tokens(F.col("text")), "p": mixing.text_prefix(F.col("text"), F.lit(5), F.lit(3))}).collect()]
    assert all(size(r.text) == r.n for r in cut) and all(r.p == " ".join((r.text or "").split()[:3]) for r in cut if r.text is not None)
