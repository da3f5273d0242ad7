"""The signature-tree join against brute force on small tables."""

import random
import re

import numpy as np
import pytest

from qacorpus.llm import signature_join as sj
from qacorpus.llm.circulant import shingle_set
from qacorpus.llm.near import Threshold

DOCS = "doc_id long, text string, node string, component int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def lower(text):
    return (text or "").translate({a: a + 32 for a in range(65, 91)})


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    """(n, component) of each row; components by rows, ids of all rows."""
    of = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(of[i] & of[j])
            if of[i] and of[j] and 100 * both >= 85 * (len(of[i]) + len(of[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    smallest = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((i, len(of[k]), smallest[find(k)] if of[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(50)]
    texts = [None, "", " \n", "one two", "One TWO", "one two three four", "x " * 2_000, "a b " * 500]
    for size, n in ((12, 20), (40, 50), (120, 40), (500, 8)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 50))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                texts.append(" ".join(copy).upper())
    for tail in (6, 8, 10, 12, 14, 30):  # shares of the passage around the limit
        texts += [" ".join([word() for _ in range(tail)] + passage) for _ in range(12)]
    texts += [" ".join(passage[:k]) for k in range(40, 51)]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("options", [{}, {"tile": 900}, {"hot_least": 3, "hot_share": 0.02}])
def test_against_brute_force(spark, options):
    """Small tiles cut groups into pairs of tiles; with a low limit shared passages are hot shingles."""
    rows = corpus(5)
    got = sorted((tuple(r) for r in sj.jaccard_components(docs(spark, rows), **options).collect()), key=repr)
    assert got == brute(rows)


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    unlike = " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))
    rows = [(5, " ".join(base)), (5, unlike), (None, near(59)), (9, near(59)), (None, unlike), (None, "alone it stands"), (5, unlike), (None, None)]
    got = sorted((tuple(r) for r in sj.jaccard_components(docs(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_no_rows(spark):
    assert sj.jaccard_components(docs(spark, [])).count() == 0


def test_trees_lose_no_link():
    """All linked pairs end in one component, for trees of unlike heights, too, and unrelated sets are pruned by bitmaps."""
    rng = np.random.default_rng(7)
    t = Threshold(85, 100)
    for trial in range(20):
        pool = [np.unique(rng.integers(0, 1 << 63, size=rng.integers(1, 120)).astype(np.uint64)) for _ in range(6)]
        many = []
        for _ in range(int(rng.integers(2, 90))):
            s = pool[rng.integers(6)]
            keep = s[rng.random(len(s)) > rng.choice([0.0, 0.04, 0.08, 0.3])]
            many.append(np.unique(np.append(keep, rng.integers(0, 1 << 63, size=rng.integers(0, 4)).astype(np.uint64))) if len(keep) else s)
        sides = [0] * len(many) if trial % 2 else (rng.random(len(many)) < 0.15).astype(int).tolist()
        links = sj.linked(list(range(len(many))), many, sides, t)
        up = list(range(len(many)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for u, v in links:
            assert t.holds(len(np.intersect1d(many[u], many[v])), len(many[u]), len(many[v]))
            up[find(u)] = find(v)
        for u in range(len(many)):
            for v in range(u):
                if (any(sides) and sides[u] == sides[v]) or not t.holds(len(np.intersect1d(many[u], many[v])), len(many[u]), len(many[v])):
                    continue
                assert find(u) == find(v)


def test_bitmaps_prune_a_shared_passage(monkeypatch):
    """Texts that share 80 % don't reach the threshold: node pairs go by their bitmaps, hardly a pair is compared."""
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 1 << 63, size=400).astype(np.uint64)
    many = [np.unique(np.append(passage, rng.integers(0, 1 << 63, size=100).astype(np.uint64))) for _ in range(300)]
    calls = []
    monkeypatch.setattr(sj, "overlap", lambda x, y: calls.append(1) or len(np.intersect1d(x, y)))
    assert sj.linked(list(range(300)), many, [0] * 300, Threshold(85, 100)) == []
    assert len(calls) < 1_000


def test_shingles_are_words():
    assert len(shingle_set("a b c d e", sj.WORDS)) == 2
