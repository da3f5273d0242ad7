"""Collocations against a plain count of all phrases on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from qacorpus.llm.collocations import Words, _cut, collocations, lang_salt

DOCS = "doc_id long, text string, lang string, symbols int, n long"


def lower(text):
    return (text or "").translate({a: a + 32 for a in range(65, 91)})


def brute(rows, top=2_000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= 100 and len(p[1]) > 1}
    inside = {(lang, w[i:j]) for (lang, w), a in cand.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and a >= f[lang, w[i:j]]}
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) in inside:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, m, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for m, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def corpus(seed):
    rng = random.Random(seed)
    names = ["the", "New", "york", "times", "été", "o'neil", "a", "b", "c", "x" * 1_500, "กข", "Ä"]
    rows = [(None, "en"), ("", "en"), (" .,;\n\t", None), ("\x00odd\x00 \x01", "fr")]
    for _ in range(2_500):
        words = [rng.choice(names) for _ in range(rng.randint(1, 40))]
        words[rng.randrange(len(words)) : 0] = rng.choice([["New", "York", "Times"], ["a", "b", "c", "d", "e", "f"], ["la", "la", "la", "la"], ["rare%d" % rng.randrange(10**6)]])
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".\n"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + rows[:150]


@pytest.mark.parametrize("budget", [1 << 18, 500, 150])
def test_against_plain_counts(spark, budget):
    """With small budgets heavy prefixes grow word by word up to the full depth, and there are many groups."""
    rows = corpus(4)
    df = spark.createDataFrame([(1, t, lang, 0, 0) for t, lang in rows], DOCS)
    got = sorted(tuple(r) for r in collocations(df, budget=budget).collect())
    assert got == brute(rows) and len({r[0] for r in got}) >= 3


def test_top_and_ties(spark):
    rows = [(f"a{k} b{k}. ", "en") for k in range(9)] * 100
    df = spark.createDataFrame([(1, t, lang, 0, 0) for t, lang in rows], DOCS)
    got = sorted(tuple(r) for r in collocations(df, top=4).collect())
    assert got == brute(rows, 4) and [r[2] for r in got] == ["a0 b0", "a1 b1", "a2 b2", "a3 b3"]


def test_nothing_frequent(spark):
    assert collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b c", "en", 0, 0), (2, None, None, 0, 0)], DOCS)).count() == 0


def test_long_texts_are_cut_at_piece_ends():
    text = b"word " * 300_000 + b". " + b"next " * 500_000 + b"!last " * 200_000
    parts = list(_cut(text))
    assert b"".join(parts) == text and len(parts) > 1 and all(p[-1:] in b".!" for p in parts[:-1])
    whole = Words([text], [lang_salt("en", 0)], 0).symbol
    cut = np.concatenate([Words([p], [lang_salt("en", 0)], 0).symbol for p in parts])
    assert (whole == cut).all()
