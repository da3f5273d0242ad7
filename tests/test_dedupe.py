"""Exact and fuzzy duplicates against one-by-one scans."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from qacorpus.operators import dedupe, fuzzy


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord bigint, question string")


def kept(df):
    return sorted(r["ord"] for r in df.select("ord").collect())


def test_exact_variants(spark):
    texts = ["What is MI?", " what is mi? ", "what  is mi?", "", None, "   ", "Other", "what is MI?"]
    df = frame(spark, texts)
    assert kept(dedupe.dedupe_exact(df)) == [0, 2, 6]
    assert kept(dedupe.dedupe_hash(df)) == [0, 6]
    assert kept(dedupe.dedupe_raw(df)) == [0, 1, 2, 3, 5, 6, 7]


def test_first_wins_whatever_the_partitioning(spark):
    df = frame(spark, [f"q {i % 7}" for i in range(500)]).repartition(13)
    assert kept(dedupe.dedupe_hash(df)) == list(range(7))


def test_exclusion_and_increment(spark):
    seen = frame(spark, ["A b", "c"])
    new = frame(spark, ["a  B", "d", "D ", "", "e"])
    assert kept(dedupe.exclude_seen(new, seen)) == [1, 2, 3, 4]
    assert kept(dedupe.dedupe_incremental(new, seen)) == [1, 4]
    assert dedupe.dedupe_report(new, dedupe.dedupe_incremental(new, seen)).first().asDict() == {
        "rows_in": 5, "rows_kept": 2, "rows_removed": 3
    }


def scan(texts, threshold=0.9, autojunk=True):
    """The rule, one row after the other."""
    out, normal = [], []
    for i, t in enumerate(texts):
        t = (t or "").strip().lower()
        if not t:
            continue
        n = re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", t))
        if not any(SequenceMatcher(None, n, k, autojunk).ratio() > threshold for k in normal):
            normal.append(n)
            out.append(i)
    return out


def corpus(seed, n, length):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:  # edit an earlier text a little: chains of near copies
            t = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, max(1, len(t) // 12))):
                p = rnd.randrange(len(t))
                t[p : p + 1] = rnd.choice(["", rnd.choice("abcdefgh "), t[p] + rnd.choice("xyz")])
            texts.append("".join(t) or "x")
        else:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, length))))
    return texts


@pytest.mark.parametrize("seed,length,autojunk", [(1, 6, True), (2, 12, False), (3, 45, True), (4, 45, False)])
def test_fuzzy_equals_the_scan(spark, seed, length, autojunk):
    texts = corpus(seed, 150, length) + ["", "?!", "!?", None]
    # small tiles: many tile pairs
    got = kept(fuzzy.dedupe_fuzzy(frame(spark, texts).repartition(5), autojunk=autojunk, tile_weight=12_000))
    assert got == scan(texts, autojunk=autojunk)


def test_fuzzy_chain_is_greedy_not_transitive(spark):
    a = "abcdefghijklmnopqrst"
    b = a[:-2] + "XY"  # 0.9: not above
    c = a[:-1] + "Z"  # a~c
    d = c[:-2] + "WZ"  # c~d, a and d differ more
    texts = [a, b, c, d]
    assert kept(fuzzy.dedupe_fuzzy(frame(spark, texts))) == scan(texts)


def test_fuzzy_hot_group_of_near_copies(spark):
    base = "how should somebody treat a cold that has lasted for many weeks without any fever number "
    texts = [base + str(i) for i in range(400)] + ["something else entirely " + "xyz" * 5]
    assert kept(fuzzy.dedupe_fuzzy(frame(spark, texts), tile_weight=100_000)) == [0, 400]


def test_fuzzy_shuffles_no_text_for_the_tiles_it_meets(spark, monkeypatch, capsys):
    """What goes through an exchange for each tile pair grows with the square of the texts."""
    plans, write = [], fuzzy.write_out

    def written(df, kind="stage", **options):
        if kind == "round":
            capsys.readouterr()
            df.explain(mode="formatted")
            plans.append(capsys.readouterr().out)
        return write(df, kind, **options)

    monkeypatch.setattr(fuzzy, "write_out", written)
    texts = corpus(8, 150, 20)
    assert kept(fuzzy.dedupe_fuzzy(frame(spark, texts), autojunk=False, tile_weight=6_000)) == scan(texts, autojunk=False)
    assert len(plans) > 1  # later rounds too
    sections = [x for plan in plans for x in plan.split("\n\n") if re.match(r"\s*\(\d+\) (Broadcast)?Exchange", x)]
    # a target tile may be dealt out once, as one row
    assert sections and not [x for x in sections if "norm" in x and "rangepartitioning(t_tile" not in x]


def test_the_pair_filter_loses_no_pair_and_makes_few():
    """Long unrelated texts of one vocabulary share their runs of three characters; the filter must still tell them apart."""
    texts = corpus(5, 60, 300) + corpus(6, 20, 8) + ["", "a"]
    letters = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    codes = fuzzy._codes(texts, letters)
    t, s = (x.ravel() for x in np.indices((len(texts), len(texts))))
    sizes = np.array([len(x) for x in texts])
    common = np.array([fuzzy._common_subsequence(fuzzy._positions(texts[i]), len(texts[i]), texts[j]) for i, j in zip(t, s)])
    whole = fuzzy._Subsequences(codes, codes, np.arange(len(letters)), len(letters))
    assert (whole.unmatched(t, s) == sizes[t] + sizes[s] - 2 * common).all()
    may = fuzzy._PairFilter(codes, codes, len(letters))
    room = np.empty((2, len(texts)), np.int32)
    bags = sizes[t] + sizes[s] - 2 * np.concatenate([may.shared(i, len(texts), *room).copy() for i in range(len(texts))])
    limit = 0.1 * (sizes[t] + sizes[s]) + 1.0
    passed = np.zeros(len(t), bool)
    passed[may(t, s, bags, limit)] = True
    similar = sizes[t] + sizes[s] - 2 * common < limit
    assert not (similar & ~passed).any() and passed.sum() < 2 * similar.sum()


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.6])
def test_shared_runs_lose_no_pair_and_leave_few(threshold):
    """One matrix product over all pairs must pass every similar pair; of unrelated texts it passes few."""
    texts = corpus(7, 150, 25) + ["", "a", "ab"]
    letters = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    codes = fuzzy._codes(texts, letters)
    n = len(texts)
    t, s = fuzzy._SharedRuns(codes, codes, len(letters), threshold).pairs(0, n, np.arange(n))
    passed = set(zip(t.tolist(), s.tolist()))
    similar = set()
    for i in range(n):
        for j in range(i):
            common = fuzzy._common_subsequence(fuzzy._positions(texts[i]), len(texts[i]), texts[j])
            if 2 * common > threshold * (len(texts[i]) + len(texts[j])):
                similar.add((i, j))
    assert similar and not similar - passed
    assert threshold < 0.9 or len(passed) < 2 * len(similar) + n
