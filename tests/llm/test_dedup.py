"""Exact and near duplicates, lines and benchmark windows against brute force on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from qacorpus.llm import line_dedup, minhash_dedup, near
from qacorpus.llm.components import components
from qacorpus.llm.decontaminate import contamination
from qacorpus.llm.exact_dedup import exact_groups
from qacorpus.llm.line_dedup import dedup_lines
from qacorpus.llm.minhash_dedup import near_groups

DOCS = "doc_id long, text string, key string, n int"


def docs(spark, texts):
    """Rows with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)


def lower(text):
    return (text or "").translate({a: a + 32 for a in range(65, 91)})


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_exact_groups(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "ÄB"), (6, "äB"), (7, "x" * 70_000), (8, "X" * 70_000), (9, "x" * 64 + "y"), (10, "x" * 64 + "z"), (1, "Ab"), (None, "ab")]
    got = exact_groups(docs(spark, rows), digest_all=True).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    for r in got:
        t = next(t for t, ids in by.items() if r.id in ids and hashlib.sha256(t.encode()).hexdigest() == r.full_hash)
        assert (r.group_size, r.keep_id) == (len(by[t]), max(i for i in by[t] if i is not None))
        assert r.kept == (r.id == r.keep_id)


def test_exact_groups_hash_only_survivors(spark):
    got = {r.id: r.full_hash for r in exact_groups(docs(spark, [(1, "a"), (2, "b"), (3, "a")])).collect()}
    assert got[2] is None and got[1] == got[3] == hashlib.sha256(b"a").hexdigest()


def test_no_rows(spark):
    none, items = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert exact_groups(none).count() == near_groups(none).count() == dedup_lines(none).count() == contamination(none, items).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = Union()
    for a, b in edges:
        want.join(a, b)
    assert got == {x: want.find(x) for x in want.up if x != 7 or True}


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    of, union = {i: sets(t) for i, t in rows}, Union()
    for i in of:
        for j in of:
            both = len(of[i] & of[j])
            if i < j and of[i] and of[j] and 100 * both >= 75 * (len(of[i]) + len(of[j]) - both):
                union.join(i, j)
    return {i: (len(of[i]), union.find(i)) for i in of}


def family(rng, base, n, edits):
    """Copies of a text with a few words changed each."""
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("small", [near.SMALL, 4])
def test_near_groups_against_brute_force(spark, monkeypatch, small):
    """With small buckets of 4 the pivot and prefix steps do the work."""
    monkeypatch.setattr(near, "SMALL", small)
    rng = random.Random(3)
    texts = [None, "", "  \n", "one two", "One TWO", "one two three four five", "x " * 3000]
    for size, n in ((40, 60), (120, 40), (400, 8)):
        texts += family(rng, " ".join(f"t{rng.randrange(10**6)}" for _ in range(size)), n, size // 12)
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(12)) + " " + passage for _ in range(40)]
    rows = list(enumerate(texts, 1))
    got = {r.id: (r.n_shingles, r.component_id) for r in near_groups(docs(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_near_groups_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    got = near_groups(docs(spark, [(5, text), (5, text), (None, text), (9, text), (None, "alone")])).collect()
    assert sorted((r.id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (9, 5, False)]


def test_near_groups_link_through_null_and_repeated_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near_to = lambda *ks: " ".join("x" if k in ks else w for k, w in enumerate(base))
    other = " ".join(f"u{k}" for k in range(40))
    comp = lambda rows: sorted((r.id or 0, r.component_id or 0) for r in near_groups(docs(spark, rows)).collect())
    # a chain whose middle has no id: the ends are too far apart
    assert comp([(1, near_to()), (None, near_to(5)), (2, near_to(5, 30))]) == [(0, 1), (1, 1), (2, 1)]
    # near copies of the first text of an id that stands on two rows
    assert comp([(1, near_to()), (1, other), (2, near_to(7)), (3, near_to(50))]) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    # one id holds two texts together
    assert comp([(5, near_to()), (5, other), (3, near_to(7)), (4, other + " more")]) == [(3, 3), (4, 3), (5, 3), (5, 3)]


def test_a_shared_passage_makes_few_comparisons(spark, monkeypatch):
    """10,000 documents of 50 words share 82 % of their shingles: no pair reaches 0.75, and hardly any is compared."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(86))
    rows = [(k, " ".join(f"u{rng.randrange(10**8)}" for _ in range(18)) + " " + passage) for k in range(10_000)]
    compared = []
    plain = minhash_dedup._verify(5)
    monkeypatch.setattr(minhash_dedup, "_verify", lambda words: lambda p, s, t: compared.append(near.staged(p, "p")) or plain(compared[-1], s, t))
    got = near_groups(docs(spark, rows)).where("kept").count()
    assert got == 10_000 and sum(p.count() for p in compared) < 1_000_000


def brute_hits(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            v = words(text)
            n = min(13, len(v))
            for a in range(len(v) - n + 1) if v else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[a : a + n]:
                        hit.update(range(s, s + n))
                        found.add(str(name))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_contamination_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "Été", "a1", "x", "zz", "ion", "er"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([40, 13, 14, 12, 3, 2, 1, 60])] + [(20, None), (21, "..."), (22, "Solo")]
    rows = [(0, None), (1, ""), (2, "solo. SOLO"), (3, "!?")]
    for k in range(4, 40):
        text = [word() for _ in range(rng.randint(0, 60))]
        if k % 2:
            text[rng.randint(0, len(text)) : 0] = items[k % 8][1].split()[: rng.choice([12, 13, 60])]
        rows.append((k, ", ".join(text)))
    rows.append((40, " ".join(i for _, i in items[:8]) * 30))
    got = {r.id: (r.n_words, r.n_hit, r.item_list) for r in contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_hits(rows, items)


def test_contamination_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(20))
    items = spark.createDataFrame([(1, text), (1, text), (None, text)], "item_id long, text string")
    got = contamination(docs(spark, [(7, text), (7, text), (None, text)]), items).collect()
    assert [(r.n_words, r.n_hit, r.item_list) for r in got] == [(20, 20, ["1"])] * 3


def chars(line):
    s = lower(line.strip(" \t\r\x0b\x0c"))
    return frozenset(s[k : k + 8] for k in range(max(1, len(s) - 7))) if s else frozenset()


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "tiny\nTINY \nother"), (5, base[0] + "\n" + "z" * 300)]
    for k in range(6, 60):
        part = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(base))
            if rng.random() < 0.7:
                x[rng.randrange(90)] = rng.choice("XYZ")
            part.append("".join(x))
        rows.append((k, "\n".join(part)))
    lines = [(i, a, x) for i, t in rows for a, x in enumerate((t or "").split("\n")) if chars(x)]
    union = Union()
    for k, (_, _, x) in enumerate(lines):
        for m in range(k):
            p, q = chars(x), chars(lines[m][2])
            both = len(p & q)
            if 100 * both >= 85 * (len(p) + len(q) - both):
                union.join(m, k)
    gone = {(i, a) for k, (i, a, _) in enumerate(lines) if union.find(k) != k}
    got = {r.id: r for r in dedup_lines(docs(spark, rows)).collect()}
    for i, t in rows:
        kept = [x for a, x in enumerate((t or "").split("\n")) if (i, a) not in gone]
        assert got[i].dropped == sorted(a for j, a in gone if j == i)
        assert got[i].text == (None if t is None else "\n".join(kept))
        assert got[i].n_lines == sum(j == i for j, _, _ in lines)


def test_lines_of_repeated_rows(spark):
    long = "a line of more than eight characters"
    got = dedup_lines(docs(spark, [(1, long), (1, long), (2, long), (None, "x\n\ny"), (None, "x\n\ny"), (3, None), (3, None)])).collect()
    assert sorted((r.id or 0, r.text or "", r.n_lines, r.n_dropped) for r in got) == sorted(
        [(1, long, 1, 0), (1, "", 1, 1), (2, "", 1, 1), (0, "x\n\ny", 2, 0), (0, "", 2, 2), (3, "", 0, 0), (3, "", 0, 0)])


def test_operators_ignore_other_columns(spark):
    clash = docs(spark, [(1, "a b c d e f"), (2, "a b c d e f")]).withColumn("row", F.lit(1)).withColumn("component", F.lit("c")).withColumn("w", F.lit(0))
    assert [r.kept for r in near_groups(clash).orderBy("id").collect()] == [True, False]
    assert dedup_lines(clash).where("n_dropped = 1").count() == 1
    assert contamination(clash, spark.createDataFrame([(1, "b c d")], "item_id long, text string")).where("n_hit = 3").count() == 2


@pytest.mark.parametrize("tile", [512, 7])
def test_large_buckets_of_lines_are_compared_without_shingle_rows(spark, monkeypatch, tile):
    """Lines of one template share band keys, but few are linked: no table of their shingles, and all links of the buckets."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    lines = []
    for _ in range(60):
        x = list(base)
        for at in rng.sample(range(400), rng.choice([1, 3, 5, 7])):
            x[at] = rng.choice("XYZ")
        lines.append("".join(x))
    monkeypatch.setattr(line_dedup, "TILE", tile)
    plain, kinds = near.staged, []
    monkeypatch.setattr(near, "staged", lambda df, kind: kinds.append(kind) or plain(df, kind))
    bands = line_dedup.line_bands([lower(x) for x in lines])
    sets, union = [chars(x) for x in lines], Union()
    for k in range(60):
        for m in range(k):
            both = len(sets[k] & sets[m])
            if 100 * both >= 85 * (len(sets[k]) + len(sets[m]) - both) and set(bands[k]) & set(bands[m]):
                union.join(m, k)
    got = {r.id: r.n_dropped for r in dedup_lines(docs(spark, list(enumerate(lines)))).collect()}
    assert got == {k: int(union.find(k) != k) for k in range(60)} and "tokens" not in kinds
