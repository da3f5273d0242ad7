"""The pipeline on planted rows against a plain Python version of its stages."""

import random
from collections import Counter

import corpus_pipeline
from qacorpus.llm.merge_dropout import Encoder


def lower(text):
    return text.translate({a: a + 32 for a in range(65, 91)})


def shingles(text):
    words = lower(text).split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def plain(rows, items):
    """Rows that stay: with a letter; the largest id of equal texts; the smallest of near copies; few words from items."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r)
    rows = [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    up = list(range(len(rows)))
    sets = [shingles(r[1]) for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                old, new = up[a], up[b]
                up = [new if x == old else x for x in up]
    rows = [min((rows[k] for k in range(len(rows)) if up[k] == c), key=lambda r: (r[0] is None, r[0] or 0)) for c in set(up)]
    kept = []
    for r in rows:
        words, hit = lower(r[1]).split(), set()
        for item in items:
            w = lower(item).split()
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
        if not (hit and 20 * len(hit) >= len(words)):
            kept.append(r)
    return kept


def test_run_on_planted_rows(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(2_000)]

    def text(n=60):
        return " ".join(rng.choices(vocabulary, k=n))

    items = [text(8), text(8)]
    base = [text() for _ in range(8)]
    close = [t + " end" for t in base]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(None, base[0].upper()), (50, base[1]), (50, base[1]), (None, base[2]), (None, base[2])]  # copies, repeated rows, null ids
    rows += [(None, close[3]), (60, close[4]), (60, text()), (4, text()), (70, close[5])]  # near copies; an id on unlike rows
    rows += [(None, text(30) + " " + items[0] + " " + text(30)), (80, items[1] + " " + text(20)), (80, text())]  # benchmark passages
    lonely = text()
    rows += [(None, lonely), (None, lonely), (None, None), (90, "12 !"), (91, ""), (92, "\U0001E900\U0001E901")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, encoder = corpus_pipeline.run(spark, str(tmp_path)).collect(), Encoder()
    assert all(r.lossless for r in got)
    want = plain(rows, items)
    assert Counter((r.doc_id, tuple(r.pieces)) for r in got) == Counter((i, tuple(encoder.encode(t, i).tolist())) for i, t in want)
