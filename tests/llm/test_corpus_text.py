"""Shards, pages, archives, personal data, pieces and languages on small tables."""

import binascii
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qacorpus.llm import merge_dropout, pii_crf
from qacorpus.llm.html_blocks import extract, main_text, second_pass
from qacorpus.llm.language_id import Model, encode, fit, identify, suffix_automaton
from qacorpus.llm.pii_crf import Field, base_spans, find_personal_data, labelled_table, stretches, tags_of, train
from qacorpus.llm.resharding import affected, min_cost_flow, reshard
from qacorpus.llm.warc import read_records, transactions, write_archives

ROWS = [(1, "a" * 50, "en"), (2, None, None), (3, "", "fr"), (1, "a" * 50, "en"), (None, "é" * 9, "x")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "k") for i, t, s in rows], "doc_id long, text string, source string, _block string")


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(4)
    for _ in range(30):
        m, n = rng.randint(1, 6), rng.randint(1, 8)
        supply = [rng.randint(0, 50) for _ in range(m)]
        capacity = [sum(supply) // n + (j < sum(supply) % n) for j in range(n)]
        flow = min_cost_flow(supply, capacity)
        assert [sum(b for (i, _), b in flow.items() if i == k) for k in range(m)] == supply
        assert all(sum(b for (_, j), b in flow.items() if j == k) <= capacity[k] for k in range(n))
        stay = sum(min(s, c) for s, c in zip(supply, capacity))
        assert sum(b for (i, j), b in flow.items() if i != j) == sum(supply) - stay


def test_flow_with_other_costs():
    flow = min_cost_flow([5, 5], [5, 5], lambda i, j: [[9, 1], [1, 9]][i][j])
    assert flow == {(0, 1): 5, (1, 0): 5} and affected(flow) == {0, 1}


def test_reshard_sizes_and_slots(spark):
    rng = random.Random(5)
    rows = ROWS + [(k, "ü" * int(rng.paretovariate(1.1) * 20), f"s{k % 3}") for k in range(10, 900)]
    got = reshard(frame(spark, rows), F.pmod(F.hash("source"), F.lit(5)), 5, 7)[0].collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.text or "-", r._size, r._crc) for r in got) == sorted(
        (i or 0, t or "-", len((t or "").encode()) + 8, binascii.crc32((t or "").encode())) for i, t, _ in rows
    )
    sizes = {}
    for r in got:
        sizes.setdefault(r._shard, []).append(r)
    for part in sizes.values():
        assert sorted(r._slot for r in part) == list(range(len(part)))
    bytes_ = [sum(r._size for r in sizes.get(k, [])) for k in range(7)]
    assert max(bytes_) - min(bytes_) <= max(r._size for r in got)


def test_reshard_leaves_balanced_shards_alone(spark):
    rows, flow = reshard(frame(spark, [(k, "x" * 10, "s") for k in range(8)]), F.pmod("doc_id", F.lit(4)), 4, 4)
    assert affected(flow) == set() and all(r._shard == r._old for r in rows.collect())
    assert reshard(frame(spark, []), F.lit(0), 1, 3)[0].count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>Head &amp; more</h1><p><b>Bold<br><p>First\n  par&eacute; &lt;x&gt;</p><p>To.</p><div class="comments"><p>Nice!</p></div>
<aside>side</aside><form><p>mail</p><input></form><ul class="related-links"><li><a href="/b">B</a></li></ul></article>
<footer>&copy; me</footer></body></html>"""


TEXT = "Head & more\nBold\nFirst paré <x>\nTo."


def test_main_text_of_a_marked_article():
    assert main_text(PAGE) == TEXT
    assert main_text(None) == main_text("") == main_text("<p></p><script>x") == main_text("<!-- open") == ""


def test_main_text_by_density():
    good = "This is the text of a page that has the words of the language in it and so it is kept for the reader. " * 3
    page = f"<body><div>Menu</div><p><a href=1>One</a> <a href=2>Two</a></p><p>{good}</p><p>Short one.</p><p>{good}</p><p>Brm krz plk vrt zzk. {'Qrx vlk ' * 40}</p></body>"
    assert main_text(page) == "\n".join([good.strip(), "Short one.", good.strip()])
    assert second_pass([-1, 0, -1, -1, 1, -1]) == [0, 0, 0, 1, 1, 1]
    assert second_pass([-1, -1]) == [1, 1] and second_pass([0, -1, 1]) == [0, 1, 1]


def test_both_passes_judge_a_marked_article():
    good = "This is the text of a page that has the words of the language in it and so it is kept for the reader. " * 3
    half, odd = "<p>See also <a href=1>this one</a></p>", "Brm krz plk vrt zzk qrx vlk mnt brr stt kll zzt prr grm hlk wrz."
    links = "".join(f"<li><a href={k}>Link number {k}</a></li>" for k in range(4))
    assert main_text(f"<article><p>{good}</p>{half}<p>{good}</p></article>") == "\n".join([good.strip(), "See also this one", good.strip()])
    assert main_text(f"<article><p>{good}</p><p>{odd}</p><p>{good}</p><ul>{links}</ul><p>{odd}</p></article>") == "\n".join([good.strip(), odd, good.strip(), odd])  # links take no text along
    assert main_text(f"<div>Menu</div><div>{good}</div><article><p>{good}</p></article><p>{odd}</p>") == "\n".join([good.strip()] * 2)


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, None, PAGE, "t", 5), (1, None, PAGE, "t", 5), (None, "u", None, "t", 5)], "page_id long, url string, html string, text string, z int")
    got = extract(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, len(TEXT), len(TEXT)] and got[0].z == 5


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 900
    pages = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", None), (4, "http://d", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
             (5, "http://e", "tail\r\n"), (6, "http://f", big), (6, "http://f", big), (None, "http://n", big), (7, "", "small"), (8, "", "small"), (9, "z", "\r\n\r\n" * 3)]
    write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"{tmp_path}/w")
    records = read_records(spark, f"{tmp_path}/w")
    assert records.count() == 3 * len(pages)
    got = transactions(records).collect()
    assert len(got) == len(pages) and all(r.request and r.metadata for r in got)
    seen = []
    for r in got:
        fields = dict(x.split(": ", 1) for x in r.metadata.block.split("\r\n") if x)
        page = None if fields["pageId"] == "-" else int(fields["pageId"])
        want = next(h or "" for i, _, h in pages if i == page)
        raw = want.encode()
        assert int(fields["payloadBytes"]) == len(raw) and r.response.digest == hashlib.sha1(raw).hexdigest()
        assert r.response.payload == (want if r.response.type == "response" else "")
        seen.append((page or 0, r.response.type, r.response.refers_to))
    stored = {r.record_id for r in got if r.response.type == "response"}
    revisits = sorted(x for x in seen if x[1] == "revisit")
    assert [x[0] for x in revisits] == [0, 1, 2] and all(x[2] in stored and x[2].startswith("<urn:capture:main:6:") for x in revisits)


def test_archives_without_pages(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert transactions(read_records(spark, f"{tmp_path}/w")).count() == 0


def test_base_spans():
    text = "a.b@c-d.e.f, x@y@z.com 1.2.3.4 999.1.1.1 or 4111 1111-1111 1111 and +1 (743) 555-3824; +12 3"
    found = [(k, text[a:b]) for k, a, b in base_spans(text)]
    assert found == [("email", "a.b@c-d.e.f"), ("email", "y@z.com"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert base_spans(None) == base_spans("") == [] and base_spans("é1@b.cé")[0][1:] == (1, 6)


def test_email_search_equals_the_pattern():
    rng = random.Random(6)
    for _ in range(3_000):
        text = "".join(rng.choice("ab1.@-_é ") for _ in range(rng.randint(0, 30)))
        assert [m.span() for m in pii_crf._around_at(text)] == [m.span() for m in pii_crf.EMAIL.finditer(text)]


def sequences():
    rng = random.Random(8)
    for _ in range(150):
        n = [str(rng.randrange(100, 999)) for _ in range(3)]
        text = rng.choice([f"call +1 ({n[0]}) {n[1]}-{n[2]}4 now", f"mail ab.{n[0]}@mail.example.com here", f"from {n[0][:2]}.{n[1][:2]}.{n[2][:2]}.7 on", f"page {n[0]} of {n[1]}"])
        for run in stretches(text):
            yield run, tags_of(run, base_spans(text))


def test_field_learns_and_decodes_the_best_path():
    field, data = Field().fit(list(sequences())), list(sequences())
    paths = field.decode([run for run, _ in data])
    assert np.mean([p.tolist() == y for p, (_, y) in zip(paths, data)]) > 0.97
    run, rng = data[0][0][:3], np.random.default_rng(0)
    field.unary = rng.normal(size=field.unary.shape)
    u = field.unary[pii_crf.features(run)].sum(axis=1)
    tags = range(len(pii_crf.TAGS))
    best = max(((a, b, c) for a in tags for b in tags for c in tags), key=lambda t: field.pair[-1, t[0]] + field.pair[t[0], t[1]] + field.pair[t[1], t[2]] + sum(u[k, x] for k, x in enumerate(t)))
    assert tuple(field.decode([run])[0]) == best


def test_personal_data_of_rows(spark):
    texts = [(1, "mail ab.1@mail.example.com", "s"), (2, None, "s"), (3, "", None), (1, "mail ab.1@mail.example.com", "s"), (None, "no data" * 20_000, "s")]
    rows = frame(spark, texts)
    got = find_personal_data(rows, train(labelled_table(rows)), ["doc_id"]).collect()
    assert sorted(len(r.base) for r in got) == [0, 0, 0, 1, 1] and all(set(r.base) <= set(r.found) for r in got)
    assert find_personal_data(rows, train(labelled_table(frame(spark, []))), ["doc_id"]).where(F.size("found") > 0).count() == 2


def test_the_field_adds_what_the_patterns_miss(spark):
    words = "der die und the house mail of call from order page number in with cat dog tree river stone".split()
    rng = random.Random(11)
    noise = ["on ####-##-## we", "page ## of ###", "at ##:## in", "for #,###.## of", "call +# (###) ###-#### now", "version #.#.##"]
    lines = [" ".join(rng.choices(words, k=25)) + " " + pii_crf.fill(None, rng.choice(noise), rng) + " " + " ".join(rng.choices(words, k=25)) for _ in range(150)]
    copies = ["copy 12 " + " ".join(words)] * 600
    table = labelled_table(frame(spark, [(k, t, "s") for k, t in enumerate([*lines, *copies])]))
    assert 300 < table.count() <= 400 and table.where(F.array_contains("tokens", "copy")).count() <= pii_crf.OF_TEXT + pii_crf.FILLED
    field = train(table)
    planted = ["743-555-3824", "(743) 555-3824", "4111.1111.1111.1111", "4111/1111/1111/1111"]
    for p in planted:
        text = f"the house of the river {p} in the tree with stone"
        assert base_spans(text) == [] and [text[a:b] for _, a, b in pii_crf.all_spans([text], field)[0][1]] == [p], p
    clean = ["on 2024-05-17 we saw page 12 of 345", "at 12:45 in the house for 1,234.56 of stone", "version 3.1.12 of the tree in 1998"]
    assert [m for _, m in pii_crf.all_spans(clean, field)] == [[], [], []]
    assert not pii_crf.plausible("ip", "1...2") and not pii_crf.plausible("ip", "1.2.3.") and pii_crf.plausible("ip", "1.2.3.4")


TEXTS = ["", " ", "▁a ▁▁ b", "  two  spaces ", "\n\t\x00 end", "😀 ñandú ﬁ", "word " * 50, "x" * 3_000, "The quick brown fox jumps over the lazy dog."]


def test_pieces_are_lossless_and_equal_the_library_without_dropout():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.MODEL)
    plain, dropped = merge_dropout.Encoder(dropout=0.0), merge_dropout.Encoder(dropout=0.3)
    for text in TEXTS:
        if "▁" not in text and "  " not in text:
            assert plain.encode(text, 1).tolist() == library.encode(text), text
        for e in (plain, dropped):
            assert merge_dropout.decode(e.encode(text, 1).tolist()) == text
    many = dropped.encode_many([None, *TEXTS], list(range(len(TEXTS) + 1)))
    assert many[0] is None and [merge_dropout.decode(x.tolist()) for x in many[1:]] == TEXTS


def test_dropout_varies_with_the_seed_and_numpy_equals_the_heap():
    text = TEXTS[-1]
    a, b, c = (merge_dropout.Encoder(dropout=0.3, seed=s).encode(text, 1).tolist() for s in (1, 2, 1))
    assert a == c != b and len(a) > len(merge_dropout.Encoder(dropout=0.0).encode(text, 1))
    p, threshold = merge_dropout.pieces(merge_dropout.MODEL), 2**30
    chunks = ["▁" + w for w in "retitioning ouenché 😀ab x Ω internationalization".split()] + ["a" * 64]
    keys = np.array([merge_dropout.xxhash.xxh32_intdigest(x, 7_001) for x in chunks], np.uint32)
    assert p.segment_many(chunks, keys, threshold) == [p.chunk_ids(x, 1, 7, threshold) for x in chunks]


def test_every_occurrence_of_a_word_draws_on_its_own():
    p, rate = merge_dropout.pieces(merge_dropout.MODEL), 0.3
    e = merge_dropout.Encoder(dropout=rate, seed=5)
    text = " ".join(["internationalization of retitioning"] * 300)
    chunks = ["▁" + w for w in text.split(" ")]
    for document in (1, 2, None):
        keys = merge_dropout.occurrence_keys(document, text, 5, len(chunks)).tolist()
        direct = [p.keyed_ids(c, k, e.threshold) for c, k in zip(chunks, keys)]
        assert e.encode(text, document).tobytes() == b"".join(direct)
        assert len(set(direct[::3])) > 50
    assert e.encode(text, 1).tobytes() != e.encode(text, 2).tobytes()
    plain = p.keyed_ids("▁of", 0, 0)
    kept = [p.keyed_ids("▁of", k, e.threshold) == plain for d in range(20) for k in merge_dropout.occurrence_keys(d, "", 5, 500).tolist()]
    offered = []
    p.segment(list("▁of"), 0, 0, frozenset(), offered)
    assert np.mean(kept) >= (1 - rate) ** len(offered) - 0.02


def test_pieces_of_rows(spark):
    got = merge_dropout.encode_rows(frame(spark, ROWS).withColumn("pieces", F.lit("old"))).collect()
    assert sorted((r.n_pieces is None, r.lossless) for r in got if r.text is not None) == [(False, True)] * 4
    assert [r.pieces for r in got if r.text is None] == [None] and got[0]._block == "k"


LANGS = {"en": ["the cat and the dog of the house "] * 5, "de": ["der hund und die katze des hauses "] * 5}


def naive_phrases(text, sample):
    n, k = 0, 0
    while k < len(text):
        e = k
        while e < len(text) and text[k : e + 1] in sample:
            e += 1
        n, k = n + 1, max(e, k + 1)
    return n


def test_cross_parsing_counts_longest_phrases():
    model, rng = Model(LANGS), random.Random(9)
    for _ in range(20):
        text = "".join(rng.choice("thecadogundkz") for _ in range(rng.randint(1, 200)))
        coded = model.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        want = []
        for lang in model.langs:
            sample = "".join(LANGS[lang]).replace(" ", "\x01")
            want.append(naive_phrases(text, sample))
        assert model.phrases([coded])[0].tolist() == want
    table = suffix_automaton(np.array([2, 3, 2, 3, 4]), 5)
    assert table[1, 2] and not table[table[1, 4], 2]


@pytest.mark.parametrize("text, lang", [("the dog", "en"), ("Die Katze", "de"), (None, "und"), ("", "und"), ("12 !?", "und"), ("the dog and " * 200_000, "en")])
def test_prediction(text, lang):
    names, scores = Model(LANGS).predict([text, "the"])
    assert names[0] == lang and 0 <= scores[0] <= 1


def test_language_of_rows(spark):
    rows = frame(spark, [(k, t, lang) for lang, ts in LANGS.items() for k, t in enumerate(ts)] + [(7, None, "en"), (None, "the dog", None)])
    got = identify(rows, fit(rows, lang_col="source"), ["doc_id", "source"]).collect()
    assert all(r.lang_pred == r.source for r in got if r.doc_id is not None and r.doc_id < 5)
    assert [r.lang_pred for r in got if r.doc_id == 7] == ["und"]
    assert identify(rows, fit(frame(spark, []), lang_col="source"), ["doc_id"]).where("lang_pred != 'und'").count() == 0


def test_letters_beyond_the_basic_plane(spark):
    texts = ["\U0001E900\U0001E901 \U0001E902", "\U00010330\U00010331", "\U0001D400\U0001D401", "\U00020000", "\U0001F600 \U0001F601!", "12 \U0001F600"]
    names, scores = Model(LANGS).predict(texts)
    assert [n == "und" for n in names] == [False] * 4 + [True] * 2 and all((s > 0) == (n != "und") for n, s in zip(names, scores))
    model = Model(LANGS)
    assert encode("a\U0001E900\U0001F600", model.codes)[1:].tolist() == [0, 1]
    rows = spark.createDataFrame([(k, t, None, "s", 1) for k, t in enumerate(texts + ["no label", "", None])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, rows, "").collect()) == [0, 1, 2, 3, 6]
