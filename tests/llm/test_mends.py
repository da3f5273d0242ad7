"""Long numbers, hard urls, clashing columns and page layouts that once lost data or failed."""

import hashlib
import random
import time

import regex
from pyspark.sql import functions as F

from qacorpus.llm import html_blocks as hb
from qacorpus.llm.pii_crf import CARD, EMAIL, IP, KINDS, PHONE, base_spans, passes
from qacorpus.llm.resharding import reshard
from qacorpus.llm.warc import metadata_field, read_records, transactions, write_archives


def plain_spans(text):
    """The patterns as the contract gives them, one after the other."""
    found = []
    for k, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if passes(KINDS[k], m[0])]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(11)
    parts = ["1", "12", "255", "256", "007", "0", ".", ".", "..", "+", " ", "-", "(", ")", "@", "a", "b.c", "%", "4111111111111111", "192.168.0.1", "x@y.org", "\n"]
    for _ in range(4_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        assert base_spans(text) == plain_spans(text), text


def test_long_digit_runs_are_dropped_in_linear_time():
    assert base_spans("9" * 5_000 + ".1.1.1") == []
    assert base_spans("0" * 5_000 + ".1.1.1") == [("ip", 0, 5_006)]
    started = time.perf_counter()
    for text in ("7" * 1_000_000, "7." * 500_000, "+" + "7" * 1_000_000, ("7" * 1_000 + " ") * 1_000):
        base_spans(text)
    assert time.perf_counter() - started < 20


PAGES = "page_id long, url string, html string, row int, original string"


def test_archives_keep_pages_whose_url_holds_the_separator(spark, tmp_path):
    big = "<p>" + "x" * 2_000
    rows = [(1, "http://x/WARC/1.1", "one"), (2, "http://x/WARC/1.1\r\nWARC-Type: response", "two WARC/1.1\r\n"), (3, None, big), (4, "u", big), (4, "u", big), (None, "v", big), (5, "", None)]
    write_archives(spark.createDataFrame([(*r, 1, "o") for r in rows], PAGES), str(tmp_path / "w"))
    records = read_records(spark, str(tmp_path / "w"))
    ids = {r.record_id: r.type for r in records.collect()}
    assert len(ids) == 3 * len(rows)
    got = transactions(records).select(metadata_field("pageId").alias("page"), "response", "record_id").collect()
    assert sorted(r.page for r in got) == sorted(str(r[0]) if r[0] else "-" for r in rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if str(i if i else "-") == r.page)
        assert r.response.digest == hashlib.sha1(html.encode()).hexdigest()
        if r.response.type == "revisit":
            assert ids[r.response.refers_to] == "response" and r.response.refers_to.startswith("<urn:capture:main:4:")
        else:
            assert r.response.payload == html
    assert [r.response.type for r in got].count("revisit") == 2
    assert {r.response.target_uri for r in got if r.page == "1"} == {"http://x/%57ARC/1.1"}


def test_reshard_with_clashing_columns_and_null_shards(spark):
    rows = spark.createDataFrame([(k, "t" * k, 1, "b", 0) for k in range(40)], "doc_id long, text string, offset int, _blocks string, _offset int")
    got = reshard(rows, F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3), 3, 4)[0].collect()
    assert len(got) == 40 and {r.offset for r in got} == {1} and {r._old for r in got} == {0, 1, 2}


P = "It was the best of times and it was the worst of times in the whole of the land, and people were out in the streets of the old town to see it. "


def test_links_take_no_article_text_along():
    links = "<ul><li><a href=x>one link here</a></li><li><a href=x>another link</a></li></ul>"
    assert hb.main_text(f"<article><p>{P * 3}</p>{links}<p>The end of the story is here.</p></article>").split("\n")[-1] == "The end of the story is here."
    text = hb.main_text(f"<article><table><tr><td>Year</td><td>1998</td></tr></table><p><a href=x>{P}</a></p><h2>Head</h2><p>Short one.</p></article>")
    assert text.split("\n") == ["Year", "1998", "Head", "Short one."]
    assert hb.main_text(f"<article>{links}<p>First words.</p><p>{P * 3}</p></article>").startswith("First words.")


def test_layout_classes_are_no_boilerplate():
    for name in ("content has-sidebar", "no-menu page", "layout--with-nav", "entry-header", "post-header"):
        assert not any(hb.boiler_name(part) for part in name.split()), name
    for name in ("sidebar", "site-header", "ad-banner", "user-comments", "post-comments", "related-posts", "cookie-consent", "widget-12", "nav_primary"):
        assert hb.boiler_name(name), name
    page = f"<body><div class='content has-sidebar'><p>{P * 3}</p><div class='sidebar'>Side text</div></div>"
    assert hb.main_text(page) == (P * 3).strip()
    assert hb.main_text(f"<body><div id='banner'><p>{P * 3}</p></div><p>tail</p>").startswith(P.strip()[:40])
    # a container that the page's article stands beside stays boilerplate, and so do reader comments of any size
    assert hb.main_text(f"<article><p>{P * 2}</p></article><div class='related'><p>{P * 9}</p></div>") == (P * 2).strip()
    assert hb.main_text(f"<div><p>{P * 2}</p></div><div class='comments'><p>{P * 9}</p></div>") == (P * 2).strip()


def test_pages_without_stop_words():
    chinese = "这是一个没有空格的中文段落，" * 20
    assert hb.main_text(f"<div><p>{chinese}</p><p>短句。</p></div><nav>菜单</nav>") == chinese + "\n短句。"


def test_very_long_page():
    page = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert hb.main_text(page).count("\n") == 19_999


def nearest(labels):
    """The second pass, looking at every decided block for every undecided one."""
    out = []
    for i, label in enumerate(labels):
        decided = [(abs(i - j), -x) for j, x in enumerate(labels) if x >= 0]
        out.append(label if label >= 0 else -min(decided)[1] if decided else 1)
    return out


def plain_text(found, stops):
    """Both passes block by block, written down from the docstring."""
    words = lambda b: regex.findall(r"\w+", b.text.lower())
    marked, told = any(b.main for b in found), any(w in stops for b in found if not b.boiler for w in words(b))
    labels = []
    for b in found:
        limit = hb.OPEN if not marked else hb.INSIDE if b.main else hb.OUTSIDE
        share, stop = b.links / len(b.text), sum(w in stops for w in words(b)) / max(1, len(words(b)))
        if b.boiler or (share > limit.links and not (b.heading and limit is hb.INSIDE)):
            labels.append(0)
        elif b.heading or len(b.text) < hb.SHORT:
            labels.append(limit.short if b.heading or not b.links else limit.linked)
        elif share > limit.doubt:
            labels.append(-1)
        elif not told or stop >= limit.high:
            labels.append(1 if len(b.text) > limit.long else -1)
        else:
            labels.append(-1 if stop >= limit.low else limit.poor)
    inside = [k for k, b in enumerate(found) if b.main]
    votes = nearest([-1 if labels[k] == 0 and not found[k].boiler else labels[k] for k in inside])
    for k, vote in zip(inside, votes):
        if labels[k] == -1:
            labels[k] = vote if found[k].links else 1
    return "\n".join(b.text for b, label in zip(found, nearest(labels)) if label)


def test_both_passes_against_a_plain_version():
    rng = random.Random(12)
    stops = frozenset({"the", "and", "of"})
    for _ in range(1_500):
        html, article = [], rng.random() < 0.6
        for _ in range(rng.randint(0, 12)):
            text = " ".join(rng.choice(["the", "and", "of", "house", "tree", "运行", "river"]) for _ in range(rng.choice([1, 3, 12, 30, 80])))
            tag = rng.choice(["p", "li", "h2", "td", "div"])
            inner = rng.choice([text, text, f"<a href=x>{text}</a>", f"{text} <a>{text[: len(text) // 2]}</a>"])
            html.append(rng.choice([f"<{tag}>{inner}</{tag}>"] * 4 + [f"<nav><p>{inner}</p></nav>", f"<div class='sidebar'>{inner}</div>", "</article><article>" if article else "<hr>"]))
        page = ("<article>" if article else "") + "".join(html)
        assert hb.main_text(page, stops) == plain_text(hb.blocks(page), stops)


def test_language_model_with_many_labels():
    """200 labels, each with letters of its own and shared ones: the tables' offsets stay apart."""
    from qacorpus.llm.language_id import Model

    rng = random.Random(13)
    letters = [chr(0x4E00 + k) for k in range(400)]
    own = {f"l{k:03d}": letters[2 * k : 2 * k + 2] + ["a", "b"] for k in range(200)}
    text = lambda k, n: "".join(rng.choice(own[k]) for _ in range(n))
    model = Model({k: [text(k, 120)] for k in own})
    names, scores = model.predict([text(k, 60) for k in own] + ["", None, "12 34"])
    assert names == [*own, "und", "und", "und"] and all(0 < s <= 1 for s in scores[:200])


def test_language_sample_is_cut_at_hashed_places(spark):
    from qacorpus.llm.language_id import TRAIN_CHARS, training_sample

    head = "same header " * 200
    rows = [(k, head + f"{k} " + chr(97 + k % 26) * 6_000, "xx") for k in range(50)] + [(99, "12 34", "xx"), (98, None, "xx"), (97, "abc", None)]
    got = training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")["xx"]
    assert all(len(t) <= TRAIN_CHARS for t in got) and len({t[:20] for t in got}) > 5 and not any(t.startswith("12") for t in got)
