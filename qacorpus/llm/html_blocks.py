"""Main text of HTML pages by two passes over their blocks.

A page is cut into blocks at block-level tags.  Pass one looks at every block on its own: its share of link text, its length, its
share of stop words, and the containers it stands in (menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, by element, role, class or id).  It is main text, boilerplate, or undecided: short blocks, and blocks of middling stop
word share.  In pass two each undecided block takes the label of the nearest decided block (main text where both sides are as
near and differ).  Where a page marks its article (``article`` or ``main``), the mark moves the limits of pass one (``INSIDE``,
``OUTSIDE``): inside it lower stop word shares do, and short, link-heavy or odd blocks are undecided; outside it only long dense
text is main text.  In an article undecided blocks without links are main text, those with links take the nearest label of main text
or of a container; blocks left out for their links have no say.  Class names count as a whole (``has-sidebar`` is no sidebar), and
not on an element that holds most of the page's text.  In a page without any stop word length and links decide.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed in page order;
nothing is capped.  Unclosed and misnested tags, unclosed comments and scripts are read the way browsers do in broad terms (they
run to the end of the page).  Null or empty html gives an empty text.  Rows are independent; repeated rows, null ids or urls and
extra columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, table

#: Frequent function words of the languages at hand; a caller may give others.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was "
    "were what which who will with you au aux avec ce cette dans de des du elle en est et il la le les leur mais ne ou par pas pour "
    "que qui se sur un une al como con del el es los las más no para por sin su sus y o aber als am auch auf aus bei das dass dem "
    "den der des die durch ein eine einer er es für hat ich im ist mit nach nicht oder sich sie sind so über um und uns von vor "
    "war wie wir zu zum zur".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: Contents are no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video title head".split())
BOILER = frozenset("nav footer aside form button select textarea menu dialog header".split())
MAIN = frozenset(("article", "main"))
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class names and ids that tell boilerplate; such a name is made of these and of AFFIXES alone (``has-sidebar`` is a layout).
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar comment comments respond disqus cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended widget widgets toolbar pagination skip".split()
)
AFFIXES = frozenset(
    "site page main global top bottom left right primary secondary box bar list section container wrapper wrap area block inner outer item items "
    "link links post posts article articles form panel slot unit message buttons icons mobile desktop sticky fixed user reader thread side".split()
)
#: Before these words ``post`` and ``article`` tell a part of the page, before others a part of the article.
OF_ARTICLE = frozenset("header footer nav navigation menu notice".split())
COMMENTS = frozenset("comment comments respond disqus".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))",
    re.S,
)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WHITE, WORD, WORDS_OF_NAME = re.compile(r"\s+"), re.compile(r"\w+"), re.compile(r"[-_]+")
#: A container that is boilerplate by its name alone isn't when it holds more than this share of the page's text.
MOST = 0.67
#: Limits of pass one.
LINKS_MAX, SHORT, LONG, STOPS_LOW, STOPS_HIGH = 0.4, 70, 200, 0.10, 0.20


@dataclass(frozen=True)
class Limits:
    links: float  # boilerplate above this share of link text
    doubt: float  # undecided above this one
    low: float  # stop word shares: ``poor`` below the first, main text from the second on
    high: float
    long: int  # characters that main text has
    short: int  # label of short blocks without links, of short blocks with links, of blocks with few stop words
    linked: int
    poor: int


OPEN = Limits(LINKS_MAX, LINKS_MAX, STOPS_LOW, STOPS_HIGH, LONG, -1, 0, 0)
INSIDE = Limits(0.8, LINKS_MAX, 0.05, STOPS_LOW, SHORT, -1, -1, -1)
OUTSIDE = Limits(0.2, 0.2, STOPS_HIGH, 0.30, LONG, 0, 0, 0)


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    boiler: bool  # stands in a container of boilerplate
    main: bool  # stands in the marked article
    heading: bool
    named: tuple[int, ...] = ()  # containers around it that are boilerplate by their name alone


def boiler_name(value: str) -> bool:
    """Whether a class or id is a name of boilerplate: all its words tell it, one at least by itself."""
    words = [w for w in WORDS_OF_NAME.split(value.lower()) if w and not w.isdigit()]
    found = [w for w in words if w in BOILER_WORDS]
    if not found or any(w not in BOILER_WORDS and w not in AFFIXES for w in words):
        return False
    return not ({"post", "article"} & set(words) and OF_ARTICLE.issuperset(found))


def _is_boiler(name: str, attrs: str) -> str:
    """How an element is boilerplate: ``mark`` (element or role), ``comments`` or ``name`` (class or id), or not at all."""
    if name in BOILER:
        return "mark"
    if name in ("html", "body", "article", "main") or "=" not in attrs:
        return ""
    how = ""
    for m in ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower().strip() in BOILER_ROLE:
                return "mark"
            continue
        for part in value.split():
            if boiler_name(part):
                how = "comments" if how == "comments" or COMMENTS & set(WORDS_OF_NAME.split(part.lower())) else "name"
    return how


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = []  # name, boilerplate, article, number: of open block-level elements
    parts: list[str] = []
    links, in_link, boiler, main, heading, named, number = 0, False, False, False, False, (), 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                found.append(Block(text, links, boiler, main, heading, named))
            parts.clear()
        links = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if in_link:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in SILENT:
            if not m["close"] and not m["attrs"].endswith("/>"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name != "head":
                    at = end
            continue
        if name in INLINE:
            if name == "a":
                in_link = not m["close"]
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        in_link = False
        if name in VOID:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()  # closed by the next one
            off = _is_boiler(name, m["attrs"])
            if name == "header" and any(s[2] for s in stack):
                off = ""  # the head of an article holds its title
            number += 1
            stack.append((name, off, name in MAIN, number))
        boiler, main = any(s[1] in ("mark", "comments") for s in stack), any(s[2] for s in stack)
        named = tuple(s[3] for s in stack if s[1] == "name")
        heading = any(len(s[0]) == 2 and s[0][0] == "h" and s[0][1].isdigit() for s in stack)
    flush()
    size: dict[int, int] = {}
    for b in found:
        for k in b.named:
            size[k] = size.get(k, 0) + len(b.text)
    whole, marked = sum(len(b.text) for b in found), any(b.main for b in found)
    layout = {k for k, n in size.items() if n > MOST * whole and (not marked or any(b.main and k in b.named for b in found))}
    for b in found:
        b.boiler = b.boiler or any(k not in layout for k in b.named)
    return found


def first_pass(b: Block, marked: bool, stops: frozenset[str] | None) -> int:
    """1 main text, 0 boilerplate, -1 undecided.  Without stop words (None) length and links decide."""
    if b.boiler:
        return 0
    at = (INSIDE if b.main else OUTSIDE) if marked else OPEN
    size = max(len(b.text), 1)
    share = b.links / size
    if share > at.links and not (b.heading and at is INSIDE):
        return 0
    if size < SHORT or b.heading:
        return at.linked if b.links and not b.heading else at.short
    if share > at.doubt:
        return -1
    if stops is None:
        return 1 if size > at.long else -1
    found = WORD.findall(b.text.lower())
    stop = sum(w in stops for w in found) / max(len(found), 1)
    if stop >= at.high:
        return 1 if size > at.long else -1
    return -1 if stop >= at.low else at.poor


def second_pass(labels: list[int]) -> list[int]:
    """Undecided blocks take the nearest decided label; undecided pages are main text."""
    n = len(labels)
    left, right = [(n + 1, -1)] * n, [(n + 1, -1)] * n
    near = (n + 1, -1)
    for i in range(n):
        near = (0, labels[i]) if labels[i] >= 0 else (near[0] + 1, near[1])
        left[i] = near
    near = (n + 1, -1)
    for i in range(n - 1, -1, -1):
        near = (0, labels[i]) if labels[i] >= 0 else (near[0] + 1, near[1])
        right[i] = near
    out = []
    for i in range(n):
        sides = [s for s in (left[i], right[i]) if s[1] >= 0]
        if labels[i] >= 0:
            out.append(labels[i])
        elif not sides:
            out.append(1)
        else:
            least = min(s[0] for s in sides)
            out.append(max(s[1] for s in sides if s[0] == least))
    return out


def article_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Pass two inside the marked article: main text and containers vote, blocks that are left out for their links don't.

    An undecided block without links is main text, one with links takes the nearest vote; without a vote it is main text.
    """
    inside = [k for k, b in enumerate(found) if b.main]
    votes = [labels[k] if labels[k] == 1 or found[k].boiler else -1 for k in inside]
    out = list(labels)
    for k, label in zip(inside, second_pass(votes)):
        if labels[k] < 0:
            out[k] = label if found[k].links else 1
    return out


def main_text(page: str | None, stops: frozenset[str] = STOP_WORDS) -> str:
    if not page:
        return ""
    found = blocks(page)
    marked = any(b.main for b in found)
    # no stop word at all says nothing about blocks: another language than those of the list, or one written without spaces
    told = any(w in stops for b in found if not b.boiler for w in WORD.findall(b.text.lower()))
    labels = [first_pass(b, marked, stops if told else None) for b in found]
    labels = second_pass(article_pass(found, labels))
    return "\n".join(b.text for b, keep in zip(found, labels) if keep)


def extract(pages: DataFrame, html_col: str = "html", stops: frozenset[str] = STOP_WORDS) -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (code points)."""

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(x, stops) if isinstance(x, str) else "" for x in part], dtype=object)

    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.select(*others, texts(F.col(html_col)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op4_html_block_rules")
def op4_html_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
