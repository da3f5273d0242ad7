"""Text projections (TXT1-TXT20): Column -> Column, no shuffle, no Python worker.

A regular expression is only run on rows holding a character it needs; most rows skip most patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import ANSWER_FORMS, MAIL_MARKER, MEDICAL, SYNONYMS, Profile
from .common import (
    NON_WS,
    WORD_END,
    WORD_START,
    WS,
    any_of,
    let,
    quote,
    quote_replacement,
    sql_text,
    squeeze,
    strip,
    whole_word_any_case,
    words,
)

Step = Callable[[Column], Column]


def _chain(c: Column, steps: list[Step]) -> Column:
    for step in steps:
        c = let(c, step)
    return c


def _sub(needs: str | None, pattern: str, replacement: str) -> Step:
    """regexp_replace, skipped when the literal ``needs`` is absent."""
    if needs is None:
        return lambda t: F.regexp_replace(t, pattern, replacement)
    return lambda t: F.when(t.contains(needs), F.regexp_replace(t, pattern, replacement)).otherwise(t)


def _may_hold(t: Column, phrases) -> Column:
    """Cheap test that is true whenever a case-insensitive regex of the phrases could match.

    Letters whose lower case is not the ASCII letter they match without case are let through.
    """
    return let(F.lower(t), lambda low: any_of(low, [p.lower() for p in phrases] + ["ſ", "ı", "\u0307"]))


def clean_text(c: Column) -> Column:
    """TXT1: drop tags, URLs and mail addresses, tidy option letters, punctuation runs and whitespace."""
    options = [_sub(None, rf"{WS}*\((?:{x}|{x.lower()})\){WS}*", f" ({x}) ") for x in "ABCD"]

    def tidy_options(t: Column) -> Column:
        out = t
        for step in options:
            out = step(out)
        return F.when(t.contains("("), out).otherwise(t)

    steps = [
        _sub("<", r"<[^>]+>", ""),
        _sub("http", f"https?://{NON_WS}+", ""),
        # anchored at the start of a word, which keeps one pass over long words linear
        _sub("@", f"(?<!{NON_WS}){NON_WS}+@{NON_WS}+", ""),
        tidy_options,
        _sub(None, r"([!?.]){2,}", "$1"),
        squeeze,
    ]
    return F.coalesce(strip(_chain(c, steps)), F.lit(""))


def expand_abbreviations(c: Column, profile: Profile = MEDICAL) -> Column:
    """TXT2: every whole-word abbreviation gets its expansion in brackets, in list order."""
    rows = [
        f"struct({sql_text(k)} AS k, {sql_text(WORD_START + quote(k) + WORD_END)} AS p, {sql_text(quote_replacement(f'{k} ({v})'))} AS r)"
        for k, v in profile.abbreviations.items()
    ]
    rules = F.expr(f"array({', '.join(rows)})")
    return F.aggregate(
        rules,
        c,
        lambda t, r: F.when(t.contains(r["k"]), F.regexp_replace(t, r["p"], r["r"])).otherwise(t),
    )


def normalize_stats(c: Column) -> Column:
    """TXT3: p-values, confidence intervals, ranges and percentages in words."""
    d = r"\p{Nd}"
    return _chain(
        c,
        [
            _sub("0.05", rf"p{WS}*<{WS}*0\.05", "p-value less than 0.05"),
            _sub("0.01", rf"p{WS}*<{WS}*0\.01", "p-value less than 0.01"),
            _sub("0.05", rf"p{WS}*>{WS}*0\.05", "p-value greater than 0.05"),
            _sub("=", rf"p{WS}*={WS}*({d}+\.?{d}*)", "p-value equals $1"),
            _sub("95%", rf"95%{WS}*CI", "95% confidence interval"),
            _sub("95%", rf"CI{WS}*95%", "95% confidence interval"),
            _sub("-", rf"({d}+){WS}*-{WS}*({d}+)", "$1 to $2"),
            _sub("%", rf"({d}+)%", "$1 percent"),
        ],
    )


def normalize_answer(c: Column) -> Column:
    """TXT4: canonical yes / no / uncertain / unknown; a recommendation replaces the whole answer."""

    def body(t: Column) -> Column:
        low = strip(F.lower(t))
        out = F.when(low.contains("not recommended"), "Not recommended").when(
            low.contains("recommended"), "Recommended"
        )
        for form, variants in ANSWER_FORMS.items():
            out = out.when(low.isin(*variants), form)
        return out.otherwise(t)

    return let(c, body)


def standardize_units(c: Column, strict: bool = False) -> Column:
    """TXT5: spacing and case of units.  ``strict`` requires the unit to end at a word boundary."""
    d, end = r"\p{Nd}", WORD_END if strict else ""
    num = rf"({d}+\.?{d}*){WS}*"
    subs = [(rf"(?iu)({d}+)/({d}+){WS}*mmhg{end}", "$1/$2 mmHg")]
    subs += [(f"(?iu){num}°?{u}{end}", f"$1°{u.upper()}") for u in ("c", "f")]
    subs += [(f"(?iu){num}{u}{end}", f"$1 {u}") for u in ("kg", "lb", "cm", "mg", "ml")]

    def body(t: Column) -> Column:
        out = t
        for pattern, replacement in subs:
            out = F.regexp_replace(out, pattern, replacement)
        return F.when(t.rlike(d), out).otherwise(t)

    return let(c, body)


# letters whose capital in full is several letters (sharp s: SS) but that have a capital of their own
_OWN_CAPITAL = {"ß": "ẞ"} | {c: c.title() for c in map(chr, range(0x1F80, 0x1FFD)) if len(c.upper()) > 1 and len(c.title()) == 1}


def capitalize(c: Column) -> Column:
    """First letter in capitals, the rest in small letters, one for one: letters never become several, and a sigma is the same at the end."""
    first = F.substring(c, 1, 1)
    capital = F.upper(first)
    own = F.translate(first, "".join(_OWN_CAPITAL), "".join(_OWN_CAPITAL.values()))
    rest = F.lower(F.translate(F.substring(c, 2, 2147483647), "Σİ", "σi"))
    return F.concat(F.when(F.char_length(capital) > 1, own).otherwise(capital), rest)


def fix_grammar(c: Column) -> Column:
    """TXT6: punctuation spacing, camelCase, sentence capitals (the rest of a sentence is lower-cased)."""
    t = F.regexp_replace(c, WS + "+([,.!?])", "$1")
    t = F.regexp_replace(t, "([,.!?])([A-Za-z])", "$1 $2")
    t = F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2")
    sentences = F.transform(F.split(squeeze(t), r"\. "), strip)
    return F.array_join(F.transform(F.filter(sentences, lambda s: s != ""), capitalize), ". ")


def enhance_terms(c: Column, profile: Profile = MEDICAL) -> Column:
    """TXT7: whole-word phrase replacement, case-insensitive, in list order."""

    def body(t: Column) -> Column:
        out = t
        for phrase, replacement in profile.phrases.items():
            out = F.regexp_replace(out, whole_word_any_case([phrase]), quote_replacement(replacement))
        return F.when(_may_hold(t, profile.phrases), out).otherwise(t)

    return let(c, body)


def remove_redundant(c: Column, profile: Profile = MEDICAL) -> Column:
    """TXT8: delete filler phrases."""

    def body(t: Column) -> Column:
        out = t
        for alternatives in profile.fillers:
            out = F.regexp_replace(out, whole_word_any_case(alternatives), "")
        return F.when(_may_hold(t, [p for ps in profile.fillers for p in ps]), out).otherwise(t)

    return strip(squeeze(let(c, body)))


def final_polish(c: Column) -> Column:
    """TXT9: shorten punctuation runs and close the last sentence."""
    t = strip(squeeze(F.regexp_replace(c, r"([!?.]){3,}", "$1$1")))
    return let(t, lambda x: F.when((x == "") | F.right(x, F.lit(1)).isin(".", "!", "?"), x).otherwise(F.concat(x, F.lit("."))))


def comprehensive_clean(c: Column, profile: Profile = MEDICAL) -> Column:
    """TXT10: the eight passes of the thorough profile."""
    return strip(
        _chain(
            clean_text(c),
            [
                lambda t: expand_abbreviations(t, profile),
                normalize_stats,
                standardize_units,
                fix_grammar,
                lambda t: enhance_terms(t, profile),
                lambda t: remove_redundant(t, profile),
                final_polish,
            ],
        )
    )


def enhanced_clean(c: Column, profile: Profile = MEDICAL) -> Column:
    """TXT11: the five passes of the enhanced profile."""
    return strip(
        _chain(
            clean_text(c),
            [
                lambda t: expand_abbreviations(t, profile),
                normalize_stats,
                standardize_units,
                lambda t: remove_redundant(t, profile),
            ],
        )
    )


def detect_language(c: Column) -> Column:
    """TXT12: share of Thai characters among letters."""
    letters = F.length(F.regexp_replace(c, r"\P{L}+", ""))
    thai = F.length(F.regexp_replace(c, "[^฀-๿]+", ""))
    return (
        F.when(F.coalesce(letters, F.lit(0)) == 0, "unknown")
        .when(thai / letters > F.lit(0.1), "thai")
        .otherwise("english")
    )


def normalize_key(c: Column) -> Column:
    return squeeze(F.lower(strip(c)))


def text_hash(c: Column) -> Column:
    """TXT13: md5 of the normalised text; null for null or empty text."""
    return F.when(c != "", F.md5(normalize_key(c)))


def strip_symbols(c: Column) -> Column:
    """TXT14: keep Thai, ASCII letters and digits, whitespace and ``.?!``."""
    return F.coalesce(strip(F.regexp_replace(squeeze(c), "[^฀-๿a-zA-Z0-9 .?!]", "")), F.lit(""))


def standardize_synonyms(c: Column, synonyms: dict[str, tuple] | None = None) -> Column:
    """TXT15: case-insensitive literal replacement of variants by a canonical term, in order."""
    pairs = [(v, k) for k, vs in (SYNONYMS if synonyms is None else synonyms).items() for v in vs]

    def body(t: Column) -> Column:
        out = t
        for variant, canonical in pairs:
            out = F.regexp_replace(out, "(?iu)" + quote(variant), quote_replacement(canonical))
        return F.when(_may_hold(t, [v for v, _ in pairs]), out).otherwise(t)

    return let(c, body)


def title_name(c: Column) -> Column:
    """TXT16: underscores to blanks, a capital after every non-letter (also after apostrophes)."""
    runs = F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def prompt_format(question: Column, style: str = "diagnose") -> Column:
    """TXT17: model input line."""
    prefix = {"diagnose": "diagnose disease: ", "question": "question: ", "answer": "answer: "}[style]
    return F.concat(F.lit(prefix), question)


def ngrams(c: Column, n: int, first: int | None = None) -> Column:
    """TXT18: word n-grams of the lower-cased text, optionally only the first few."""

    def body(ws: Column) -> Column:
        last = F.size(ws) - n
        if first is not None:
            last = F.least(last, F.lit(first - 1))
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))
        return F.when(F.size(ws) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(words(F.lower(c)), body)


def extract_question(body: Column, marker: str = MAIL_MARKER, command: str = "/ask") -> Column:
    """TXT19: the piece after the marker when there is one; a slash command is removed; trimmed."""
    piece = F.when(body.contains(marker), F.get(F.split(body, quote(marker)), 1)).otherwise(body)
    return strip(F.regexp_replace(piece, f"^{WS}*" + quote(command), ""))


def strip_prompt_echo(answer: Column, prompt: Column) -> Column:
    """TXT20: remove an echoed prompt and one trailing ``Human:``."""
    text = F.when(prompt != "", F.replace(answer, prompt, F.lit(""))).otherwise(answer)
    return let(strip(text), lambda t: F.when(t.endswith("Human:"), strip(F.regexp_replace(t, "Human:$", ""))).otherwise(t))
