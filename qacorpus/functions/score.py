"""Row scores (SCR1-SCR9).  All arithmetic is double; terms are added in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import (
    ADVICE_WORDS,
    ANSWER_TERMS,
    CONFIDENCE_TERMS,
    INSULTS,
    MEDICAL,
    RESPONSE_EMERGENCY,
    RESPONSE_KEYWORDS,
    RESPONSE_PREVENTION,
    Profile,
)
from .common import any_of, distinct_words, hits, let, lookup, occurrences, strip, word_count, words


def _sum(*parts: tuple[Column, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts])


def _cap(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def quality_basic(q: Column, a: Column, profile: Profile = MEDICAL) -> Column:
    """SCR1"""

    def body(t: Column) -> Column:
        qq, aa, lq, la = t["q"], t["a"], t["lq"], t["la"]
        both = (qq != "") & (aa != "")
        return _cap(
            _sum(
                (F.length(qq).between(20, 500), 0.15),
                (any_of(lq, profile.score_markers), 0.15),
                (any_of(lq, profile.score_terms), 0.10),
                (F.length(aa).between(10, 2000), 0.15),
                (aa.contains(".") | (F.length(aa) > 50), 0.10),
                (any_of(la, profile.informative), 0.15),
                (both, 0.10),
                (both, 0.10),
            )
        )

    q, a = strip(q), strip(a)
    return let(F.struct(q.alias("q"), a.alias("a"), F.lower(q).alias("lq"), F.lower(a).alias("la")), body)


def term_count(low: Column, profile: Profile = MEDICAL) -> Column:
    """SCR4"""
    return occurrences(low, profile.all_terms)


def quality_detailed(
    q: Column, a: Column, lq: Column, la: Column, q_terms: Column, a_terms: Column, relevant: Column,
    profile: Profile = MEDICAL,
) -> Column:
    """SCR2.  ``q_terms`` / ``a_terms`` are SCR4 of each side, ``relevant`` is FLT3 of both."""
    tier_q = (
        F.when(F.length(q).between(20, 500), F.lit(0.10))
        .when(F.length(q).between(15, 600), F.lit(0.05))
        .otherwise(F.lit(0.0))
    )
    tier_a = (
        F.when(F.length(a).between(30, 1000), F.lit(0.15))
        .when(F.length(a).between(20, 1200), F.lit(0.10))
        .otherwise(F.lit(0.0))
    )
    return _cap(
        tier_q
        + _sum((distinct_words(lq) >= 5, 0.10), (q_terms >= 2, 0.10))
        + tier_a
        + _sum(
            (distinct_words(la) >= 8, 0.15),
            (a_terms >= 3, 0.10),
            (relevant, 0.15),
            (any_of(la, profile.informative_detailed), 0.15),
        )
    )


def completeness(q: Column, a: Column, lq: Column, la: Column, terms: Column) -> Column:
    """SCR3.  ``terms`` is SCR4 of question and answer together."""
    return _cap(
        _sum(
            ((q != "") & (a != ""), 0.3),
            ((F.length(q) >= 15) & (F.length(a) >= 20), 0.3),
            ((distinct_words(lq) >= 5) & (distinct_words(la) >= 8), 0.2),
            (terms >= 3, 0.2),
        )
    )


def selection_details(
    q: Column, a: Column, specialty: Column, severity: Column, qa_type: Column, profile: Profile = MEDICAL
) -> Column:
    """SCR5 as a struct: score, its three factors and the text measures behind them."""
    q_words, a_words = word_count(q), word_count(a)
    one = F.lit(1)
    q_density = hits(F.lower(q), profile.text_terms) / F.greatest(q_words, one)
    a_density = hits(F.lower(a), profile.text_terms) / F.greatest(a_words, one)

    def factor(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(1.0))

    quality = (
        factor(q_words >= 10, 1.1)
        * factor(a_words >= 20, 1.2)
        * factor(q_density > F.lit(0.2), 1.1)
        * factor(a_density > F.lit(0.15), 1.1)
        * factor(any_of(q, profile.text_abbreviations), 1.05)
        * factor(any_of(a, profile.text_abbreviations), 1.05)
        * factor(a_words < 5, 0.7)
    )
    s = lookup(F.coalesce(specialty, F.lit(profile.specialty_default)), profile.weight_specialty, 0.7)
    v = lookup(F.coalesce(severity, F.lit(profile.severity_default)), profile.weight_severity, 0.9)
    t = lookup(F.coalesce(qa_type, F.lit("medical_qa")), profile.weight_type, 1.0)
    return F.struct(
        (s * v * t * quality).alias("score"),
        s.alias("specialty_score"),
        v.alias("severity_score"),
        quality.alias("quality_score"),
        q_words.alias("q_word_count"),
        a_words.alias("a_word_count"),
        q_density.alias("q_medical_density"),
        a_density.alias("a_medical_density"),
    )


def answer_quality_100(q: Column, a: Column) -> Column:
    """SCR6"""
    low = F.lower(a)
    n = F.length(a)
    overlap = F.size(F.array_intersect(words(F.lower(q)), words(low)))
    return F.least(
        F.lit(100),
        F.when(n >= 50, 20).when(n >= 30, 15).when(n >= 20, 10).otherwise(0)
        + F.least(F.lit(20), hits(low, ANSWER_TERMS) * 5)
        + F.when(low.startswith("error"), 0).otherwise(10)
        + F.when(a.contains("."), 10).otherwise(0)
        + F.when(any_of(low, INSULTS), 0).otherwise(10)
        + F.when(any_of(low, ADVICE_WORDS), 10).otherwise(0)
        + F.least(F.lit(20), overlap * 3),
    )


def response_quality_1(response: Column, category: Column) -> Column:
    """SCR7"""
    low = F.lower(response)
    third, cap = F.lit(3.0), F.lit(0.3)
    bonus = (
        F.when(category == "Emergency", F.least(hits(low, RESPONSE_EMERGENCY) / third, cap))
        .when(category == "Preventive Care", F.least(hits(low, RESPONSE_PREVENTION) / third, cap))
        .otherwise(F.lit(0.2))
    )
    return _cap(
        _sum((F.length(strip(response)) > 10, 0.2))
        + F.least(hits(low, RESPONSE_KEYWORDS) / F.lit(float(len(RESPONSE_KEYWORDS))), cap)
        + bonus
        + _sum((F.length(response).between(50, 300), 0.2))
    )


def exact_match(a: Column, b: Column) -> Column:
    """SCR8"""
    return F.coalesce(F.lower(strip(a)) == F.lower(strip(b)), F.lit(False))


def answer_confidence(a: Column, terms=CONFIDENCE_TERMS) -> Column:
    """SCR9"""
    boost = F.least(hits(a, terms) * F.lit(0.1), F.lit(0.3))
    return F.when(word_count(a) < 5, F.lit(0.3)).otherwise(F.least(F.lit(0.6) + boost, F.lit(0.95)))
