"""Row predicates (FLT1-FLT12).  Arguments named ``low`` expect lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import GENERIC_ANSWERS, MEDICAL, Profile
from .common import any_of, balanced, distinct_words, hits, let, matches_any, occurrences, strip, whole_word


def is_complete(q: Column, a: Column, profile: Profile = MEDICAL) -> Column:
    """FLT1"""
    q, a = strip(q), strip(a)
    return F.coalesce(
        (F.length(q) >= 10) & (F.length(a) >= 3) & let(F.lower(q), lambda lq: any_of(lq, profile.question_markers)),
        F.lit(False),
    )


def is_complete_thorough(q: Column, a: Column, profile: Profile = MEDICAL) -> Column:
    """FLT2"""
    q, a = strip(q), strip(a)
    asks = let(F.lower(q), lambda lq: any_of(lq, profile.question_indicators) & (distinct_words(lq) >= 4))
    tells = let(F.lower(a), lambda la: ~la.isin(*GENERIC_ANSWERS) & (distinct_words(la) >= 3))
    return F.coalesce((F.length(q) >= 15) & (F.length(a) >= 5) & asks & tells, F.lit(False))


def is_relevant(low: Column, profile: Profile = MEDICAL) -> Column:
    """FLT3"""
    return F.coalesce(any_of(low, profile.all_terms) | matches_any(low, profile.relevance_simple), F.lit(False))


def relevance_weighted(low: Column, profile: Profile = MEDICAL) -> Column:
    """FLT4 score: occurrences x category weight + 2 per abbreviation substring + 1.5 per pattern match."""
    parts = [
        occurrences(low, ts) * F.lit(profile.occurrence_weight.get(cat, 1)) for cat, ts in profile.terms.items()
    ]
    parts.append(hits(low, [a.lower() for a in profile.abbreviations], 2))
    matches = balanced(
        lambda a, b: a + b, [F.regexp_count(low, F.lit(whole_word(p))) for p in profile.relevance_weighted]
    )
    return balanced(lambda a, b: a + b, parts).cast("double") + matches * F.lit(1.5)


def relevance_detailed(low: Column, profile: Profile = MEDICAL) -> Column:
    """FLT5 score: 2 or 1 per distinct term, 3 per matching pattern."""
    parts = [hits(low, ts, profile.distinct_weight.get(cat, 1)) for cat, ts in profile.terms.items()]
    parts += [F.when(low.rlike(whole_word(p)), 3).otherwise(0) for p in profile.relevance_detailed]
    return balanced(lambda a, b: a + b, parts)


def is_offensive(low: Column, profile: Profile = MEDICAL) -> Column:
    """FLT6"""
    return F.coalesce(matches_any(low, profile.offensive), F.lit(False))


def valid_thorough(q: Column, a: Column, quality: Column, completeness: Column, terms: Column) -> Column:
    """FLT7"""
    return F.coalesce(
        (quality >= F.lit(0.6))
        & (completeness >= F.lit(0.5))
        & (terms >= 2)
        & (F.length(q) >= 15)
        & (F.length(a) >= 20),
        F.lit(False),
    )


def valid_combined(q: Column, a: Column, quality: Column) -> Column:
    """FLT8"""
    return F.coalesce(
        F.length(q).between(10, 1000) & F.length(a).between(5, 5000) & (quality >= F.lit(0.6)), F.lit(False)
    )


def final_verdict(q: Column, a: Column, quality: Column, low: Column, profile: Profile = MEDICAL) -> Column:
    """FLT9: ``passed`` or the first failing reason (length, quality, medical)."""
    length_ok = F.length(q).between(10, 800) & F.length(a).between(5, 3000)
    return (
        F.when(~F.coalesce(length_ok, F.lit(False)), "failed_length")
        .when(~F.coalesce(quality >= F.lit(0.7), F.lit(False)), "failed_quality")
        .when(~any_of(low, profile.all_terms), "failed_medical")
        .otherwise("passed")
    )


def mentions_emergency(low: Column, profile: Profile = MEDICAL) -> Column:
    """FLT11"""
    return F.coalesce(any_of(low, profile.emergency_keywords), F.lit(False))


def funnel_status(q: Column, a: Column, low: Column, profile: Profile = MEDICAL) -> Column:
    """FLT12: first failing test of the standard profile."""
    return (
        F.when(~is_complete(q, a, profile), "incomplete")
        .when(~is_relevant(low, profile), "irrelevant")
        .when(is_offensive(low, profile), "offensive")
        .otherwise("cleaned")
    )
