"""Row features (FEA1, FEA2, FEA6) and question variations (FEA3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import DISEASE_LABELS, MEDICAL, WH_STARTS, YES_NO_STARTS, Profile
from .common import WS, WS_INNER, hits, starts_with_any, whole_word, word_count
from .text import ngrams

DIGITS = r"\p{Nd}+"


def _flag(c: Column) -> Column:
    return c.cast("int")


def qa_features(q: Column, a: Column, profile: Profile = MEDICAL) -> Column:
    """FEA1: 18 features of one pair as a struct."""
    lq, la = F.lower(q), F.lower(a)
    qw, aw = word_count(q), word_count(a)
    digits = F.lit(DIGITS)
    fields = {
        "q_word_count": qw,
        "a_word_count": aw,
        "q_char_count": F.length(q),
        "a_char_count": F.length(a),
        "qa_length_ratio": aw / F.greatest(qw, F.lit(1)),
        "q_medical_terms": hits(lq, profile.feature_terms),
        "a_medical_terms": hits(la, profile.feature_terms),
        "is_what_question": _flag(lq.startswith("what")),
        "is_how_question": _flag(lq.startswith("how")),
        "is_why_question": _flag(lq.startswith("why")),
        "is_yes_no_question": _flag(starts_with_any(lq, YES_NO_STARTS)),
        "q_bigrams": ngrams(q, 2, 10),
        "a_bigrams": ngrams(a, 2, 10),
        "q_has_numbers": _flag(q.rlike(DIGITS)),
        "a_has_numbers": _flag(a.rlike(DIGITS)),
        "q_number_count": F.regexp_count(q, digits),
        "a_number_count": F.regexp_count(a, digits),
        # question and answer are joined without a blank
        "urgency_score": hits(F.lower(F.concat(q, a)), profile.urgent_words),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def text_features(c: Column, profile: Profile = MEDICAL) -> Column:
    """FEA2: 11 features of one text as a struct; empty text gives zeros."""
    c = F.coalesce(c, F.lit(""))
    low = F.lower(c)
    n = word_count(c)
    term_hits = hits(low, profile.text_terms)
    letters = F.length(F.regexp_replace(c, WS + "+", ""))
    fields = {
        "char_count": F.length(c),
        "word_count": n,
        # pieces between full stops that are not blank
        "sentence_count": F.regexp_count(c, F.lit(f"[^.{WS_INNER}][^.]*")),
        "avg_word_length": letters / F.greatest(n, F.lit(1)),
        "medical_term_count": term_hits,
        "medical_term_density": term_hits / F.greatest(n, F.lit(1)),
        "abbreviation_count": hits(c, profile.text_abbreviations),
        "has_question_mark": _flag(c.contains("?")),
        "starts_with_wh": _flag(starts_with_any(low, WH_STARTS)),
        "has_numbers": _flag(c.rlike(DIGITS)),
        "number_count": F.regexp_count(c, F.lit(DIGITS)),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def question_variations(q: Column, starts=(("what is", "What is", "Can you explain what is"),
                                           ("how to", "How to", "What is the best way to"))) -> Column:
    """FEA3: array of reworded questions (the original is not included)."""
    low = F.lower(q)
    please = F.when(
        q.contains("?") & ~low.contains("please"), F.replace(q, F.lit("?"), F.lit(", please?"))
    )
    reworded = None
    for prefix, old, new in starts:
        text = F.replace(q, F.lit(old), F.lit(new))
        reworded = F.when(low.startswith(prefix), text) if reworded is None else reworded.when(low.startswith(prefix), text)
    return F.array_compact(F.array(please, reworded))


def disease_label(low: Column, labels=tuple(DISEASE_LABELS)) -> Column:
    """FEA6: longest label that occurs as whole words, else null."""
    out = None
    for label in sorted(labels, key=lambda s: (-len(s), s)):
        cond = low.contains(label) & low.rlike(whole_word([label]))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out
