"""Classifiers (CLS1-CLS11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import (
    ALERT_ANSWER_MARKS,
    ALERT_ANSWER_TYPES,
    DISEASE_GROUPS,
    MCQ_MARKERS,
    MEDICAL,
    RESPONSE_CATEGORIES,
    ROUTES,
    TRIAGE_CATEGORY,
    TRIAGE_SEVERITY,
    Profile,
)
from .common import all_of, any_of, balanced, first_match, hits


def severity(low: Column, profile: Profile = MEDICAL) -> Column:
    """CLS1"""
    return first_match(low, profile.severity, profile.severity_default)


def specialty(low: Column, profile: Profile = MEDICAL) -> Column:
    """CLS2"""
    return first_match(low, profile.specialty, profile.specialty_default)


def qa_type(low_question: Column) -> Column:
    """CLS3"""
    return F.when(any_of(low_question, MCQ_MARKERS), "medical_mcq").otherwise("medical_qa")


def keyword_argmax(low: Column, categories: dict | None = None, default: str = "Other") -> Column:
    """CLS5: category with most distinct keyword hits; ties go to the first listed."""
    categories = RESPONSE_CATEGORIES if categories is None else categories
    scored = F.array_max(
        F.array(
            *[
                F.struct(hits(low, ts).alias("n"), F.lit(-i).alias("o"), F.lit(cat).alias("c"))
                for i, (cat, ts) in enumerate(categories.items())
            ]
        )
    )
    return F.when(scored["n"] > 0, scored["c"]).otherwise(default)


def disease_specialty(low: Column, groups: dict | None = None) -> Column:
    """CLS6"""
    groups = DISEASE_GROUPS if groups is None else groups
    return first_match(low, {k.capitalize(): v for k, v in groups.items()}, "General Medicine")


def confidence(log_score: Column) -> Column:
    """CLS7: percentage from a log probability."""
    return F.least(F.lit(100.0), F.exp(log_score) * F.lit(100.0))


def confidence_level(conf: Column) -> Column:
    return F.when(conf >= 70, "HIGH").when(conf >= 40, "MODERATE").otherwise("LOW")


def emergency_rule(low: Column, profile: Profile = MEDICAL) -> Column:
    """CLS8: type of the first rule with a pattern whose keywords all occur, else null."""
    out = None
    for kind, _severity, patterns in profile.alert_rules:
        cond = balanced(lambda a, b: a | b, [all_of(low, p) for p in patterns])
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise(F.lit(None).cast("string"))


def emergency_severity(kind: Column, profile: Profile = MEDICAL) -> Column:
    out = F.lit(None).cast("string")
    for name, level, _ in profile.alert_rules:
        out = F.when(kind == name, level).otherwise(out)
    return out


def emergency_message(kind: Column, profile: Profile = MEDICAL) -> Column:
    out = F.lit(None).cast("string")
    for name, text in profile.alert_messages.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def emergency_answer(answer: Column, marks=ALERT_ANSWER_MARKS, types: dict | None = None) -> Column:
    """CLS9: alert headline for an answer that carries an alert mark, else null."""
    kinds = {v: (k,) for k, v in (ALERT_ANSWER_TYPES if types is None else types).items()}
    return F.when(any_of(answer, marks), first_match(answer, kinds, "MEDICAL EMERGENCY"))


def triage_severity(low: Column, table: dict | None = None) -> Column:
    """CLS10"""
    return first_match(low, TRIAGE_SEVERITY if table is None else table, "mild")


def triage_category(low: Column, table: dict | None = None) -> Column:
    return first_match(low, TRIAGE_CATEGORY if table is None else table, "unknown")


def triage_action(level: Column, category: Column) -> Column:
    return (
        F.when(level == "severe", "notify_doctor")
        .when((level == "moderate") & category.isin("cardiovascular", "respiratory"), "notify_doctor")
        .when(level == "moderate", "monitor")
        .otherwise("save_to_db")
    )


def route_question(low: Column, routes: dict | None = None) -> Column:
    """CLS11 category"""
    return first_match(low, ROUTES if routes is None else routes, "general")


def route_priority(category: Column) -> Column:
    return F.when(category == "emergency", "high").otherwise("normal")
