"""Curation profiles: standard, enhanced, thorough.

Each is one lazy DataFrame.  Cheap filters come first, text is cleaned once, and the only shuffles are
deduplication and the final sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, predicates, score
from ..functions.common import first_filled, strip
from ..functions.text import (
    clean_text,
    comprehensive_clean,
    detect_language,
    enhanced_clean,
    expand_abbreviations,
    normalize_answer,
    normalize_stats,
)
from ..lexicon import MEDICAL, Profile
from ..operators.dedupe import dedupe_exact, dedupe_hash
from ..operators.fuzzy import dedupe_fuzzy
from ..operators.staging import compute, keep
from ..sources.readers import with_fallbacks

CLEANER_VERSION = "qacorpus-1"


def _optional(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _pair_text(low: bool = True):
    text = F.concat_ws(" ", F.col("question"), F.col("answer"))
    return F.lower(text) if low else text


def fill_missing(df: DataFrame, profile: Profile = MEDICAL, source: str = "unified_cleaner") -> DataFrame:
    """CLS4: fill empty specialty, severity, language, type and source; ``filled`` counts them.

    Rows without question or answer are left as they are.
    """
    both = (F.coalesce("question", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != "")
    q_lang = detect_language(F.col("question"))
    staged = df.withColumn("_low", _pair_text()).withColumn("_both", both)
    values = {
        "specialty": classify.specialty(F.col("_low"), profile),
        "severity_level": classify.severity(F.col("_low"), profile),
        "language": F.when(q_lang != "unknown", q_lang).otherwise(detect_language(F.col("answer"))),
        "type": classify.qa_type(F.lower("question")),
        "source": F.lit(source),
    }
    filled = F.lit(0)
    columns = []
    for name, value in values.items():
        old = F.nullif(_optional(df, name), F.lit(""))
        columns.append(F.when(F.col("_both") & old.isNull(), value).otherwise(_optional(df, name)).alias(name))
        filled = filled + F.when(F.col("_both") & old.isNull(), 1).otherwise(0)
    rest = [c for c in df.columns if c not in values]
    return staged.select(*rest, *columns, filled.alias("filled"))


def funnel(df: DataFrame, profile: Profile = MEDICAL) -> DataFrame:
    """FLT12: status of every raw row under the standard profile."""
    staged = with_fallbacks(df).withColumn("_low", _pair_text())
    return staged.withColumn(
        "status", predicates.funnel_status(F.col("question"), F.col("answer"), F.col("_low"), profile)
    ).drop("_low")


def standard(df: DataFrame, profile: Profile = MEDICAL, processed_at=None) -> DataFrame:
    """Complete, relevant, inoffensive rows; basic cleaning; missing fields filled; first of equal questions."""
    q, a, low = F.col("question"), F.col("answer"), F.col("_low")
    staged = compute(with_fallbacks(df), {"_low": _pair_text()})
    good = keep(staged, predicates.funnel_status(q, a, low, profile) == "cleaned").drop("_low")

    def base(c):
        return normalize_stats(expand_abbreviations(clean_text(c), profile))

    texts = {"question": base(q), "answer": normalize_answer(base(a))}
    if "explanation" in df.columns:
        texts["explanation"] = expand_abbreviations(clean_text(F.col("explanation")), profile)
    if "context" in df.columns:
        texts["context"] = clean_text(F.col("context"))
    cleaned = (
        keep(compute(good, texts), (q != "") & (a != ""))
        .withColumn("language", F.lit("english"))
        .withColumn("type", F.lit("medical_qa"))
        .withColumn("source", first_filled(_optional(df, "source"), F.lit("unified_cleaner")))
    )
    unique = dedupe_hash(cleaned)
    out = fill_missing(unique, profile).drop("filled").withColumn("cleaner_version", F.lit(CLEANER_VERSION))
    return out.withColumn("processed_at", F.lit(processed_at).cast("timestamp"))


def enhanced(df: DataFrame, profile: Profile = MEDICAL, processed_at=None) -> DataFrame:
    """Five-pass cleaning and metadata; nothing but empty rows is dropped."""
    base = with_fallbacks(df)
    q, a = F.col("question"), F.col("answer")
    quality = F.coalesce(F.col("quality_score"), F.lit(0.8)) if "quality_score" in df.columns else F.lit(0.8)
    texts = {"question": enhanced_clean(q, profile), "answer": enhanced_clean(a, profile)}
    out = keep(compute(base.where((strip(q) != "") & (strip(a) != "")), texts), (q != "") & (a != ""))
    return (
        out.withColumn("_low", _pair_text())
        .withColumn("language", detect_language(q))
        .withColumn("quality_score", quality)
        .withColumn("source", first_filled(_optional(df, "source"), F.lit("enhanced_cleaner")))
        .withColumn("type", F.lit("medical_qa"))
        .withColumn("processed_at", F.lit(processed_at).cast("timestamp"))
        .withColumn("enhanced_cleaning", F.lit(True))
        .withColumn("specialty", classify.specialty(F.col("_low"), profile))
        .withColumn("severity_level", classify.severity(F.col("_low"), profile))
        .withColumn("medical_terms_count", score.term_count(F.col("_low"), profile))
        .drop("_low")
    )


def thorough_stages(
    df: DataFrame, profile: Profile = MEDICAL, fuzzy: bool = True, processed_at=None, min_relevance: float = 2.0,
    min_detail: int = 5, **fuzzy_options,
) -> DataFrame:
    """Rows that survive cleaning and validation, with the final verdict in ``verdict``; not sorted.

    ``fuzzy_options`` go to :func:`dedupe_fuzzy`.
    """
    q, a, low = F.col("question"), F.col("answer"), F.col("_low")
    rows = dedupe_exact(with_fallbacks(df))
    if fuzzy:
        rows = dedupe_fuzzy(rows, **fuzzy_options)
    rows = keep(
        compute(rows, {"_low": _pair_text()}),
        predicates.is_complete_thorough(q, a, profile)
        & (score.quality_basic(q, a, profile) >= F.lit(0.6))
        & (predicates.relevance_detailed(low, profile) >= min_detail)
        & (predicates.relevance_weighted(low, profile) >= F.lit(float(min_relevance))),
    ).drop("_low")
    texts = {"question": comprehensive_clean(strip(q), profile), "answer": comprehensive_clean(strip(a), profile)}
    for name in ("explanation", "context"):
        if name in df.columns:
            texts[name] = comprehensive_clean(F.col(name), profile)
    cleaned = dedupe_hash(keep(compute(rows, texts), (F.length(q) >= 10) & (F.length(a) >= 3)))
    staged = (
        cleaned.withColumn("_lq", F.lower(q))
        .withColumn("_la", F.lower(a))
        .withColumn("_low", _pair_text())
        .withColumn("_tq", score.term_count(F.col("_lq"), profile))
        .withColumn("_ta", score.term_count(F.col("_la"), profile))
        .withColumn("medical_terms_count", score.term_count(low, profile))
        .withColumn("_rel", predicates.is_relevant(low, profile))
    )
    lq, la, quality = F.col("_lq"), F.col("_la"), F.col("quality_score")
    scores = {
        "quality_score": score.quality_detailed(q, a, lq, la, F.col("_tq"), F.col("_ta"), F.col("_rel"), profile),
        "completeness_score": score.completeness(q, a, lq, la, F.col("medical_terms_count")),
    }
    valid = keep(
        compute(staged, scores),
        predicates.valid_thorough(q, a, quality, F.col("completeness_score"), F.col("medical_terms_count"))
        & predicates.valid_combined(q, a, quality),
    )
    return (
        valid.withColumn("specialty", classify.specialty(low, profile))
        .withColumn("severity_level", classify.severity(low, profile))
        .withColumn("verdict", predicates.final_verdict(q, a, quality, low, profile))
        .withColumn("language", F.lit("english"))
        .withColumn("type", F.lit("medical_qa"))
        .withColumn("source", first_filled(_optional(df, "source"), F.lit("thorough_cleaner")))
        .withColumn("processing_method", F.lit("thorough_maximum_quality"))
        .withColumn("validation_passed", F.lit(True))
        .withColumn("processed_at", F.lit(processed_at).cast("timestamp"))
        .drop("_lq", "_la", "_low", "_tq", "_ta", "_rel")
    )


def thorough(df: DataFrame, profile: Profile = MEDICAL, **options) -> DataFrame:
    """The main corpus build: validated rows, best quality first."""
    stages = thorough_stages(df, profile, **options)
    passed = keep(compute(stages, {"verdict": F.col("verdict")}), F.col("verdict") == "passed").drop("verdict")
    return passed.orderBy(F.desc("quality_score"), "ord")


def verdict_counts(stages: DataFrame) -> DataFrame:
    """FLT9: rows per final verdict."""
    return stages.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
