"""FLT1-FLT12, SCR1-SCR9, FEA1-FEA4 and the curation profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features, predicates, score
from ..lexicon import (
    ADVICE_WORDS, ANSWER_TERMS, GENERIC_ANSWERS, INSULTS, MEDICAL, RESPONSE_EMERGENCY, RESPONSE_KEYWORDS, RESPONSE_PREVENTION,
    WH_STARTS, YES_NO_STARTS,
)
from ..operators import profiling, selection
from ..operators.learning import tfidf
from ..operators.staging import compute, keep
from ..plans import curate
from .base import (
    FIXTURE, LABELLED, QA, W_, labelled, lit, qa, qa_low, query, r6, s_any, s_anyword, s_distinct, s_first, s_hits, s_lookup,
    s_nwords, s_occ, s_strip, s_sum, s_word, s_wordcount, s_words, table, texts,
)
from .texts import q_abbr, q_clean, q_fillers, q_grammar, q_polish1, q_polish2, q_stats, q_terms, q_units

P = FIXTURE
ALL = P.all_terms
OFFENSIVE_DEFAULT = MEDICAL.offensive

# ---- SQL fragments over a source with question, answer, lq, la, low
SQ, SA = s_strip("question"), s_strip("answer")
COMPLETE = f"(length({SQ}) >= 10 AND length({SA}) >= 3 AND {s_any(f'lower({SQ})', P.question_markers)})"
GENERIC = ", ".join(lit(g) for g in GENERIC_ANSWERS)
COMPLETE2 = (
    f"(length({SQ}) >= 15 AND length({SA}) >= 5 AND {s_any('lq', P.question_indicators)} AND lower({SA}) NOT IN ({GENERIC}) "
    f"AND {s_distinct('lq')} >= 4 AND {s_distinct('la')} >= 3)"
)
RELEVANT = f"({s_any('low', ALL)} OR {s_anyword('low', P.relevance_simple)})"
WEIGHTED = (
    "(" + " + ".join(f"{s_occ('low', ts)} * {P.occurrence_weight.get(c, 1)}" for c, ts in P.terms.items())
    + f" + {s_hits('low', [a.lower() for a in P.abbreviations], 2)})::DOUBLE + ("
    + " + ".join(s_wordcount("low", p) for p in P.relevance_weighted) + ") * 1.5::DOUBLE"
)
DETAILED = (
    "(" + " + ".join(s_hits("low", ts, P.distinct_weight.get(c, 1)) for c, ts in P.terms.items()) + " + "
    + " + ".join(f"(CASE WHEN {s_word('low', p)} THEN 3 ELSE 0 END)" for p in P.relevance_detailed) + ")::INTEGER"
)
OFFENSIVE = s_anyword("low", P.offensive)
BOTH = f"{SQ} <> '' AND {SA} <> ''"
BASIC = "least(" + s_sum(
    (f"length({SQ}) BETWEEN 20 AND 500", 0.15), (s_any(f"lower({SQ})", P.score_markers), 0.15),
    (s_any(f"lower({SQ})", P.score_terms), 0.10), (f"length({SA}) BETWEEN 10 AND 2000", 0.15),
    (f"contains({SA}, '.') OR length({SA}) > 50", 0.10), (s_any(f"lower({SA})", P.informative), 0.15), (BOTH, 0.10), (BOTH, 0.10),
) + ", 1.0::DOUBLE)"
DETAIL_SCORE = (
    "least((CASE WHEN length(question) BETWEEN 20 AND 500 THEN 0.10::DOUBLE WHEN length(question) BETWEEN 15 AND 600 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) + "
    + s_sum((f"{s_distinct('lq')} >= 5", 0.10), (f"{s_occ('lq', ALL)} >= 2", 0.10))
    + " + (CASE WHEN length(answer) BETWEEN 30 AND 1000 THEN 0.15::DOUBLE WHEN length(answer) BETWEEN 20 AND 1200 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) + "
    + s_sum((f"{s_distinct('la')} >= 8", 0.15), (f"{s_occ('la', ALL)} >= 3", 0.10), (RELEVANT, 0.15),
            (s_any("la", P.informative_detailed), 0.15)) + ", 1.0::DOUBLE)"
)
COMPLETENESS = "least(" + s_sum(
    ("question <> '' AND answer <> ''", 0.3), ("length(question) >= 15 AND length(answer) >= 20", 0.3),
    (f"{s_distinct('lq')} >= 5 AND {s_distinct('la')} >= 8", 0.2), (f"{s_occ('low', ALL)} >= 3", 0.2),
) + ", 1.0::DOUBLE)"
VERDICT = (
    "CASE WHEN NOT (length(question) BETWEEN 10 AND 800 AND length(answer) BETWEEN 5 AND 3000) THEN 'failed_length' "
    f"WHEN quality_score < 0.7::DOUBLE THEN 'failed_quality' WHEN NOT {s_any('low', ALL)} THEN 'failed_medical' ELSE 'passed' END"
)
STATUS = f"CASE WHEN NOT {COMPLETE} THEN 'incomplete' WHEN NOT {RELEVANT} THEN 'irrelevant' WHEN {OFFENSIVE} THEN 'offensive' ELSE 'cleaned' END"


def over_qa(name, sql_expr, column, alias):
    query(name, f"WITH {QA} SELECT ord, {sql_expr} AS {alias} FROM qa")(
        lambda spark, d: qa_low(spark, d).select("ord", column().alias(alias))
    )


def q():
    return F.col("question")


def a():
    return F.col("answer")


def low():
    return F.col("low")


over_qa("flt1_is_complete", COMPLETE, lambda: predicates.is_complete(q(), a(), P), "complete")
over_qa("flt2_is_complete_thorough", COMPLETE2, lambda: predicates.is_complete_thorough(q(), a(), P), "complete")
over_qa("flt3_is_relevant", RELEVANT, lambda: predicates.is_relevant(low(), P), "relevant")
over_qa("flt4_relevance_weighted", WEIGHTED, lambda: predicates.relevance_weighted(low(), P), "relevance")
over_qa("flt5_relevance_detailed", DETAILED, lambda: predicates.relevance_detailed(low(), P), "relevance")
over_qa("flt6_is_offensive", OFFENSIVE, lambda: predicates.is_offensive(low(), P), "offensive")
over_qa("flt11_mentions_emergency", s_any("la", P.emergency_keywords), lambda: predicates.mentions_emergency(F.col("la"), P), "emergency")
over_qa("scr1_quality_basic", BASIC, lambda: score.quality_basic(q(), a(), P), "quality")
over_qa("scr4_term_count", s_occ("low", ALL), lambda: score.term_count(low(), P), "terms")
over_qa(
    "scr3_completeness", COMPLETENESS,
    lambda: score.completeness(q(), a(), F.col("lq"), F.col("la"), score.term_count(low(), P)), "completeness",
)
over_qa(
    "scr2_quality_detailed", DETAIL_SCORE,
    lambda: score.quality_detailed(
        q(), a(), F.col("lq"), F.col("la"), score.term_count(F.col("lq"), P), score.term_count(F.col("la"), P),
        predicates.is_relevant(low(), P), P,
    ),
    "quality",
)
# the default medical profile over every document
query("flt6_is_offensive_default", f"SELECT doc_id, {s_anyword('lower(text)', OFFENSIVE_DEFAULT)} AS offensive FROM documents")(
    lambda spark, d: texts(spark, d).select("doc_id", predicates.is_offensive(F.lower("text")).alias("offensive"))
)

SCORED = f"""{QA}, scored AS (SELECT *, {DETAIL_SCORE} AS quality_score, {COMPLETENESS} AS completeness_score, {s_occ('low', ALL)} AS terms FROM qa)"""


def scored(spark, d):
    rows = qa_low(spark, d)
    staged = rows.withColumn("_tq", score.term_count(F.col("lq"), P)).withColumn("_ta", score.term_count(F.col("la"), P))
    staged = staged.withColumn("terms", score.term_count(low(), P)).withColumn("_rel", predicates.is_relevant(low(), P))
    return staged.withColumn(
        "quality_score",
        score.quality_detailed(q(), a(), F.col("lq"), F.col("la"), F.col("_tq"), F.col("_ta"), F.col("_rel"), P),
    ).withColumn("completeness_score", score.completeness(q(), a(), F.col("lq"), F.col("la"), F.col("terms")))


def filtered(spark, d, condition):
    """Scores are finished before the filter looks at them."""
    rows = scored(spark, d)
    names = ("quality_score", "completeness_score", "terms")
    return keep(compute(rows, {n: F.col(n) for n in names}), condition)


query(
    "flt7_valid_thorough",
    f"""WITH {SCORED} SELECT ord FROM scored WHERE quality_score >= 0.6::DOUBLE AND completeness_score >= 0.5::DOUBLE
 AND terms >= 2 AND length(question) >= 15 AND length(answer) >= 20""",
)(
    lambda spark, d: filtered(
        spark, d, predicates.valid_thorough(q(), a(), F.col("quality_score"), F.col("completeness_score"), F.col("terms"))
    ).select("ord")
)
query(
    "flt8_valid_combined",
    f"WITH {SCORED} SELECT ord FROM scored WHERE length(question) BETWEEN 10 AND 1000 AND length(answer) BETWEEN 5 AND 5000 AND quality_score >= 0.6::DOUBLE",
)(lambda spark, d: filtered(spark, d, predicates.valid_combined(q(), a(), F.col("quality_score"))).select("ord"))
query("flt9_final_verdict", f"WITH {SCORED} SELECT {VERDICT} AS verdict, count(*) AS n FROM scored GROUP BY 1")(
    lambda spark, d: curate.verdict_counts(
        scored(spark, d).withColumn("verdict", predicates.final_verdict(q(), a(), F.col("quality_score"), low(), P))
    )
)
query("flt12_filter_funnel", f"WITH {QA} SELECT {STATUS} AS status, count(*) AS n FROM qa GROUP BY 1")(
    lambda spark, d: curate.funnel(qa(spark, d), P).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "agg17_retention_report",
    f"""WITH {QA}, f AS (SELECT {STATUS} AS s FROM qa), n AS (SELECT count(*) AS c FROM f)
 SELECT count(*) AS original_count, count_if(s = 'cleaned')::BIGINT AS final_count,
 round(count_if(s = 'cleaned') * 100.0::DOUBLE / greatest(count(*), 1), 6) AS data_retention_rate,
 round(count_if(s = 'irrelevant') * 100.0::DOUBLE / greatest(count(*), 1), 6) AS irrelevant_removed_percentage,
 round(count_if(s = 'offensive') * 100.0::DOUBLE / greatest(count(*), 1), 6) AS offensive_removed_percentage,
 round(count_if(s = 'incomplete') * 100.0::DOUBLE / greatest(count(*), 1), 6) AS incomplete_removed_percentage,
 bool_or(s = 'irrelevant') AS relevance_filtering, bool_or(s = 'offensive') AS offensive_removal FROM f""",
)(
    lambda spark, d: profiling.retention_report(curate.funnel(qa(spark, d), P)).select(
        "original_count", "final_count",
        *[r6(c).alias(c) for c in ("data_retention_rate", "irrelevant_removed_percentage", "offensive_removed_percentage", "incomplete_removed_percentage")],
        "relevance_filtering", "offensive_removal",
    )
)
query(
    "cls4_fill_missing",
    f"""WITH {LABELLED}, l AS (SELECT ord, source, low, lq, question, answer, CASE WHEN turn % 2 = 0 THEN specialty ELSE '' END AS sp FROM labelled)
 SELECT ord, CASE WHEN sp = '' THEN {s_first('low', P.specialty, 'general_medicine')} ELSE sp END AS specialty,
 {s_first('low', P.severity, 'moderate')} AS severity_level,
 CASE WHEN regexp_matches(question || answer, '\\p{{L}}') THEN 'english' ELSE 'unknown' END AS language,
 'medical_qa' AS type, source, (CASE WHEN sp = '' THEN 4 ELSE 3 END)::INTEGER AS filled FROM l""",
)(
    lambda spark, d: curate.fill_missing(
        labelled(spark, d)
        .withColumn("specialty", F.when(F.col("turn") % 2 == 0, F.col("specialty")).otherwise(""))
        .drop("severity_level", "type"),
        P,
    ).select("ord", "specialty", "severity_level", "language", "type", "source", "filled")
)

# ---- scores against given columns

DENS_Q = f"({s_hits('lq', P.text_terms)} / greatest({s_nwords('question')}, 1))"
DENS_A = f"({s_hits('la', P.text_terms)} / greatest({s_nwords('answer')}, 1))"


def s_factor(cond, v):
    return f"(CASE WHEN {cond} THEN {v!r}::DOUBLE ELSE 1.0::DOUBLE END)"


QUALITY5 = " * ".join([
    s_factor(f"{s_nwords('question')} >= 10", 1.1), s_factor(f"{s_nwords('answer')} >= 20", 1.2),
    s_factor(f"{DENS_Q} > 0.2::DOUBLE", 1.1), s_factor(f"{DENS_A} > 0.15::DOUBLE", 1.1),
    s_factor(s_any("question", P.text_abbreviations), 1.05), s_factor(s_any("answer", P.text_abbreviations), 1.05),
    s_factor(f"{s_nwords('answer')} < 5", 0.7),
])
SELECTION = f"""{LABELLED}, sel AS (SELECT *, {s_lookup('specialty', P.weight_specialty, 0.7)} AS sw, {s_lookup('severity_level', P.weight_severity, 0.9)} AS vw,
 {s_lookup('type', P.weight_type, 1.0)} AS tw, ({QUALITY5}) AS qs FROM labelled), sc AS (SELECT *, sw * vw * tw * qs AS score FROM sel)"""


def selection_rows(spark, d):
    return selection.score_rows(labelled(spark, d), P)


query(
    "scr5_selection_score",
    f"""WITH {SELECTION} SELECT ord, round(score, 6) AS score, sw AS specialty_score, vw AS severity_score, round(qs, 6) AS quality_score,
 {s_nwords('question')} AS q_word_count, {s_nwords('answer')} AS a_word_count, round({DENS_Q}, 6) AS q_medical_density,
 round({DENS_A}, 6) AS a_medical_density FROM sc""",
)(
    lambda spark, d: selection_rows(spark, d).select("ord", "feature_details.*").select(
        "ord", r6("score").alias("score"), "specialty_score", "severity_score", r6("quality_score").alias("quality_score"),
        "q_word_count", "a_word_count", r6("q_medical_density").alias("q_medical_density"),
        r6("a_medical_density").alias("a_medical_density"),
    )
)
query(
    "flt10_min_score",
    f"WITH {SELECTION} SELECT ord, round(score, 6) AS score FROM sc WHERE round(score, 6) >= 1.0::DOUBLE",
)(
    lambda spark, d: selection.select_top(selection_rows(spark, d).withColumn("score", r6("score")), None, 1.0).select("ord", "score")
)
query(
    "srt2_select_top_n",
    f"WITH {SELECTION} SELECT ord, round(score, 6) AS score FROM sc WHERE round(score, 6) >= 0.8::DOUBLE ORDER BY 2 DESC, 1 LIMIT 50",
)(
    lambda spark, d: selection.select_top(selection_rows(spark, d).withColumn("score", r6("score")), 50, 0.8).select("ord", "score")
)
query(
    "agg7_score_stats",
    f"""WITH {SELECTION}, s AS (SELECT round(score, 6) AS score FROM sc) SELECT min(score) AS min, max(score) AS max,
 round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(stddev_pop(score), 6) AS std FROM s""",
)(
    lambda spark, d: profiling.score_stats(selection_rows(spark, d).withColumn("score", r6("score"))).select(
        "min", "max", r6("mean").alias("mean"), r6("median").alias("median"), r6("std").alias("std")
    )
)
LEN = "CASE WHEN length(answer) >= 50 THEN 20 WHEN length(answer) >= 30 THEN 15 WHEN length(answer) >= 20 THEN 10 ELSE 0 END"
over_qa(
    "scr6_answer_quality_100",
    f"""least(100, {LEN} + least(20, {s_hits('la', ANSWER_TERMS)} * 5) + CASE WHEN starts_with(la, 'error') THEN 0 ELSE 10 END
 + CASE WHEN contains(answer, '.') THEN 10 ELSE 0 END + CASE WHEN {s_any('la', INSULTS)} THEN 0 ELSE 10 END
 + CASE WHEN {s_any('la', ADVICE_WORDS)} THEN 10 ELSE 0 END
 + least(20, len(list_intersect(list_distinct({s_words('lq')}), list_distinct({s_words('la')}))) * 3))::INTEGER""",
    lambda: score.answer_quality_100(q(), a()), "quality",
)
CAT = "CASE conv_id % 3 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'Preventive Care' ELSE 'Basic' END"
RESPONSE = f"""least((CASE WHEN length({SA}) > 10 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
 + least({s_hits('la', RESPONSE_KEYWORDS)} / {len(RESPONSE_KEYWORDS)}.0::DOUBLE, 0.3::DOUBLE)
 + CASE {CAT} WHEN 'Emergency' THEN least({s_hits('la', RESPONSE_EMERGENCY)} / 3.0::DOUBLE, 0.3::DOUBLE)
   WHEN 'Preventive Care' THEN least({s_hits('la', RESPONSE_PREVENTION)} / 3.0::DOUBLE, 0.3::DOUBLE) ELSE 0.2::DOUBLE END
 + (CASE WHEN length(answer) BETWEEN 50 AND 300 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END), 1.0::DOUBLE)"""
over_qa("scr7_response_quality", f"round({RESPONSE}, 6)", lambda: r6(score.response_quality_1(a(), F.expr(CAT))), "quality")
query(
    "scr8_exact_match",
    f"""SELECT d.doc_id, lower({s_strip('d.text')}) = lower({s_strip('e.text')}) AS same
 FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1""",
)(lambda spark, d: _neighbour_match(spark, d))


def _neighbour_match(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(nxt, "doc_id").select("doc_id", score.exact_match(F.col("text"), F.col("other")).alias("same"))


CONF_TERMS = ("The", "Der", "tion", "ung")
over_qa(
    "scr9_answer_confidence",
    f"round(CASE WHEN {s_nwords('answer')} < 5 THEN 0.3::DOUBLE ELSE least(0.6::DOUBLE + least({s_hits('answer', CONF_TERMS)} * 0.1::DOUBLE, 0.3::DOUBLE), 0.95::DOUBLE) END, 6)",
    lambda: r6(score.answer_confidence(a(), CONF_TERMS)), "confidence",
)

# ---- features

D = r"\p{Nd}+"


def bigrams(x):
    w = s_words(f"lower({x})")
    return f"array_to_string(list_transform(range(1, greatest(1, least(len({w}) - 1, 10) + 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]), '|')"


def starts(x, prefixes):
    return "(" + " OR ".join(f"starts_with({x}, {lit(p)})" for p in prefixes) + ")::INTEGER"


query(
    "fea1_qa_features",
    f"""WITH {QA} SELECT ord, {s_nwords('question')} AS q_word_count, {s_nwords('answer')} AS a_word_count, length(question)::INTEGER AS q_char_count,
 length(answer)::INTEGER AS a_char_count, round({s_nwords('answer')} / greatest({s_nwords('question')}, 1), 6) AS qa_length_ratio,
 {s_hits('lq', P.feature_terms)} AS q_medical_terms, {s_hits('la', P.feature_terms)} AS a_medical_terms,
 {starts('lq', ['what'])} AS is_what_question, {starts('lq', ['how'])} AS is_how_question, {starts('lq', ['why'])} AS is_why_question,
 {starts('lq', YES_NO_STARTS)} AS is_yes_no_question, {bigrams('question')} AS q_bigrams, {bigrams('answer')} AS a_bigrams,
 regexp_matches(question, '{D}')::INTEGER AS q_has_numbers, regexp_matches(answer, '{D}')::INTEGER AS a_has_numbers,
 len(regexp_extract_all(question, '{D}'))::INTEGER AS q_number_count, len(regexp_extract_all(answer, '{D}'))::INTEGER AS a_number_count,
 {s_hits('lower(question || answer)', P.urgent_words)} AS urgency_score FROM qa""",
)(
    lambda spark, d: qa(spark, d)
    .select("ord", features.qa_features(q(), a(), P).alias("f"))
    .select("ord", "f.*")
    .withColumn("q_bigrams", F.array_join("q_bigrams", "|"))
    .withColumn("a_bigrams", F.array_join("a_bigrams", "|"))
    .withColumn("qa_length_ratio", r6("qa_length_ratio"))
)
query(
    "fea2_text_features",
    f"""SELECT doc_id, length(text)::INTEGER AS char_count, n AS word_count,
 len(list_filter(string_split(text, '.'), lambda s: {s_strip('s')} <> ''))::INTEGER AS sentence_count,
 round(coalesce(list_avg(list_transform({s_words('text')}, lambda w: length(w))), 0.0), 6) AS avg_word_length,
 h AS medical_term_count, round(h / greatest(n, 1), 6) AS medical_term_density, {s_hits('text', P.text_abbreviations)} AS abbreviation_count,
 contains(text, '?')::INTEGER AS has_question_mark, {starts('lower(text)', WH_STARTS)} AS starts_with_wh,
 regexp_matches(text, '{D}')::INTEGER AS has_numbers, len(regexp_extract_all(text, '{D}'))::INTEGER AS number_count
 FROM (SELECT *, {s_nwords('text')} AS n, {s_hits('lower(text)', P.text_terms)} AS h FROM documents)""",
)(
    lambda spark, d: texts(spark, d)
    .select("doc_id", features.text_features(F.col("text"), P).alias("f"))
    .select("doc_id", "f.*")
    .withColumn("avg_word_length", r6("avg_word_length"))
    .withColumn("medical_term_density", r6("medical_term_density"))
)
STARTS = (("the", "The", "Can you explain the"), ("la", "La", "What is the best way to la"), ("der", "Der", "Dieser"))
AUG_CASE = " ".join(f"WHEN starts_with(lower(question), {lit(p)}) THEN replace(question, {lit(o)}, {lit(n)})" for p, o, n in STARTS)
query(
    "fea3_augment",
    f"""WITH {LABELLED}, c AS (SELECT *, row_number() OVER (ORDER BY ord) AS rk FROM labelled
   WHERE severity_level IN ('critical', 'high') AND specialty <> 'general_medicine'),
 chosen AS (SELECT * FROM c WHERE rk <= floor((SELECT count(*) FROM labelled) * 0.4::DOUBLE)),
 copies AS (SELECT ord, CASE WHEN contains(question, '?') AND NOT contains(lower(question), 'please') THEN replace(question, '?', ', please?') END AS question FROM chosen
   UNION ALL SELECT ord, CASE {AUG_CASE} END AS question FROM chosen)
 SELECT ord, question, false AS augmented FROM labelled UNION ALL SELECT ord, question, true FROM copies WHERE question IS NOT NULL""",
)(
    lambda spark, d: selection.augment(labelled(spark, d), 0.4, profile=P, starts=STARTS).select("ord", "question", "augmented")
)
STOP = ("the", "of", "and", "der", "la", "de")
query(
    "fea4_tfidf",
    f"""WITH tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{W_}{{2,}}'), lambda w: w NOT IN ({', '.join(lit(s) for s in STOP)})) AS w FROM documents),
 g AS (SELECT doc_id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM tok),
 v AS (SELECT term FROM g GROUP BY term ORDER BY count(*) DESC, term LIMIT 1000),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM g JOIN v USING (term) GROUP BY ALL),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term)
 SELECT doc_id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS weight FROM tf JOIN idf USING (term)""",
)(
    lambda spark, d: tfidf(texts(spark, d), "doc_id", "text", 1000, list(STOP)).withColumn("weight", r6("weight"))
)

# ---- whole profiles

OLD = "question, answer, lower(question) AS lq, lower(answer) AS la, lower(question || ' ' || answer) AS low"


def staged_sql(source, steps):
    """Rewrite question and answer step by step."""
    sql = f"SELECT ord, question, answer FROM {source}"
    for s in steps:
        sql = f"SELECT ord, {s('question')} AS question, {s('answer')} AS answer FROM ({sql})"
    return sql


def key_sql(x):
    return f"regexp_replace(lower({s_strip(x)}), {lit('[' + chr(92) + 's' + chr(92) + 'p{Z}]+')}, ' ', 'g')"


query(
    "curate_standard",
    f"""WITH {QA}, good AS (SELECT * FROM qa WHERE {STATUS} = 'cleaned'),
 cleaned AS ({staged_sql('good', (q_clean, q_abbr, q_stats))}),
 kept AS (SELECT *, row_number() OVER (PARTITION BY {key_sql('question')} ORDER BY ord) AS rn FROM cleaned WHERE question <> '' AND answer <> '')
 SELECT ord, question, answer, {s_first("lower(question || ' ' || answer)", P.specialty, 'general_medicine')} AS specialty,
 {s_first("lower(question || ' ' || answer)", P.severity, 'moderate')} AS severity_level FROM kept WHERE rn = 1""",
)(lambda spark, d: curate.standard(qa(spark, d), P).select("ord", "question", "answer", "specialty", "severity_level"))
query(
    "curate_enhanced",
    f"""WITH {QA}, cleaned AS ({staged_sql('qa', (q_clean, q_abbr, q_stats, q_units, q_fillers))}),
 c AS (SELECT ord, {OLD} FROM cleaned WHERE question <> '' AND answer <> '')
 SELECT ord, question, answer, {s_first('low', P.specialty, 'general_medicine')} AS specialty, {s_first('low', P.severity, 'moderate')} AS severity_level,
 {s_occ('low', ALL)} AS medical_terms_count FROM c""",
)(
    lambda spark, d: curate.enhanced(qa(spark, d), P).select(
        "ord", "question", "answer", "specialty", "severity_level", "medical_terms_count"
    )
)
CURATE_THOROUGH = (
    f"""WITH {QA}, first AS (SELECT * FROM qa QUALIFY row_number() OVER (PARTITION BY lower({SQ}) ORDER BY ord) = 1),
 good AS (SELECT * FROM first WHERE {COMPLETE2} AND {BASIC} >= 0.6::DOUBLE AND {DETAILED} >= 5 AND {WEIGHTED} >= 2.0::DOUBLE),
 cleaned AS ({staged_sql('good', (q_clean, q_abbr, q_stats, q_units, q_grammar, q_terms, q_fillers, q_polish1, q_polish2))}),
 one AS (SELECT ord, {OLD} FROM cleaned WHERE length(question) >= 10 AND length(answer) >= 3
   QUALIFY row_number() OVER (PARTITION BY {key_sql('question')} ORDER BY ord) = 1),
 s AS (SELECT *, {DETAIL_SCORE} AS quality_score, {COMPLETENESS} AS completeness_score, {s_occ('low', ALL)} AS terms FROM one)
 SELECT ord, question, answer, round(quality_score, 6) AS quality_score, round(completeness_score, 6) AS completeness_score,
 terms AS medical_terms_count, {s_first('low', P.specialty, 'general_medicine')} AS specialty, {s_first('low', P.severity, 'moderate')} AS severity_level
 FROM s WHERE quality_score >= 0.6::DOUBLE AND completeness_score >= 0.5::DOUBLE AND terms >= 2 AND length(question) BETWEEN 15 AND 1000
 AND length(answer) BETWEEN 20 AND 5000 AND ({VERDICT}) = 'passed'"""
)
query("curate_thorough", CURATE_THOROUGH)(
    lambda spark, d: curate.thorough(qa(spark, d), P, fuzzy=False).select(
        "ord", "question", "answer", r6("quality_score").alias("quality_score"), r6("completeness_score").alias("completeness_score"),
        "medical_terms_count", "specialty", "severity_level",
    )
)
# Every pair once more with an edited question: the fuzzy step must drop just these.
query("curate_thorough_fuzzy", CURATE_THOROUGH)(
    lambda spark, d: curate.thorough(_with_edited(qa(spark, d)), P, fuzzy=True, autojunk=False).select(
        "ord", "question", "answer", r6("quality_score").alias("quality_score"), r6("completeness_score").alias("completeness_score"),
        "medical_terms_count", "specialty", "severity_level",
    )
)


def _with_edited(pairs):
    again = pairs.withColumns({"ord": F.col("ord") + (1 << 55), "question": F.concat("question", F.lit(" q"))})
    return pairs.unionByName(again)



query(
    "srt1_sort_by_quality",
    f"WITH {SCORED} SELECT ord, round(quality_score, 6) AS quality_score FROM scored ORDER BY quality_score DESC, ord",
)(lambda spark, d: selection.sort_by_quality(scored(spark, d)).select("ord", r6("quality_score").alias("quality_score")))
