"""TXT1-TXT20, CLS1-CLS11 on text, FEA6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, features, text
from ..functions.common import NON_WS, WS
from ..lexicon import ANSWER_FORMS
from .base import (
    FIXTURE, QA, W_, lit, low_text, qa, qa_low, query, s_all, s_any, s_first, s_hits, s_phrase, s_squeeze, s_steps,
    s_strip, s_sub, s_word, s_words, table, texts,
)

ABBR = " ".join(f"WHEN {lit(k)} THEN {lit(f'{k} ({v})')}" for k, v in FIXTURE.abbreviations.items())

# ---- SQL of each step, x -> expression


def q_clean(x):
    x = s_sub(x, "<[^>]+>", "")
    x = s_sub(x, f"https?://{NON_WS}+", "")
    x = s_sub(x, f"{NON_WS}+@{NON_WS}+", "")
    for c in "ABCD":
        x = s_sub(x, rf"{WS}*\([{c}{c.lower()}]\){WS}*", f" ({c}) ")
    return s_strip(s_squeeze(s_sub(x, "([!?.]){2,}", r"\1")))


def q_abbr(x):
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, {lit(W_ + '+|[^' + W_[1:-1] + ']+')}), "
        f"lambda t: CASE t {ABBR} ELSE t END), '')"
    )


def q_stats(x):
    d = r"\p{Nd}"
    for p, r in (
        (rf"p{WS}*<{WS}*0\.05", "p-value less than 0.05"), (rf"p{WS}*<{WS}*0\.01", "p-value less than 0.01"),
        (rf"p{WS}*>{WS}*0\.05", "p-value greater than 0.05"), (rf"p{WS}*={WS}*({d}+\.?{d}*)", r"p-value equals \1"),
        (rf"95%{WS}*CI", "95% confidence interval"), (rf"CI{WS}*95%", "95% confidence interval"),
        (rf"({d}+){WS}*-{WS}*({d}+)", r"\1 to \2"), (rf"({d}+)%", r"\1 percent"),
    ):
        x = s_sub(x, p, r)
    return x


def q_units(x):
    d = r"\p{Nd}"
    num = rf"({d}+\.?{d}*){WS}*"
    x = s_sub(x, rf"(?i)({d}+)/({d}+){WS}*mmhg", r"\1/\2 mmHg")
    for u in ("c", "f"):
        x = s_sub(x, f"(?i){num}°?{u}", rf"\1°{u.upper()}")
    for u in ("kg", "lb", "cm", "mg", "ml"):
        x = s_sub(x, f"(?i){num}{u}", rf"\1 {u}")
    return x


def q_grammar(x):
    x = s_sub(x, WS + "+([,.!?])", r"\1")
    x = s_sub(x, "([,.!?])([A-Za-z])", r"\1 \2")
    x = s_squeeze(s_sub(x, "([a-z])([A-Z])", r"\1 \2"))
    parts = f"list_transform(string_split({x}, '. '), lambda s: {s_strip('s')})"
    kept = f"list_filter({parts}, lambda s: s <> '')"
    return f"array_to_string(list_transform({kept}, lambda s: upper(s[1]) || lower(s[2:])), '. ')"


def q_terms(x):
    for p, r in FIXTURE.phrases.items():
        x = s_phrase(x, p, r)
    return x


def q_fillers(x):
    for alternatives in FIXTURE.fillers:
        x = s_phrase(x, "|".join(alternatives), "")
    return s_strip(s_squeeze(x))


def q_polish1(x):
    return s_strip(s_squeeze(s_sub(x, "([!?.]){3,}", r"\1\1")))


def q_polish2(x):
    return f"CASE WHEN {x} = '' OR right({x}, 1) IN ('.', '!', '?') THEN {x} ELSE {x} || '.' END"


def docs_sql(*steps):
    return s_steps("documents", "doc_id", "text", steps)


def over_docs(fn):
    return lambda spark, d: texts(spark, d).select("doc_id", fn(F.col("text")).alias("x"))


COMPREHENSIVE = (q_clean, q_abbr, q_stats, q_units, q_grammar, q_terms, q_fillers, q_polish1, q_polish2)

query("txt1_clean_text", docs_sql(q_clean))(over_docs(text.clean_text))
query("txt1_clean_html", s_steps("pages", "page_id", "html", [q_clean]))(
    lambda spark, d: texts(spark, d, "pages", "page_id").select("page_id", text.clean_text(F.col("html")).alias("x"))
)
query("txt2_expand_abbreviations", docs_sql(q_abbr))(over_docs(lambda c: text.expand_abbreviations(c, FIXTURE)))
query("txt3_normalize_stats", docs_sql(q_stats))(over_docs(text.normalize_stats))
query("txt5_standardize_units", docs_sql(q_units))(over_docs(text.standardize_units))
query("txt6_fix_grammar", docs_sql(q_grammar))(over_docs(text.fix_grammar))
query("txt7_enhance_terms", docs_sql(q_terms))(over_docs(lambda c: text.enhance_terms(c, FIXTURE)))
query("txt8_remove_redundant", docs_sql(q_fillers))(over_docs(lambda c: text.remove_redundant(c, FIXTURE)))
query("txt9_final_polish", docs_sql(q_polish1, q_polish2))(over_docs(text.final_polish))
query("txt10_comprehensive_clean", docs_sql(*COMPREHENSIVE))(over_docs(lambda c: text.comprehensive_clean(c, FIXTURE)))
query("txt11_enhanced_clean", docs_sql(q_clean, q_abbr, q_stats, q_units, q_fillers))(
    over_docs(lambda c: text.enhanced_clean(c, FIXTURE))
)

ANSWER = """CASE WHEN toxic = 1 AND quality = 1 THEN 'Not Recommended for use' WHEN toxic = 1 THEN 'use is recommended'
 WHEN quality = 1 AND doc_id % 5 = 0 THEN ' TRUE ' WHEN quality = 1 AND doc_id % 5 = 1 THEN 'y'
 WHEN quality = 1 AND doc_id % 5 = 2 THEN 'unclear' WHEN quality = 1 THEN 'Not sure' WHEN doc_id % 2 = 0 THEN 'FALSE'
 ELSE 'other' END"""
_LOW = s_strip("lower(x)")
_FORMS = " ".join(f"WHEN {_LOW} IN ({', '.join(map(lit, forms))}) THEN {lit(name)}" for name, forms in ANSWER_FORMS.items())
query(
    "txt4_normalize_answer",
    f"""SELECT doc_id, CASE WHEN contains({_LOW}, 'not recommended') THEN 'Not recommended'
 WHEN contains({_LOW}, 'recommended') THEN 'Recommended'
 {_FORMS} ELSE x END AS x
 FROM (SELECT doc_id, {ANSWER} AS x FROM labels)""",
)(
    lambda spark, d: table(spark, d, "labels").select("doc_id", text.normalize_answer(F.expr(ANSWER)).alias("x"))
)

THAI, LETTERS = "[^฀-๿]+", r"\P{L}+"
query(
    "txt12_detect_language",
    f"""SELECT doc_id, CASE WHEN l = 0 THEN 'unknown' WHEN t / l > 0.1::DOUBLE THEN 'thai' ELSE 'english' END AS x
 FROM (SELECT doc_id, length({s_sub('text', LETTERS, '')}) AS l, length({s_sub('text', THAI, '')}) AS t FROM documents)""",
)(over_docs(text.detect_language))
query(
    "txt13_text_hash",
    f"SELECT doc_id, CASE WHEN text <> '' THEN md5({s_squeeze('lower(' + s_strip('text') + ')')}) END AS x FROM documents",
)(over_docs(text.text_hash))
query(
    "txt14_strip_symbols",
    f"SELECT doc_id, {s_strip(s_sub(s_squeeze('text'), '[^฀-๿a-zA-Z0-9 .?!]', ''))} AS x FROM documents",
)(over_docs(text.strip_symbols))
SYN = {"Universal": ("tion", "keit"), "Common": ("ung", "eau")}


def q_syn(x):
    for k, vs in SYN.items():
        for v in vs:
            x = s_sub(x, f"(?i){v}", k)
    return x


query("txt15_standardize_synonyms", docs_sql(q_syn))(over_docs(lambda c: text.standardize_synonyms(c, SYN)))
query(
    "txt16_title_name",
    rf"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(p_name, '_', ' '), '\p{{L}}+|\P{{L}}+'),
 lambda s: upper(s[1]) || lower(s[2:])), '') AS x FROM part""",
)(lambda spark, d: table(spark, d, "part").select("p_partkey", text.title_name(F.col("p_name")).alias("x")))
query(
    "txt17_prompt_format",
    f"WITH {QA} SELECT ord, 'diagnose disease: ' || question AS d, 'question: ' || question AS q, 'answer: ' || answer AS a FROM qa",
)(
    lambda spark, d: qa(spark, d).select(
        "ord", text.prompt_format(F.col("question")).alias("d"), text.prompt_format(F.col("question"), "question").alias("q"),
        text.prompt_format(F.col("answer"), "answer").alias("a"),
    )
)
query(
    "txt18_ngrams",
    f"""SELECT doc_id, len(w)::INTEGER AS n_words,
 array_to_string(list_transform(range(1, greatest(1, least(len(w) - 1, 10) + 1)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS first_bigrams,
 greatest(len(w) - 2, 0)::INTEGER AS n_trigrams FROM (SELECT doc_id, {s_words('lower(text)')} AS w FROM documents)""",
)(
    lambda spark, d: texts(spark, d).select(
        "doc_id",
        F.size(text.ngrams(F.col("text"), 1)).alias("n_words"),
        F.array_join(text.ngrams(F.col("text"), 2, 10), "|").alias("first_bigrams"),
        F.size(text.ngrams(F.col("text"), 3)).alias("n_trigrams"),
    )
)
query(
    "txt19_extract_question",
    f"""SELECT doc_id, {s_strip("regexp_replace(p, '^" + WS + "*The', '')")} AS x
 FROM (SELECT doc_id, CASE WHEN contains(text, 'the') THEN string_split(text, 'the')[2] ELSE text END AS p FROM documents)""",
)(over_docs(lambda c: text.extract_question(c, "the", "The")))
ECHO = "'Human: ' || question || chr(10) || 'Assistant:' || ' ' || answer || CASE WHEN turn % 4 = 0 THEN ' Human:' ELSE '' END"
query(
    "txt20_strip_prompt_echo",
    f"""WITH {QA} SELECT ord, CASE WHEN ends_with(t, 'Human:') THEN {s_strip('left(t, length(t) - 6)')} ELSE t END AS x
 FROM (SELECT ord, {s_strip("replace(" + ECHO + ", 'Human: ' || question || chr(10) || 'Assistant:', '')")} AS t FROM qa)""",
)(
    lambda spark, d: qa(spark, d).select(
        "ord",
        text.strip_prompt_echo(F.expr(ECHO), F.expr("'Human: ' || question || chr(10) || 'Assistant:'")).alias("x"),
    )
)

# ---- classification


query("cls1_severity", f"WITH {QA} SELECT ord, {s_first('low', FIXTURE.severity, 'moderate')} AS severity_level FROM qa")(
    lambda spark, d: qa_low(spark, d).select("ord", classify.severity(F.col("low"), FIXTURE).alias("severity_level"))
)
query("cls2_specialty", f"WITH {QA} SELECT ord, {s_first('low', FIXTURE.specialty, 'general_medicine')} AS specialty FROM qa")(
    lambda spark, d: qa_low(spark, d).select("ord", classify.specialty(F.col("low"), FIXTURE).alias("specialty"))
)
MCQ = ("(a)", "(b)", "(c)", "(d)", "choose", "select")
query(
    "cls3_qa_type",
    f"SELECT doc_id, CASE WHEN {s_any('lower(text)', MCQ)} THEN 'medical_mcq' ELSE 'medical_qa' END AS type FROM documents",
)(lambda spark, d: texts(spark, d).select("doc_id", classify.qa_type(F.lower("text")).alias("type")))

CATEGORIES = {"Alpha": ("tion", "ing", "stth"), "Beta": ("keit", "ung", "schl"), "Gamma": ("eau", "que", "ment"),
              "Delta": ("ción", "ado", "los"), "Other": ("xyzzy",)}


def argmax_sql(x):
    n = {k: s_hits(x, ts) for k, ts in CATEGORIES.items()}
    best = "greatest(" + ", ".join(n.values()) + ")"
    whens = " ".join(f"WHEN {v} = {best} THEN {lit(k)}" for k, v in n.items())
    return f"CASE WHEN {best} = 0 THEN 'Other' {whens} END"


query("cls5_keyword_argmax", f"SELECT doc_id, {argmax_sql('lower(text)')} AS category FROM documents")(
    lambda spark, d: texts(spark, d)
    .select("doc_id", F.lower("text").alias("low"))
    .select("doc_id", classify.keyword_argmax(F.col("low"), CATEGORIES).alias("category"))
)
GROUPS = {"alphas": ("stth", "shou"), "betas": ("keit",), "gammas": ("eau",)}
query(
    "cls6_disease_specialty",
    f"SELECT doc_id, {s_first('lower(text)', {k.capitalize(): v for k, v in GROUPS.items()}, 'General Medicine')} AS specialty FROM documents",
)(
    lambda spark, d: texts(spark, d)
    .select("doc_id", F.lower("text").alias("low"))
    .select("doc_id", classify.disease_specialty(F.col("low"), GROUPS).alias("specialty"))
)
query(
    "cls7_confidence_level",
    """SELECT event_id, round(c, 6) AS confidence, CASE WHEN c >= 70 THEN 'HIGH' WHEN c >= 40 THEN 'MODERATE' ELSE 'LOW' END AS level,
 row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_id) AS rank
 FROM (SELECT event_id, user_id, least(100.0::DOUBLE, exp(-value / 20.0::DOUBLE) * 100.0::DOUBLE) AS c FROM events)
 QUALIFY rank <= 5""",
)(lambda spark, d: _confidence(spark, d))


def _confidence(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events").select("event_id", "user_id", classify.confidence(-F.col("value") / 20.0).alias("c"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("c"), "event_id"))
    top = e.withColumn("rank", rank).where(F.col("rank") <= 5)
    return top.select(
        "event_id", F.round("c", 6).alias("confidence"), classify.confidence_level(F.col("c")).alias("level"),
        F.col("rank").cast("bigint").alias("rank"),
    )


def rules_sql(x):
    whens = " ".join(
        f"WHEN {' OR '.join(s_all(x, p) for p in ps)} THEN {lit(k)}" for k, _, ps in FIXTURE.alert_rules
    )
    return f"(CASE {whens} END)"


LEVELS = {k: v for k, v, _ in FIXTURE.alert_rules}


def pick_sql(x, mapping):
    return f"(CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END)"


query(
    "cls8_emergency_rule",
    f"""SELECT doc_id, k AS alert_type, {pick_sql('k', LEVELS)} AS severity, {pick_sql('k', FIXTURE.alert_messages)} AS message
 FROM (SELECT doc_id, {rules_sql('lower(text)')} AS k FROM documents)""",
)(
    lambda spark, d: texts(spark, d)
    .select("doc_id", F.lower("text").alias("low"))
    .select("doc_id", classify.emergency_rule(F.col("low"), FIXTURE).alias("alert_type"))
    .select(
        "doc_id", "alert_type", classify.emergency_severity(F.col("alert_type"), FIXTURE).alias("severity"),
        classify.emergency_message(F.col("alert_type"), FIXTURE).alias("message"),
    )
)
MARKS, TYPES = ("Thth", "Der", "THE"), {"tion": "A", "ung": "B", "que": "C"}
query(
    "cls9_emergency_answer",
    f"""WITH {QA} SELECT ord, CASE WHEN {s_any('answer', MARKS)}
 THEN {s_first('answer', {v: (k,) for k, v in TYPES.items()}, 'MEDICAL EMERGENCY')} END AS alert FROM qa""",
)(lambda spark, d: qa(spark, d).select("ord", classify.emergency_answer(F.col("answer"), MARKS, TYPES).alias("alert")))
TRIAGE_SEV = {"severe": ("enth", "ß"), "moderate": ("ndwh", "eau", "ado")}
TRIAGE_CAT = {"cardiovascular": ("stth",), "respiratory": ("hein", "keit"), "flu": ("ing", "ment")}
TRIAGE_SQL = f"""t AS (SELECT ord, {s_first('lq', TRIAGE_SEV, 'mild')} AS triage_severity,
 {s_first('lq', TRIAGE_CAT, 'unknown')} AS triage_category FROM qa),
triage AS (SELECT *, CASE WHEN triage_severity = 'severe' THEN 'notify_doctor'
 WHEN triage_severity = 'moderate' AND triage_category IN ('cardiovascular', 'respiratory') THEN 'notify_doctor'
 WHEN triage_severity = 'moderate' THEN 'monitor' ELSE 'save_to_db' END AS next_action FROM t)"""
query("cls10_symptom_triage", f"WITH {QA}, {TRIAGE_SQL} SELECT * FROM triage")(
    lambda spark, d: _triage(spark, d).select("ord", "triage_severity", "triage_category", "next_action")
)


def _triage(spark, d):
    from ..operators.logs import triage

    return triage(qa(spark, d), "question", TRIAGE_SEV, TRIAGE_CAT)


ROUTE = {"diabetes": ("stth", "keit"), "hypertension": ("eau",), "emergency": ("ing",)}
query(
    "cls11_route_question",
    f"""WITH {QA} SELECT ord, c AS category, CASE WHEN c = 'emergency' THEN 'high' ELSE 'normal' END AS priority
 FROM (SELECT ord, {s_first('lq', ROUTE, 'general')} AS c FROM qa)""",
)(
    lambda spark, d: qa_low(spark, d)
    .select("ord", classify.route_question(F.col("lq"), ROUTE).alias("category"))
    .withColumn("priority", classify.route_priority(F.col("category")))
)
LABELS = ("the", "of the", "der", "die", "la", "que", "and", "that was")
LOWER = "low"
_BY_LENGTH = sorted(LABELS, key=lambda s: (-len(s), s))
query(
    "fea6_disease_label",
    f"WITH {QA} SELECT ord, CASE {' '.join(f'WHEN {s_word(LOWER, [w])} THEN {lit(w)}' for w in _BY_LENGTH)} END AS disease FROM qa",
)(lambda spark, d: qa(spark, d).select("ord", features.disease_label(low_text(), LABELS).alias("disease")))
