"""Registration, table access and SQL fragments shared by the query modules.

The driver's text is invented prose with next to no medical words, so the queries use ``FIXTURE``, a
profile of letter groups that do occur in it.  The default medical profile is covered by the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.common import NON_WS, WS, WS_CHARS
from ..lexicon import Profile
from ..session import spread
from ..sources.readers import qa_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FIXTURE = Profile(
    name="fixture",
    abbreviations={"The": "Definite Article", "Of": "Genitive Marker", "Der": "Maskuliner Artikel",
                   "El": "Articulo", "La": "Feminine Article", "Que": "Conjunction"},
    terms={
        "conditions": ("tion", "keit", "ment", "ción"),
        "symptoms": ("ing", "eau", "ung", "ado", "ble"),
        "treatments": ("hein", "edon", "que"),
        "body_parts": ("ble", "stth", "pf"),
        "medical_professionals": ("ous", "ique"),
    },
    severity={"critical": ("enth", "blesh", "ß"), "high": ("ndwh", "ingth", "eaux"), "moderate": ("edon", "ñ"),
              "low": ("hein", "ous")},
    specialty={"alpha": ("stth", "shou"), "beta": ("keit", "schl"), "gamma": ("eau", "é"), "delta": ("ción", "ado"),
               "epsilon": ("edon", "ered"), "zeta": ("hein",)},
    offensive=(("los", "thth"), ("erth", "zu")),
    relevance_simple=(("thin", "ing"), ("von", "zu")),
    relevance_weighted=(("the", "of", "and"), ("der", "die"), ("la", "de")),
    relevance_detailed=(("that", "was"), ("and", "of"), ("der", "und"), ("que", "la"), ("is",)),
    phrases={"of the": "concerning the", "to": "towards", "in the": "inside the", "der": "dieser"},
    fillers=(("that was", "and the"), ("for",)),
    question_markers=("the", "der", "que", "é"),
    question_indicators=("the", "der", "que", "é", "ing", "es"),
    score_markers=("wh", "en"),
    score_terms=("tion", "ung", "eau"),
    informative=("ered", "ver", "edon"),
    informative_detailed=("ous", "ver"),
    weight_specialty={"alpha": 1.2, "beta": 1.1, "gamma": 1.0, "delta": 0.9, "epsilon": 0.8, "general_medicine": 0.7},
    text_terms=("tion", "ing", "the", "ung", "que"),
    text_abbreviations=("The", "Of", "Der"),
    feature_terms=("tion", "ing", "ung", "eau", "ado"),
    urgent_words=("enth", "ver", "ique"),
    emergency_keywords=("blesh", "ndwh", "eaux", "ß"),
    alert_rules=(
        ("alpha_alert", "critical", (("tion", "ndwh"), ("stth",))),
        ("beta_alert", "high", (("keit", "und"), ("schl",))),
        ("gamma_alert", "critical", (("eau", "que"),)),
    ),
    alert_messages={"alpha_alert": "EMERGENCY - ALPHA", "beta_alert": "EMERGENCY - BETA", "gamma_alert": "EMERGENCY - GAMMA"},
)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same computation for the oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A table whose long texts are worked on."""
    return spread(table(spark, d, name), key)


def events(spark: SparkSession, d: str) -> DataFrame:
    """Prediction-log stand-in: an ``error`` event is a failure, ``value`` the latency."""
    return table(spark, d, "events").withColumn("ok", (F.col("event_type") != "error").cast("double"))


def ntz(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


def qa(spark: SparkSession, d: str) -> DataFrame:
    return qa_pairs(spread(table(spark, d, "conversations"), "conv_id", "turn"))


def low_text():
    return F.lower(F.concat_ws(" ", "question", "answer"))


def qa_low(spark: SparkSession, d: str) -> DataFrame:
    return (
        qa(spark, d).withColumn("lq", F.lower("question")).withColumn("la", F.lower("answer")).withColumn("low", low_text())
    )


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with specialty, severity_level, type and source."""
    rows = qa(spark, d).withColumn("_low", low_text())
    return (
        rows.withColumn("specialty", classify.specialty(F.col("_low"), FIXTURE))
        .withColumn("severity_level", classify.severity(F.col("_low"), FIXTURE))
        .withColumn("type", classify.qa_type(F.lower("question")))
        .withColumn("source", F.concat(F.lit("src"), F.pmod("conv_id", F.lit(3)).cast("string")))
        .drop("_low")
    )


def doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels read as predictions."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id")


# ------------------------------------------------------------------------------- SQL text


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


W_ = r"[\p{L}\p{N}_]"
NW_ = r"[^\p{L}\p{N}_]"


def s_strip(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def s_sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, 'g')"


def s_squeeze(x: str) -> str:
    return s_sub(x, WS + "+", " ")


def s_words(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(NON_WS + '+')})"


def s_nwords(x: str) -> str:
    return f"len({s_words(x)})::INTEGER"


def s_distinct(x: str) -> str:
    return f"len(list_distinct({s_words(x)}))"


def s_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def s_all(x: str, terms) -> str:
    return "(" + " AND ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def s_hits(x: str, terms, weight: int = 1) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({x}, {lit(t)}) THEN {weight} ELSE 0 END)" for t in terms) + ")::INTEGER"


def s_occ(x: str, terms) -> str:
    return "(" + " + ".join(f"((length({x}) - length(replace({x}, {lit(t)}, ''))) // {len(t)})" for t in terms) + ")::INTEGER"


def s_word(x: str, alternatives) -> str:
    return f"regexp_matches({x}, {lit('(^|' + NW_ + ')(?:' + '|'.join(alternatives) + ')($|' + NW_ + ')')})"


def s_anyword(x: str, patterns) -> str:
    return "(" + " OR ".join(s_word(x, p) for p in patterns) + ")"


def s_wordcount(x: str, alternatives) -> str:
    """Whole-word matches of single-word alternatives."""
    listed = ", ".join(lit(a) for a in alternatives)
    return f"len(list_filter(regexp_extract_all({x}, {lit(W_ + '+')}), lambda t: t IN ({listed})))"


def s_phrase(x: str, phrase: str, replacement: str) -> str:
    """Case-insensitive whole-word replacement without lookaround: two passes for shared boundaries."""
    pattern = f"(?i)(^|{NW_})(?:{phrase})($|{NW_})"
    return s_sub(s_sub(x, pattern, rf"\1{replacement}\2"), pattern, rf"\1{replacement}\2")


def s_first(x: str, mapping: dict, default: str | None) -> str:
    whens = " ".join(f"WHEN {s_any(x, ts)} THEN {lit(k)}" for k, ts in mapping.items())
    return f"(CASE {whens} ELSE {'NULL' if default is None else lit(default)} END)"


def s_lookup(x: str, mapping: dict, default: float) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {float(v)!r}::DOUBLE" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {float(default)!r}::DOUBLE END)"


def s_sum(*parts: tuple[str, float]) -> str:
    return "(" + " + ".join(f"(CASE WHEN {c} THEN {w!r}::DOUBLE ELSE 0.0::DOUBLE END)" for c, w in parts) + ")"


def s_steps(source: str, key: str, column: str, steps) -> str:
    """Nested selects: every step rewrites ``x``."""
    sql = f"SELECT {key}, {column} AS x FROM {source}"
    for step in steps:
        sql = f"SELECT {key}, {step('x')} AS x FROM ({sql})"
    return sql


QA = """qa AS (
  SELECT conv_id * 16777216 + turn AS ord, conv_id, turn, question, answer,
         lower(question) AS lq, lower(answer) AS la, lower(question || ' ' || answer) AS low
  FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

LABELLED = f"""{QA}, labelled AS (
  SELECT *, {s_first('low', FIXTURE.specialty, 'general_medicine')} AS specialty,
         {s_first('low', FIXTURE.severity, 'moderate')} AS severity_level,
         CASE WHEN {s_any('lq', ('(a)', '(b)', '(c)', '(d)', 'choose', 'select'))} THEN 'medical_mcq' ELSE 'medical_qa' END AS type,
         'src' || (conv_id % 3)::VARCHAR AS source
  FROM qa)"""

EVENTS = "ev AS (SELECT *, (event_type <> 'error')::INTEGER::DOUBLE AS ok FROM events)"
DOC_PAIRS = """dp AS (
  SELECT doc_id, source, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"""


def s_avg6(x: str) -> str:
    return f"round({x}, 6)"


def r6(c):
    return F.round(c, 6)
