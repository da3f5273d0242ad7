"""SRC, SET, DUP, JN and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lexicon import WEIGHT_SEVERITY
from ..operators import dedupe, matching, profiling
from ..operators.fuzzy import dedupe_fuzzy
from ..operators.selection import concat_all, most_common
from ..sources import readers
from .base import (
    FIXTURE, LABELLED, QA, labelled, lit, qa, query, r6, s_lookup, s_nwords, s_squeeze, s_strip,
    s_words, table, texts,
)
from .texts import rules_sql



def docs(spark, d):
    return texts(spark, d).withColumn("ord", F.col("doc_id"))


# ---- sources

SRC = """m AS (SELECT doc_id, text, [source, lang, n_chars::VARCHAR, 'none'] AS opts, (n_chars % 6) - 1 AS cop FROM documents)"""
query(
    "src2_normalize_sources",
    f"""WITH {QA}, {SRC}
 SELECT 'MedMCQA' AS source, doc_id AS id, text AS question, coalesce(CASE WHEN cop < 0 THEN opts[cop + 5] ELSE opts[cop + 1] END, '') AS answer,
  'medical_mcq' AS type, array_to_string(opts, '|') AS options, '' AS context FROM m
 UNION ALL SELECT 'MedQA', doc_id, text, source, 'medical_qa', NULL, NULL FROM documents
 UNION ALL SELECT 'PubMedQA', doc_id, text, lang, 'biomedical_qa', NULL, source || ' ' || lang FROM documents
 UNION ALL SELECT 'ChatDoctor', ord, question, answer, 'medical_conversation', NULL, NULL FROM qa""",
)(lambda spark, d: _sources(spark, d))


def _sources(spark, d):
    base = table(spark, d, "documents")
    pick = F.col
    mcq = readers.from_medmcqa(
        base.select(
            "doc_id", pick("text").alias("question"), pick("source").alias("opa"), pick("lang").alias("opb"),
            pick("n_chars").cast("string").alias("opc"), F.lit("none").alias("opd"), (pick("n_chars") % 6 - 1).alias("cop"),
            F.lit("").alias("subject_name"), F.lit("").alias("exp"), F.lit("train").alias("split"),
        ).withColumn("question", F.concat_ws("\u0001", F.col("doc_id").cast("string"), "question"))
    )
    medqa = readers.from_medqa(
        base.select(
            F.concat_ws("\u0001", F.col("doc_id").cast("string"), "text").alias("question"),
            F.array("source", "lang").alias("answer"), F.lit("train").alias("split"),
        )
    )
    pub = readers.from_pubmedqa(
        base.select(
            F.concat_ws("\u0001", F.col("doc_id").cast("string"), "text").alias("question"),
            pick("lang").alias("final_decision"), F.struct(F.array("source", "lang").alias("contexts")).alias("context"),
        )
    )
    chat = readers.from_chatdoctor(
        qa(spark, d).select(
            F.concat_ws("\u0001", F.col("ord").cast("string"), "question").alias("input"), pick("answer").alias("output"),
            F.lit("").alias("instruction"),
        )
    )
    rows = concat_all([mcq, medqa, pub, chat])
    parts = F.split("question", "\u0001", 2)
    return rows.select(
        "source", parts[0].cast("bigint").alias("id"), parts[1].alias("question"), "answer", "type",
        F.array_join("options", "|").alias("options"),
        F.when(F.col("source") == "MedMCQA", "").otherwise(F.col("context")).alias("context"),
    )


query(
    "src3_collect_summary",
    """WITH c AS (SELECT source, count(*) AS samples FROM documents GROUP BY 1)
 SELECT source, samples, samples >= 50 AS is_large FROM c UNION ALL SELECT 'TOTAL', sum(samples)::BIGINT, sum(samples) >= 50 FROM c""",
)(lambda spark, d: profiling.collect_summary(table(spark, d, "documents"), large=50))
query("src4_max_records", f"WITH {QA} SELECT ord, question, answer FROM qa ORDER BY ord LIMIT 100")(
    lambda spark, d: readers.max_records(qa(spark, d).select("ord", "question", "answer"), 100)
)
query("src5_qa_pairs", f"WITH {QA} SELECT ord, conv_id, turn, question, answer FROM qa")(qa)
query(
    "src_field_fallbacks",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text WHEN doc_id % 3 = 0 THEN source ELSE lang END AS question,
 CASE WHEN n_chars % 2 = 0 THEN lang ELSE source END AS answer FROM documents""",
)(
    lambda spark, d: readers.with_fallbacks(
        table(spark, d, "documents").select(
            "doc_id",
            F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("question"),
            F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("input"),
            F.col("lang").alias("prompt"),
            F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("output"),
            F.col("source").alias("target"),
        )
    ).select("doc_id", "question", "answer")
)
query(
    "set1_concatenate",
    """SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations""",
)(
    lambda spark, d: concat_all([
        table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"),
        table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
        table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text"),
    ])
)
query(
    "set2_word_intersection",
    f"WITH {QA} SELECT ord, len(list_intersect(list_distinct({s_words('lq')}), list_distinct({s_words('la')})))::INTEGER AS overlap FROM qa",
)(lambda spark, d: _overlap(spark, d))


def _overlap(spark, d):
    from ..functions.common import words

    rows = qa(spark, d)
    return rows.select(
        "ord", F.size(F.array_intersect(words(F.lower("question")), words(F.lower("answer")))).alias("overlap")
    )


# ---- duplicates

LOWKEY = f"lower({s_strip('text')})"
query(
    "dup1_dedupe_exact",
    f"SELECT doc_id, source FROM documents WHERE {LOWKEY} <> '' QUALIFY row_number() OVER (PARTITION BY {LOWKEY} ORDER BY doc_id) = 1",
)(lambda spark, d: dedupe.dedupe_exact(docs(spark, d), "text").select("doc_id", "source"))
NORMKEY = s_squeeze(LOWKEY)
query(
    "dup2_dedupe_hash",
    f"SELECT doc_id, source FROM documents WHERE {s_strip('text')} <> '' QUALIFY row_number() OVER (PARTITION BY {NORMKEY} ORDER BY doc_id) = 1",
)(lambda spark, d: dedupe.dedupe_hash(docs(spark, d), "text").select("doc_id", "source"))
query(
    "dup2_dedupe_report",
    f"""SELECT count(*) AS rows_in, count(DISTINCT {NORMKEY}) AS rows_kept, count(*) - count(DISTINCT {NORMKEY}) AS rows_removed FROM documents""",
)(lambda spark, d: dedupe.dedupe_report(docs(spark, d), dedupe.dedupe_hash(docs(spark, d), "text")))
query(
    "dup4_dedupe_incremental",
    f"""WITH seen AS (SELECT {NORMKEY} AS k FROM benchmark)
 SELECT doc_id FROM documents WHERE {s_strip('text')} <> '' AND {NORMKEY} NOT IN (SELECT k FROM seen)
 QUALIFY row_number() OVER (PARTITION BY {NORMKEY} ORDER BY doc_id) = 1""",
)(lambda spark, d: dedupe.dedupe_incremental(docs(spark, d), table(spark, d, "benchmark"), "text").select("doc_id"))
query(
    "dup5_drop_duplicates",
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)(lambda spark, d: dedupe.dedupe_raw(docs(spark, d), "text").select("doc_id"))
# the same with copies in capitals and with wider spaces, so that the three keys differ and the exclusion has something to exclude
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # other capitals differ between engines (sharp s)
VARIANTS = f"""variants AS (SELECT doc_id * 3 AS ord, text FROM documents UNION ALL SELECT doc_id * 3 + 1, translate(text, '{LOWER}', '{UPPER}') FROM documents
 UNION ALL SELECT doc_id * 3 + 2, replace(text, ' ', '  ') FROM documents)"""


def variants(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id") * 3, "text", F.translate("text", LOWER, UPPER), F.replace("text", F.lit(" "), F.lit("  "))).toDF("k", "a", "b", "c")
    return rows.select("k", F.posexplode(F.array("a", "b", "c")).alias("i", "text")).select((F.col("k") + F.col("i")).alias("ord"), "text")


for _name, _key, _drop in (
    ("dup1_dedupe_exact_variants", LOWKEY, dedupe.dedupe_exact),
    ("dup2_dedupe_hash_variants", NORMKEY, dedupe.dedupe_hash),
    ("dup5_drop_duplicates_variants", "text", dedupe.dedupe_raw),
):
    query(
        _name,
        f"WITH {VARIANTS} SELECT ord FROM variants WHERE {_key} <> '' QUALIFY row_number() OVER (PARTITION BY {_key} ORDER BY ord) = 1",
    )(lambda spark, d, _drop=_drop: _drop(variants(spark, d), "text").select("ord"))
query(
    "jn1_exclude_seen_variants",
    f"""WITH {VARIANTS} SELECT ord FROM variants WHERE {NORMKEY} NOT IN (SELECT {NORMKEY} FROM documents WHERE lang = 'en')""",
)(lambda spark, d: dedupe.exclude_seen(variants(spark, d), table(spark, d, "documents").where("lang = 'en'"), "text", "text").select("ord"))
query(
    "dup4_dedupe_incremental_variants",
    f"""WITH {VARIANTS} SELECT ord FROM variants WHERE {NORMKEY} <> '' AND {NORMKEY} NOT IN (SELECT {NORMKEY} FROM documents WHERE lang = 'en')
 QUALIFY row_number() OVER (PARTITION BY {NORMKEY} ORDER BY ord) = 1""",
)(lambda spark, d: dedupe.dedupe_incremental(variants(spark, d), table(spark, d, "documents").where("lang = 'en'"), "text").select("ord"))
# Edited copies of the benchmark items (two characters changed) must go, whatever else is in the table must stay.  The twin
# drops a text when an earlier one of like length is within a few edits; in these tables nothing lies near that limit.
LAST = 1 << 50
SIMILAR = """u AS (SELECT * FROM n WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) = 1)
 SELECT ord, {text} FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.ord < a.ord AND length(b.k) BETWEEN 0.8 * length(a.k) AND 1.25 * length(a.k)
   AND 20 * levenshtein(a.k, b.k) < length(a.k) + length(b.k))"""
BARE = "regexp_replace({key}, '[^\\p{{L}}\\p{{N}}_ ]', '', 'g')"


def edited(spark, d):
    text = F.concat(F.substring("text", 1, 10), F.lit("zq"), F.expr("substring(text, 13)"))
    return table(spark, d, "benchmark").select((F.col("item_id") + LAST).alias("ord"), text.alias("text"))


EDITED = f"SELECT item_id + {LAST} AS ord, left(text, 10) || 'zq' || substring(text, 13) AS text FROM benchmark"
query(
    "dup3_dedupe_fuzzy",
    f"""WITH {QA}, s AS (SELECT item_id AS ord, text FROM benchmark UNION ALL SELECT ord + 1000000, question FROM qa UNION ALL {EDITED}),
 n AS (SELECT ord, text AS question, {BARE.format(key=NORMKEY)} AS k FROM s), {SIMILAR.format(text='question')}""",
)(
    lambda spark, d: dedupe_fuzzy(
        table(spark, d, "benchmark").toDF("ord", "text").unionByName(qa(spark, d).select((F.col("ord") + 1_000_000).alias("ord"), F.col("question").alias("text")))
        .unionByName(edited(spark, d)).withColumnRenamed("text", "question"), "question", autojunk=False,
    ).select("ord", "question")
)
query(
    "jn2_fuzzy_self_join",
    f"""WITH s AS (SELECT item_id AS ord, text FROM benchmark UNION ALL SELECT conv_id * 16777216 + turn + 1000000, text FROM conversations UNION ALL {EDITED}),
 n AS (SELECT ord, text, {BARE.format(key=NORMKEY)} AS k FROM s), {SIMILAR.format(text='text')}""",
)(
    lambda spark, d: dedupe_fuzzy(
        table(spark, d, "benchmark").toDF("ord", "text").unionByName(
            table(spark, d, "conversations").select((F.col("conv_id") * (1 << 24) + F.col("turn") + 1_000_000).alias("ord"), "text")
        ).unionByName(edited(spark, d)),
        "text", autojunk=False,
    ).select("ord", "text")
)
query(
    "jn1_exclude_benchmark",
    f"""SELECT doc_id FROM documents WHERE {NORMKEY} NOT IN (SELECT {NORMKEY} FROM benchmark)""",
)(lambda spark, d: dedupe.exclude_seen(docs(spark, d), table(spark, d, "benchmark"), "text", "text").select("doc_id"))

# ---- rule and lookup joins

query("jn3_rule_join", f"WITH {QA} SELECT ord, {rules_sql('low')} AS alert_type FROM qa")(lambda spark, d: _rules(spark, d))


def _rules(spark, d):
    rows = [(i, kind, list(p)) for i, (kind, _, ps) in enumerate(FIXTURE.alert_rules) for p in ps]
    rules = spark.createDataFrame(rows, "rule_ord int, kind string, pattern array<string>")
    text = qa(spark, d).withColumn("both", F.concat_ws(" ", "question", "answer"))
    return matching.match_rule_table(text, rules, "both").select("ord", "alert_type")


# Five thousand rules of one or two words, the first of the vocabulary of the documents, over all turns.
RULE_COUNT = 5_000
query(
    "jn3_many_rules",
    f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{5,}}')) AS w FROM documents),
 r AS (SELECT w, row_number() OVER (ORDER BY w) AS rule_ord, lead(w) OVER (ORDER BY w) AS w2 FROM v QUALIFY rule_ord <= {RULE_COUNT}),
 t AS (SELECT conv_id, turn, lower(text) AS low FROM conversations),
 m AS (SELECT conv_id, turn, min(rule_ord) AS best FROM t JOIN r ON contains(low, w) AND (rule_ord % 2 = 0 OR w2 IS NULL OR contains(low, w2)) GROUP BY 1, 2)
 SELECT t.conv_id, t.turn, 'rule' || best AS alert_type FROM t LEFT JOIN m ON t.conv_id = m.conv_id AND t.turn = m.turn""",
)(lambda spark, d: _many_rules(spark, d))


def _many_rules(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{5,})"), 1)).alias("w")).distinct()
    first = words.orderBy("w").limit(RULE_COUNT + 1)
    by_word = W.orderBy("w")  # a rule table of bounded length
    rules = first.select("w", F.row_number().over(by_word).alias("rule_ord"), F.lead("w").over(by_word).alias("w2")).where(F.col("rule_ord") <= RULE_COUNT)
    pair = F.when(F.col("rule_ord") % 2 == 0, F.array("w")).otherwise(F.array_compact(F.array("w", "w2")))
    rules = rules.select("rule_ord", F.concat(F.lit("rule"), F.col("rule_ord").cast("string")).alias("kind"), pair.alias("pattern"))
    return matching.match_rule_table(table(spark, d, "conversations"), rules, "text").select("conv_id", "turn", "alert_type")


query(
    "jn6_weight_lookup",
    f"WITH {LABELLED} SELECT ord, severity_level, {s_lookup('severity_level', {k: v for k, v in WEIGHT_SEVERITY.items() if k != 'low'}, 0.9)} AS weight FROM labelled",
)(lambda spark, d: _weights(spark, d))


def _weights(spark, d):
    rows = [(k, v) for k, v in WEIGHT_SEVERITY.items() if k != "low"]
    weights = spark.createDataFrame(rows, "severity_level string, weight double")
    return matching.lookup_weights(labelled(spark, d), weights, "severity_level", 0.9).select("ord", "severity_level", "weight")


query(
    "fea5_label_index",
    "SELECT source AS label, count(*) AS n, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS label_id FROM documents GROUP BY source",
)(lambda spark, d: matching.label_index(table(spark, d, "documents"), "source"))
query(
    "jn7_label_index_lookup",
    """WITH l AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS label_id FROM (SELECT DISTINCT source FROM documents))
 SELECT doc_id, source, label_id FROM documents JOIN l USING (source)""",
)(
    lambda spark, d: matching.join_label_index(
        table(spark, d, "documents"), matching.label_index(table(spark, d, "documents"), "source"), "source"
    ).select("doc_id", "source", "label_id")
)
query(
    "srt3_most_common",
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)(lambda spark, d: most_common(table(spark, d, "events"), "event_type", 3))

# ---- profiling

COLS = [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int"), ("text", "string"), ("lang", "string")]
query(
    "agg1_profile_nulls",
    "WITH j AS (SELECT doc_id, quality, toxic, text, lang FROM documents LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(f"SELECT {lit(c)} AS column_name, {lit(t)} AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM j" for c, t in COLS),
)(
    lambda spark, d: profiling.profile_nulls(
        table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(*[c for c, _ in COLS])
    )
)
LENS = {
    "question_words": s_nwords("question"), "question_chars": "length(question)", "answer_words": s_nwords("answer"),
    "answer_chars": "length(answer)",
}
LENGTHS = f"{QA}, len AS (SELECT ord, {', '.join(f'({v})::INTEGER AS {k}' for k, v in LENS.items())} FROM qa)"
query(
    "agg2_length_stats",
    f"WITH {LENGTHS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
 round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q1, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS median, round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q3, max({c})::DOUBLE AS max FROM len"""
        for c in LENS
    ),
)(
    lambda spark, d: profiling.describe(profiling.with_lengths(qa(spark, d))).select(
        "measure", "n", r6("mean").alias("mean"), r6("std").alias("std"), "min", r6("q1").alias("q1"), r6("median").alias("median"),
        r6("q3").alias("q3"), "max",
    )
)
query(
    "agg3_value_counts",
    f"WITH {LABELLED} SELECT specialty AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labelled), 6) AS pct FROM labelled GROUP BY 1",
)(lambda spark, d: profiling.value_counts(labelled(spark, d), "specialty").withColumn("pct", r6("pct")))
LEVELS = ["critical", "high", "moderate", "low", "absent"]
query(
    "agg3_fixed_levels",
    f"""WITH {LABELLED}, lv AS (SELECT unnest([{', '.join(lit(x) for x in LEVELS)}]) AS value),
 c AS (SELECT severity_level, count(*) AS n FROM labelled GROUP BY 1)
 SELECT value, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM labelled), 6) AS pct
 FROM lv LEFT JOIN c ON severity_level = value""",
)(lambda spark, d: profiling.value_counts(labelled(spark, d), "severity_level", LEVELS).withColumn("pct", r6("pct")))


def histogram_sql(source, value, bins):
    return f"""WITH v AS (SELECT {value}::DOUBLE AS v FROM {source}), b AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins}.0::DOUBLE AS w FROM v),
 h AS (SELECT least(floor((v - lo) / w), {bins - 1})::INTEGER AS bin, count(*) AS n FROM v, b GROUP BY 1)
 SELECT r.bin::INTEGER AS bin, round(lo + r.bin * w, 6) AS "left", round(lo + (r.bin + 1) * w, 6) AS "right", coalesce(n, 0)::BIGINT AS n
 FROM range({bins}) r(bin) CROSS JOIN b LEFT JOIN h ON h.bin = r.bin"""


def rounded_hist(df):
    return df.withColumn("left", r6("left")).withColumn("right", r6("right"))


query("agg4_histogram", histogram_sql("documents", "n_chars", 50))(
    lambda spark, d: rounded_hist(profiling.histogram(table(spark, d, "documents"), "n_chars", 50))
)
query("agg4_histogram_latency", histogram_sql("events", "value", 20))(
    lambda spark, d: rounded_hist(profiling.histogram(table(spark, d, "events"), "value", 20))
)
query(
    "agg5_boxplot_stats",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events),
 w AS (SELECT value, q1, median, q3, value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM events, q)
 SELECT round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3, min(value) FILTER (ok) AS whisker_low,
 max(value) FILTER (ok) AS whisker_high, count(*) FILTER (NOT ok) AS n_outliers FROM w""",
)(
    lambda spark, d: profiling.boxplot_stats(table(spark, d, "events"), "value").select(
        r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"), "whisker_low", "whisker_high", "n_outliers"
    )
)
query(
    "agg6_correlation",
    f"WITH {LENGTHS} " + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM len" for x in LENS for y in LENS
    ),
)(lambda spark, d: profiling.correlation(profiling.with_lengths(qa(spark, d))).withColumn("r", r6("r")))
query(
    "agg18_raw_sample_profile",
    f"""WITH {QA}, s AS (SELECT * FROM qa ORDER BY ord LIMIT 1000)
 SELECT count(*) AS n_rows, round(avg(length(question)), 6) AS avg_question_length, round(avg(length(answer)), 6) AS avg_answer_length,
 count_if(regexp_matches(question, '\\p{{L}}'))::BIGINT AS n_english, 0::BIGINT AS n_thai, count_if(NOT regexp_matches(question, '\\p{{L}}'))::BIGINT AS n_unknown FROM s""",
)(
    lambda spark, d: profiling.raw_sample_profile(qa(spark, d)).select(
        "n_rows", r6("avg_question_length").alias("avg_question_length"), r6("avg_answer_length").alias("avg_answer_length"),
        "n_english", "n_thai", "n_unknown",
    )
)
