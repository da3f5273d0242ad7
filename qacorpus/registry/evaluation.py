"""AGG8-AGG15, AGG19-AGG22, JN5, SET3, ML1-ML5."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluation, learning
from .base import DOC_PAIRS, EVENTS, events, ntz, query, r6, table, texts
from .texts import CATEGORIES, argmax_sql

# predicted category: keyword classifier on the text; true category: language
TRUTH = {"en": "Alpha", "de": "Beta", "fr": "Gamma", "es": "Delta"}
TRUE_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRUTH.items()) + " END"
CLASSIFIED = f"cls AS (SELECT doc_id, source, {TRUE_SQL} AS t, {argmax_sql('lower(text)')} AS p FROM documents)"


def classified(spark, d):
    from ..functions.classify import keyword_argmax

    rows = texts(spark, d).select("doc_id", "source", "lang", F.lower("text").alias("low"))
    truth = F.create_map(*[F.lit(x) for kv in TRUTH.items() for x in kv])
    return rows.select("doc_id", "source", truth[F.col("lang")].alias("t"), keyword_argmax(F.col("low"), CATEGORIES).alias("p"))


LABELS_SQL = "lb AS (SELECT t AS label FROM cls UNION SELECT p FROM cls)"
METRICS = f"""{CLASSIFIED}, {LABELS_SQL}, base AS (
 SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp,
 count(*) FILTER (t <> label AND p <> label) AS tn, count(*) FILTER (t = label AND p <> label) AS fn, count(*) FILTER (t = label) AS support
 FROM lb, cls GROUP BY label),
 m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
 coalesce(tn / nullif(tn + fp, 0), 0.0) AS specificity, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM base),
 metrics AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2.0::DOUBLE * "precision" * recall / ("precision" + recall) ELSE 0.0 END AS f1_score FROM m)"""

query("set3_label_union", f"WITH {CLASSIFIED}, {LABELS_SQL} SELECT label FROM lb")(
    lambda spark, d: evaluation.label_union(classified(spark, d), "t", "p")
)
query(
    "agg8_confusion_matrix",
    f"""WITH {CLASSIFIED}, {LABELS_SQL} SELECT a.label AS true_label, b.label AS pred_label, count(cls.doc_id) AS n
 FROM lb a CROSS JOIN lb b LEFT JOIN cls ON t = a.label AND p = b.label GROUP BY ALL""",
)(lambda spark, d: evaluation.confusion_matrix(classified(spark, d), "t", "p", dense=True))
query(
    "agg8_confusion_normalized",
    f"""WITH {CLASSIFIED}, {LABELS_SQL}, n AS (SELECT a.label AS true_label, b.label AS pred_label, count(cls.doc_id) AS n
 FROM lb a CROSS JOIN lb b LEFT JOIN cls ON t = a.label AND p = b.label GROUP BY ALL)
 SELECT true_label, pred_label, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY true_label), 0), 0.0), 6) AS share FROM n""",
)(
    lambda spark, d: evaluation.confusion_matrix(classified(spark, d), "t", "p", normalize=True, dense=True).withColumn("share", r6("share"))
)
NAMES = ["Alpha", "Beta", "Gamma", "Delta", "Other"]
query(
    "agg8_confusion_pivot",
    f"WITH {CLASSIFIED} SELECT t AS true_label, " + ", ".join(f"count(*) FILTER (p = '{n}') AS \"{n}\"" for n in NAMES) + " FROM cls GROUP BY 1",
)(lambda spark, d: evaluation.confusion_pivot(classified(spark, d), "t", "p", NAMES))
RATES = ("precision", "recall", "f1_score", "specificity", "accuracy")
query(
    "agg9_class_metrics",
    f"WITH {METRICS} SELECT label, tp, fp, tn, fn, support, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in RATES) + " FROM metrics",
)(
    lambda spark, d: evaluation.class_metrics(classified(spark, d), "t", "p").select(
        "label", "tp", "fp", "tn", "fn", "support", *[r6(c).alias(c) for c in RATES]
    )
)
query(
    "agg10_macro_micro",
    f"""WITH {METRICS}, s AS (SELECT sum(support)::BIGINT AS total_predictions, sum(tp)::BIGINT AS total_tp, sum(fp)::BIGINT AS total_fp, sum(tn)::BIGINT AS total_tn,
 sum(fn)::BIGINT AS total_fn, avg("precision") AS mp, avg(recall) AS mr, avg(f1_score) AS mf FROM metrics)
 SELECT total_predictions, total_tp, total_fp, total_tn, total_fn, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1,
 round(total_tp / total_predictions, 6) AS overall_accuracy, round(total_tp / (total_tp + total_fp), 6) AS micro_precision,
 round(total_tp / (total_tp + total_fn), 6) AS micro_recall,
 round(2.0::DOUBLE * (total_tp / (total_tp + total_fp)) * (total_tp / (total_tp + total_fn)) / ((total_tp / (total_tp + total_fp)) + (total_tp / (total_tp + total_fn))), 6) AS micro_f1 FROM s""",
)(lambda spark, d: _macro(spark, d))


def _macro(spark, d):
    out = evaluation.macro_micro(classified(spark, d), "t", "p")
    names = ("macro_precision", "macro_recall", "macro_f1", "overall_accuracy", "micro_precision", "micro_recall", "micro_f1")
    return out.select("total_predictions", "total_tp", "total_fp", "total_tn", "total_fn", *[r6(c).alias(c) for c in names])


query(
    "agg11_confusion_highlights",
    f"""WITH {METRICS}, o AS (SELECT t, p, count(*) AS n FROM cls WHERE t <> p GROUP BY ALL)
 SELECT (SELECT label FROM metrics WHERE support > 0 ORDER BY recall DESC, label LIMIT 1) AS best_recall_label,
 (SELECT round(max(recall), 6) FROM metrics WHERE support > 0) AS best_recall,
 (SELECT label FROM metrics WHERE support > 0 ORDER BY recall, label DESC LIMIT 1) AS worst_recall_label,
 (SELECT round(min(recall), 6) FROM metrics WHERE support > 0) AS worst_recall,
 (SELECT label FROM metrics ORDER BY f1_score DESC, label LIMIT 1) AS best_f1_label,
 (SELECT label FROM metrics ORDER BY f1_score, label LIMIT 1) AS worst_f1_label,
 (SELECT t FROM o ORDER BY n DESC, t, p LIMIT 1) AS confused_true, (SELECT p FROM o ORDER BY n DESC, t, p LIMIT 1) AS confused_pred,
 (SELECT max(n) FROM o) AS confused_n""",
)(
    lambda spark, d: evaluation.confusion_highlights(classified(spark, d), "t", "p")
    .withColumn("best_recall", r6("best_recall"))
    .withColumn("worst_recall", r6("worst_recall"))
)
query("jn5_prediction_truth", f"WITH {DOC_PAIRS} SELECT doc_id, source, quality, quality = toxic AS same FROM dp")(
    lambda spark, d: evaluation.join_truth(
        table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id"
    ).select("doc_id", "source", "quality", (F.col("quality") == F.col("toxic")).alias("same"))
)

# evaluation rows made of events: an error event failed, value is latency (a tenth below zero), k a score
EVAL_SQL = """evr AS (SELECT event_id, event_type AS category, CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE value END AS inference_time,
 (json_extract(props, '$.k')::INTEGER) / 100.0::DOUBLE AS quality_score, CASE WHEN event_type = 'error' AND user_id % 3 > 0 THEN 'code ' || (user_id % 3)::VARCHAR END AS error,
 props AS response, user_id % 7 = 0 AS emergency_detected FROM events)"""


def eval_rows(spark, d):
    k = F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))["k"]
    code = F.col("user_id") % 3
    return events(spark, d).select(
        "event_id",
        F.col("event_type").alias("category"),
        F.when(F.col("event_id") % 10 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("inference_time"),
        (k / F.lit(100.0)).alias("quality_score"),
        F.when((F.col("event_type") == "error") & (code > 0), F.concat(F.lit("code "), code.cast("string"))).alias("error"),
        F.col("props").alias("response"),
        (F.col("user_id") % 7 == 0).alias("emergency_detected"),
    )


def summary_sql(latency, value, size):
    return f"""WITH {EVAL_SQL}, w AS (SELECT {latency} AS lat, {value} AS val, {size} AS len, error IS NULL AS ok FROM evr)
 SELECT count(*) AS total_questions, count_if(ok)::BIGINT AS successful_responses, count_if(NOT ok)::BIGINT AS failed_responses,
 round(avg(ok::INTEGER), 6) AS success_rate, round(avg(lat), 6) AS avg_inference_time, round(quantile_cont(lat, 0.5), 6) AS median_inference_time,
 min(lat) AS min_inference_time, max(lat) AS max_inference_time, round(stddev_pop(lat), 6) AS std_inference_time, round(avg(val), 6) AS avg_quality_score,
 round(quantile_cont(val, 0.5), 6) AS median_quality_score, min(val) AS min_quality_score, max(val) AS max_quality_score, round(stddev_pop(val), 6) AS quality_std,
 round(avg(len), 6) AS avg_answer_length, min(len)::INTEGER AS min_answer_length, max(len)::INTEGER AS max_answer_length FROM w"""


ROUNDED = ("success_rate", "avg_inference_time", "median_inference_time", "std_inference_time", "avg_quality_score",
           "median_quality_score", "quality_std", "avg_answer_length")


def summary(df):
    for c in ROUNDED:
        df = df.withColumn(c, r6(c))
    return df


query("agg12_eval_summary", summary_sql("CASE WHEN inference_time > 0 THEN inference_time END", "quality_score", "length(response)"))(
    lambda spark, d: summary(evaluation.eval_summary(eval_rows(spark, d)))
)
query(
    "agg12_eval_summary_successes",
    summary_sql(*[f"CASE WHEN error IS NULL THEN {x} END" for x in ("inference_time", "quality_score", "length(response)")]),
)(lambda spark, d: summary(evaluation.eval_summary(eval_rows(spark, d), successes_only=True)))
query(
    "agg13_category_rollup",
    f"""WITH {EVAL_SQL} SELECT category, count(*) AS questions_count, round(avg((error IS NULL)::INTEGER), 6) AS success_rate, round(avg(quality_score), 6) AS avg_quality_score,
 round(coalesce(avg(inference_time) FILTER (inference_time > 0), 0.0), 6) AS avg_inference_time, count_if(emergency_detected)::BIGINT AS emergency_detected FROM evr GROUP BY 1""",
)(
    lambda spark, d: evaluation.category_rollup(eval_rows(spark, d)).select(
        "category", "questions_count", r6("success_rate").alias("success_rate"), r6("avg_quality_score").alias("avg_quality_score"),
        r6("avg_inference_time").alias("avg_inference_time"), "emergency_detected",
    )
)
query(
    "agg14_error_breakdown",
    f"""WITH {EVAL_SQL} SELECT error, count(*) AS n, (SELECT count(error) FROM evr) AS total_errors, round((SELECT count(error) / count(*) FROM evr), 6) AS error_rate
 FROM evr WHERE error IS NOT NULL GROUP BY 1""",
)(lambda spark, d: evaluation.error_breakdown(eval_rows(spark, d)).withColumn("error_rate", r6("error_rate")))
query(
    "agg15_accuracy_by_group",
    f"WITH {CLASSIFIED} SELECT source, count(*) AS total, count_if(t = p)::BIGINT AS correct, round(avg((t = p)::INTEGER), 6) AS accuracy FROM cls GROUP BY 1",
)(
    lambda spark, d: evaluation.accuracy_by_group(classified(spark, d), "source", "p", "t").withColumn("accuracy", r6("accuracy"))
)
START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


def qa_log(spark, d):
    return events(spark, d).select(
        F.col("ts").alias("created_at"), F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string")).alias("question"),
        "ok", "value", (F.col("user_id") % 5 + 1).cast("double").alias("rating"),
    )


query(
    "agg19_qa_analytics",
    f"""WITH {EVENTS} SELECT count(*) AS total_questions, round(avg(ok), 6) AS avg_confidence, round(avg(value), 6) AS avg_response_time,
 round(avg(user_id % 5 + 1), 6) AS avg_rating FROM ev WHERE ts BETWEEN '{START}' AND '{END}'""",
)(
    lambda spark, d: evaluation.qa_analytics(
        qa_log(spark, d), *_window(), confidence="ok", latency="value", rating="rating"
    ).select("total_questions", *[r6(c).alias(c) for c in ("avg_confidence", "avg_response_time", "avg_rating")])
)


def _window():
    return START, END


query(
    "agg19_top_questions",
    f"""SELECT event_type || '-' || (user_id % 10)::VARCHAR AS question, count(*) AS frequency FROM events WHERE ts BETWEEN '{START}' AND '{END}'
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)(lambda spark, d: evaluation.top_questions(qa_log(spark, d), *_window()))
query(
    "agg20_usage_stats",
    f"WITH {EVENTS} SELECT count(*) AS total_questions, floor(avg(value) + 0.5)::BIGINT AS avg_response_time, floor(avg(ok) * 100 + 0.5)::BIGINT AS success_pct FROM ev",
)(lambda spark, d: evaluation.usage_stats(events(spark, d), "value", F.col("ok")))
STATE = "CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'view' THEN 'PRUNED' ELSE 'COMPLETE' END"
query(
    "agg21_trial_summary",
    f"""SELECT count(*) AS total_trials, count_if(s = 'COMPLETE')::BIGINT AS successful, count_if(s = 'FAIL')::BIGINT AS failed, min(v) AS best_score,
 max(v) AS worst_score, round(avg(v), 6) AS mean_score FROM (SELECT {STATE} AS s, CASE WHEN {STATE} = 'COMPLETE' THEN value END AS v FROM events)""",
)(
    lambda spark, d: evaluation.trial_summary(
        events(spark, d).withColumn("state", F.expr(STATE)).withColumn("value", F.expr(f"CASE WHEN {STATE} = 'COMPLETE' THEN value END"))
    ).withColumn("mean_score", r6("mean_score"))
)
MODELS = """mod AS (SELECT p_partkey AS ord, p_name AS model_key, CASE WHEN p_size % 2 = 0 THEN 'seq2seq' ELSE 'causal' END AS model_type,
 p_retailprice AS parameter_count, CASE WHEN p_partkey % 3 = 0 THEN 'failed' ELSE 'success' END AS status FROM part)"""
query(
    "agg22_leaderboard",
    f"""WITH {MODELS}, ok AS (SELECT * FROM mod WHERE status = 'success') SELECT (SELECT count(*) FROM ok) AS n_successful,
 (SELECT model_key FROM ok ORDER BY parameter_count, ord LIMIT 1) AS best_overall,
 (SELECT model_key FROM ok WHERE regexp_matches(model_key, '(?i)1|9') ORDER BY ord LIMIT 1) AS best_domain,
 (SELECT model_key FROM ok WHERE model_type = 'seq2seq' ORDER BY parameter_count, ord LIMIT 1) AS best_kind""",
)(
    lambda spark, d: evaluation.leaderboard(
        table(spark, d, "part").select(
            F.col("p_partkey").alias("ord"), F.col("p_name").alias("model_key"),
            F.when(F.col("p_size") % 2 == 0, "seq2seq").otherwise("causal").alias("model_type"),
            F.col("p_retailprice").alias("parameter_count"),
            F.when(F.col("p_partkey") % 3 == 0, "failed").otherwise("success").alias("status"),
        ),
        domain="1|9",
    )
)

# ---- learning jobs


def training_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("question"), F.col("lang").alias("label"))


def _parts(spark, d):
    from ..operators.selection import random_split

    rows = random_split(training_rows(spark, d), (0.8, 0.1, 0.1), "doc_id")
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


@query("ml1_train_text_classifier")
def _ml1(spark, d):
    train, test = _parts(spark, d)
    _, scored = learning.train_text_classifier(train, test)
    return scored.select("doc_id", "label", "predicted")


@query("ml2_compare_models")
def _ml2(spark, d):
    train, test = _parts(spark, d)
    return learning.compare_models(train, test).drop("fit_seconds")


@query("ml3_tune")
def _ml3(spark, d):
    train, _ = _parts(spark, d)
    return learning.tune(train, reg=(0.01, 0.1), elastic=(0.0,))


@query("ml4_top_k_predictions")
def _ml4(spark, d):
    train, test = _parts(spark, d)
    model, scored = learning.train_text_classifier(train, test)
    return learning.top_k_predictions(scored, model.stages[0].labels, "doc_id", 3)


HISTORY = "h AS (SELECT user_id AS run_id, date_trunc('day', ts) AS epoch, round(avg(value), 6) AS val_accuracy FROM events GROUP BY ALL)"
query(
    "ml5_early_stopping",
    f"""WITH {HISTORY}, a AS (SELECT *, row_number() OVER w AS i, val_accuracy > coalesce(max(val_accuracy) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS better
   FROM h WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
 b AS (SELECT *, i - coalesce(max(i) FILTER (better) OVER (PARTITION BY run_id ORDER BY epoch), 0) >= 3 AS stop FROM a),
 c AS (SELECT run_id, min(epoch) FILTER (stop) AS stopped_at FROM b GROUP BY 1)
 SELECT b.run_id, max(b.epoch) FILTER (better) AS best_epoch, arg_max(val_accuracy, b.epoch) FILTER (better) AS best_accuracy, any_value(c.stopped_at) AS stopped_at
 FROM b JOIN c ON b.run_id = c.run_id WHERE c.stopped_at IS NULL OR b.epoch <= c.stopped_at GROUP BY b.run_id""",
)(lambda spark, d: _ml5(spark, d))


def _ml5(spark, d):
    history = events(spark, d).groupBy(F.col("user_id").alias("run_id"), F.date_trunc("day", "ts").alias("epoch")).agg(
        F.round(F.avg("value"), 6).alias("val_accuracy")
    )
    out = learning.early_stopping(history)
    return out.select("run_id", ntz("best_epoch"), "best_accuracy", ntz("stopped_at"))
