"""Prediction evaluation (AGG8-AGG15, AGG19-AGG22, JN5, SET3).

Everything starts from the table of (true, predicted) counts: at most labels x labels rows after one
map-side combined aggregation, however large or skewed the prediction table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import moment
from ..functions.score import exact_match
from .ordering import quantile_columns


def join_truth(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """JN5: predictions with their truth by row id."""
    return predictions.join(truth, key)


def pair_counts(df: DataFrame, true: str = "expected_category", pred: str = "predicted_category") -> DataFrame:
    return df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_union(df: DataFrame, true: str, pred: str) -> DataFrame:
    """SET3: sorted distinct labels of both columns."""
    counts = pair_counts(df, true, pred)
    both = counts.select(F.explode(F.array("true_label", "pred_label")).alias("label"))
    return both.distinct().orderBy("label")


def confusion_matrix(df: DataFrame, true: str = "expected_category", pred: str = "predicted_category",
                     normalize: bool = False, dense: bool = False) -> DataFrame:
    """AGG8: long form over the sorted label union; ``normalize`` divides by row sums (0 if empty).

    Pairs that occur; with ``dense=True`` all labels x labels rows, zeros included.  Null is a label like any other.
    """
    counts = pair_counts(df, true, pred)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  (map keys can't be null)
    if dense:
        labels = label_union(df, true, pred)
        all_labels = labels.agg(F.array_sort(F.collect_list(F.struct("label")))).scalar()
        per_true = counts.groupBy("true_label").agg(
            F.map_from_entries(F.collect_list(F.struct(key("pred_label"), "n"))).alias("m"), F.sum("n").alias("total")
        )
        rows = labels.join(per_true, labels["label"].eqNullSafe(per_true["true_label"]), "left").select(
            F.col("label").alias("true_label"), "m", F.coalesce("total", F.lit(0)).alias("total"),
            F.explode(all_labels).alias("_l"),
        ).select("true_label", "m", "total", F.col("_l.label").alias("pred_label"))
        n = F.coalesce(F.try_element_at("m", key("pred_label")), F.lit(0)).cast("bigint")
        out = rows.select("true_label", "pred_label", n.alias("n"), "total")
    else:
        totals = counts.groupBy(F.col("true_label").alias("_t")).agg(F.sum("n").alias("total"))
        out = counts.join(totals, F.col("true_label").eqNullSafe(F.col("_t"))).select("true_label", "pred_label", "n", "total")
    if normalize:
        share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("total")), F.lit(0.0))
        return out.select("true_label", "pred_label", share.alias("share"))
    return out.drop("total")


def confusion_pivot(df: DataFrame, true: str, pred: str, labels: list[str]) -> DataFrame:
    """AGG8 wide: one row per true label, one column per given label."""
    return (
        pair_counts(df, true, pred).groupBy("true_label").pivot("pred_label", labels).agg(F.sum("n")).fillna(0, labels)
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_metrics(df: DataFrame, true: str = "expected_category", pred: str = "predicted_category") -> DataFrame:
    """AGG9: one-vs-rest counts and rates per label; every count row feeds at most two labels."""
    counts = pair_counts(df, true, pred)
    total = counts.agg(F.sum("n")).scalar()
    same = F.col("true_label").eqNullSafe(F.col("pred_label"))  # null is a label like any other
    zero = F.lit(0).cast("bigint")
    parts = F.array(
        F.struct(F.col("true_label").alias("label"), F.when(same, F.col("n")).otherwise(zero).alias("tp"),
                 F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("pred_label").alias("label"), zero.alias("tp"), zero.alias("support"),
                 F.col("n").alias("predicted")),
    )
    sums = counts.select(F.inline(parts)).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    base = sums.select(
        "label", "tp", (predicted - tp).alias("fp"), (total - support - predicted + tp).alias("tn"),
        (support - tp).alias("fn"), "support",
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = base.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return (
        out.withColumn("f1_score", F.coalesce(F.try_divide(F.lit(2.0) * (p * r), p + r), F.lit(0.0)))
        .withColumn("specificity", _ratio(tn, tn + fp))
        .withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))
    )


def macro_micro(df: DataFrame, true: str = "expected_category", pred: str = "predicted_category",
                latency: str | None = None) -> DataFrame:
    """AGG10: unweighted means, pooled rates, totals, overall accuracy, mean positive latency."""
    pooled = class_metrics(df, true, pred).agg(
        F.sum("support").alias("total_predictions"),
        F.sum("tp").alias("total_tp"),
        F.sum("fp").alias("total_fp"),
        F.sum("tn").alias("total_tn"),
        F.sum("fn").alias("total_fn"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1_score").alias("macro_f1"),
    )
    tp = F.col("total_tp")
    out = (
        pooled.withColumn("overall_accuracy", _ratio(tp, F.col("total_predictions")))
        .withColumn("micro_precision", _ratio(tp, tp + F.col("total_fp")))
        .withColumn("micro_recall", _ratio(tp, tp + F.col("total_fn")))
    )
    p, r = F.col("micro_precision"), F.col("micro_recall")
    out = out.withColumn("micro_f1", F.coalesce(F.try_divide(F.lit(2.0) * (p * r), p + r), F.lit(0.0)))
    if latency is not None:
        mean = df.where(F.col(latency) > 0).agg(F.avg(latency)).scalar()
        out = out.withColumn("avg_inference_time", mean)
    return out


def confusion_highlights(df: DataFrame, true: str = "expected_category", pred: str = "predicted_category") -> DataFrame:
    """AGG11: best and worst recall among labels that occur, best and worst F1, commonest confusion.

    Ties: recall is a stable descending sort (first label best, last label worst), F1 and the confusion
    take the first label in order.
    """
    metrics = class_metrics(df, true, pred)
    seen = F.when(F.col("support") > 0, F.col("recall"))
    one = metrics.agg(
        F.min(F.when(seen.isNotNull(), F.struct((-seen).alias("k"), "label"))).alias("best"),
        F.max(F.when(seen.isNotNull(), F.struct((-seen).alias("k"), "label"))).alias("worst"),
        F.min(F.struct((-F.col("f1_score")).alias("k"), "label")).alias("best_f1"),
        F.min(F.struct(F.col("f1_score").alias("k"), "label")).alias("worst_f1"),
    )
    off = pair_counts(df, true, pred).where(~F.col("true_label").eqNullSafe(F.col("pred_label")))
    worst_pair = off.agg(F.min(F.struct((-F.col("n")).alias("k"), "true_label", "pred_label"))).scalar()
    return one.select(
        F.col("best.label").alias("best_recall_label"),
        (-F.col("best.k")).alias("best_recall"),
        F.col("worst.label").alias("worst_recall_label"),
        (-F.col("worst.k")).alias("worst_recall"),
        F.col("best_f1.label").alias("best_f1_label"),
        F.col("worst_f1.label").alias("worst_f1_label"),
        worst_pair["true_label"].alias("confused_true"),
        worst_pair["pred_label"].alias("confused_pred"),
        (-worst_pair["k"]).alias("confused_n"),
    )


def eval_summary(df: DataFrame, latency: str = "inference_time", score: str = "quality_score",
                 error: str = "error", response: str = "response", successes_only: bool = False) -> DataFrame:
    """AGG12: totals, success rate, latency, score and length statistics.

    By default all rows count and latency statistics use positive values; with ``successes_only`` every
    statistic uses rows without an error.
    """
    ok = F.col(error).isNull()
    row_ok = ok if successes_only else F.lit(True)
    lat = F.when(row_ok if successes_only else F.col(latency) > 0, F.col(latency))
    val = F.when(row_ok, F.col(score))
    size = F.when(row_ok, F.length(response))
    work = df.select(lat.alias("_lat"), val.alias("_val"), size.alias("_len"), ok.alias("_ok"))
    both = quantile_columns(work, {c: F.col(c) for c in ("_lat", "_val")}, [0.5])
    found = both.agg(F.struct(*[F.max(F.when(F.col("measure") == c, F.col("q0"))).alias(c) for c in ("_lat", "_val")])).scalar()
    medians = [found["_lat"], found["_val"]]
    return work.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if("_ok").alias("successful_responses"),
        F.count_if(~F.col("_ok")).alias("failed_responses"),
        F.avg(F.col("_ok").cast("double")).alias("success_rate"),
        F.coalesce(F.avg("_lat"), F.lit(0.0)).alias("avg_inference_time"),
        F.coalesce(F.max(medians[0]), F.lit(0.0)).alias("median_inference_time"),
        F.coalesce(F.min("_lat"), F.lit(0.0)).alias("min_inference_time"),
        F.coalesce(F.max("_lat"), F.lit(0.0)).alias("max_inference_time"),
        F.coalesce(F.stddev_pop("_lat"), F.lit(0.0)).alias("std_inference_time"),
        F.avg("_val").alias("avg_quality_score"),
        F.max(medians[1]).alias("median_quality_score"),
        F.min("_val").alias("min_quality_score"),
        F.max("_val").alias("max_quality_score"),
        F.stddev_pop("_val").alias("quality_std"),
        F.avg("_len").alias("avg_answer_length"),
        F.min("_len").alias("min_answer_length"),
        F.max("_len").alias("max_answer_length"),
    )


def category_rollup(df: DataFrame, category: str = "category", latency: str = "inference_time",
                    score: str = "quality_score", error: str = "error", emergency: str = "emergency_detected") -> DataFrame:
    """AGG13"""
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("questions_count"),
        F.avg(F.col(error).isNull().cast("double")).alias("success_rate"),
        F.avg(score).alias("avg_quality_score"),
        F.coalesce(F.avg(F.when(F.col(latency) > 0, F.col(latency))), F.lit(0.0)).alias("avg_inference_time"),
        F.count_if(emergency).alias("emergency_detected"),
    )


def error_breakdown(df: DataFrame, error: str = "error") -> DataFrame:
    """AGG14: errors by message with the overall error count and rate."""
    totals = df.agg(F.struct(F.count(error).alias("e"), F.count(F.lit(1)).alias("n"))).scalar()
    by = df.where(F.col(error).isNotNull()).groupBy(error).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("total_errors", totals["e"]).withColumn(
        "error_rate", totals["e"] / F.greatest(totals["n"], F.lit(1))
    )


def accuracy_by_group(df: DataFrame, group: str, pred: str, true: str) -> DataFrame:
    """AGG15: exact-match accuracy per group, largest first."""
    correct = exact_match(F.col(pred), F.col(true))
    return (
        df.groupBy(F.coalesce(F.col(group), F.lit("unknown")).alias(group))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("correct"), F.avg(correct.cast("double")).alias("accuracy"))
        .orderBy(F.desc("total"), group)
    )


def qa_analytics(df: DataFrame, start, end, ts: str = "created_at", confidence: str = "confidence",
                 latency: str = "response_time_ms", rating: str = "feedback_rating") -> DataFrame:
    """AGG19: totals of a closed time window."""
    inside = df.where(F.col(ts).between(moment(df, ts, start), moment(df, ts, end)))
    return inside.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.avg(confidence).alias("avg_confidence"),
        F.avg(latency).alias("avg_response_time"),
        F.avg(rating).alias("avg_rating"),
    )


def top_questions(df: DataFrame, start, end, ts: str = "created_at", question: str = "question", k: int = 10) -> DataFrame:
    """AGG19: most frequent questions of the window."""
    inside = df.where(F.col(ts).between(moment(df, ts, start), moment(df, ts, end)))
    return inside.groupBy(question).agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), question).limit(k)


def usage_stats(df: DataFrame, latency: str, success: Column) -> DataFrame:
    """AGG20: rounded mean latency (0 when empty) and success per cent (100 when empty)."""
    n = F.count(F.lit(1))
    # halves round up
    return df.agg(
        n.alias("total_questions"),
        F.when(n > 0, F.floor(F.avg(latency) + F.lit(0.5))).otherwise(0).cast("bigint").alias("avg_response_time"),
        F.when(n > 0, F.floor(F.avg(success.cast("double")) * 100 + F.lit(0.5))).otherwise(100).cast("bigint").alias("success_pct"),
    )


def trial_summary(df: DataFrame, state: str = "state", value: str = "value") -> DataFrame:
    """AGG21"""
    return df.agg(
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if(F.col(state) == "COMPLETE").alias("successful"),
        F.count_if(F.col(state) == "FAIL").alias("failed"),
        F.min(value).alias("best_score"),
        F.max(value).alias("worst_score"),
        F.avg(value).alias("mean_score"),
    )


def leaderboard(df: DataFrame, key: str = "model_key", kind: str = "model_type", size: str = "parameter_count",
                status: str = "status", order: str = "ord", domain: str = "bio|med", wanted_kind: str = "seq2seq") -> DataFrame:
    """AGG22: smallest successful model, first domain model, smallest model of the wanted kind."""
    ok = df.where(F.col(status) == "success")
    return ok.agg(
        F.count(F.lit(1)).alias("n_successful"),
        F.min_by(key, F.struct(size, order)).alias("best_overall"),
        F.min_by(F.col(key), F.when(F.col(key).rlike(f"(?i){domain}"), F.col(order))).alias("best_domain"),
        F.min_by(F.col(key), F.when(F.col(kind) == wanted_kind, F.struct(size, order))).alias("best_kind"),
    )
