"""Confusion matrix, metrics and rollups against known results."""

import pytest
from pyspark.sql import functions as F

from qacorpus.operators import evaluation as ev
from qacorpus.operators import learning, matching, profiling

# Labels and matrix of a stored evaluation.
LABELS = ["Cardiovascular", "Emergency", "Endocrine", "Gastrointestinal", "Infection", "Mental_Health", "Musculoskeletal",
          "Neurological", "Other", "Preventive", "Respiratory"]
MATRIX = """
4 0 0 0 0 0 0 0 0 0 1
1 0 0 0 3 0 0 0 0 0 1
0 0 4 0 0 0 0 0 1 0 0
0 0 0 0 1 0 0 1 3 0 0
0 0 0 0 5 0 0 0 0 0 0
0 0 0 0 0 5 0 0 0 0 0
0 0 1 0 0 0 4 0 0 0 0
2 0 0 0 0 0 0 3 0 0 0
0 0 0 0 0 0 0 0 0 0 0
0 0 2 0 1 0 0 0 2 0 0
1 0 0 0 0 0 0 0 0 0 4
"""
CELLS = [[int(x) for x in line.split()] for line in MATRIX.strip().splitlines()]


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [(LABELS[i], LABELS[j], 0.05 * (i + 1)) for i in range(11) for j in range(11) for _ in range(CELLS[i][j])]
    return spark.createDataFrame(rows, "expected_category string, predicted_category string, inference_time double").repartition(3)


def test_confusion_matrix(predictions):
    got = {(r["true_label"], r["pred_label"]): r["n"] for r in ev.confusion_matrix(predictions, dense=True).collect()}
    assert got == {(LABELS[i], LABELS[j]): CELLS[i][j] for i in range(11) for j in range(11)}
    share = {(r["true_label"], r["pred_label"]): r["share"] for r in ev.confusion_matrix(predictions, normalize=True, dense=True).collect()}
    assert share[("Emergency", "Infection")] == pytest.approx(0.6)
    assert all(share[("Other", p)] == 0.0 for p in LABELS)  # empty row
    wide = ev.confusion_pivot(predictions, "expected_category", "predicted_category", LABELS)
    assert wide.where("true_label = 'Preventive'").first()["Endocrine"] == 2


def test_macro_micro(predictions):
    m = ev.macro_micro(predictions, latency="inference_time").first()
    assert m["overall_accuracy"] == pytest.approx(0.58)
    assert m["macro_precision"] == pytest.approx(0.45346320346320346)
    assert m["macro_recall"] == pytest.approx(0.5272727272727272)
    assert m["macro_f1"] == pytest.approx(0.4755951119587483)
    assert m["micro_f1"] == pytest.approx(0.58)
    assert (m["total_tp"], m["total_fp"], m["total_tn"], m["total_fn"]) == (29, 21, 479, 21)


def test_class_metrics_and_highlights(predictions):
    m = {r["label"]: r for r in ev.class_metrics(predictions).collect()}
    assert (m["Other"]["support"], m["Other"]["recall"], m["Other"]["fp"]) == (0, 0.0, 6)
    assert m["Infection"]["precision"] == pytest.approx(0.5) and m["Infection"]["recall"] == 1.0
    h = ev.confusion_highlights(predictions).first()
    # three pairs tie at most: the first in order wins
    assert (h["confused_true"], h["confused_pred"], h["confused_n"]) == ("Emergency", "Infection", 3)
    assert (h["best_recall_label"], h["worst_recall_label"]) == ("Infection", "Preventive")


def test_summary_and_rollup(spark):
    rows = [("A", 1.0, 0.5, None, "xx", True), ("A", 0.0, 0.0, "boom", "Error", False), ("B", 3.0, 1.0, None, "yyyy", False)]
    df = spark.createDataFrame(
        rows, "category string, inference_time double, quality_score double, error string, response string, emergency_detected boolean"
    )
    s = ev.eval_summary(df).first()
    assert (s["total_questions"], s["successful_responses"], s["median_inference_time"], s["avg_inference_time"]) == (3, 2, 2.0, 2.0)
    assert s["quality_std"] == pytest.approx(0.408248, abs=1e-6)
    only = ev.eval_summary(df, successes_only=True).first()
    assert (only["avg_quality_score"], only["max_answer_length"]) == (0.75, 4)
    roll = {r["category"]: r for r in ev.category_rollup(df).collect()}
    assert (roll["A"]["success_rate"], roll["A"]["avg_inference_time"], roll["A"]["emergency_detected"]) == (0.5, 1.0, 1)
    e = ev.error_breakdown(df).first()
    assert (e["error"], e["n"], e["error_rate"]) == ("boom", 1, pytest.approx(1 / 3))
    empty = ev.usage_stats(df.where("false"), "inference_time", F.col("error").isNull()).first()
    assert (empty["total_questions"], empty["avg_response_time"], empty["success_pct"]) == (0, 0, 100)


def test_leaderboard_and_trials(spark):
    rows = [(0, "big", "causal", 9.0, "success"), (1, "biomodel", "causal", 5.0, "success"), (2, "t5", "seq2seq", 3.0, "success"),
            (3, "tiny", "seq2seq", 1.0, "failed")]
    b = ev.leaderboard(spark.createDataFrame(rows, "ord int, model_key string, model_type string, parameter_count double, status string")).first()
    assert b.asDict() == {"n_successful": 3, "best_overall": "t5", "best_domain": "biomodel", "best_kind": "t5"}


def test_early_stopping(spark):
    # the committed run improves until epoch 4; the second stops after three epochs without improvement
    acc = {"a": [0.353, 0.387, 0.398, 0.405, 0.385], "b": [0.5, 0.4, 0.45, 0.5, 0.9]}
    rows = [(r, i + 1, v) for r, vs in acc.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, val_accuracy double")
    got = {r["run_id"]: (r["best_epoch"], r["best_accuracy"], r["stopped_at"]) for r in learning.early_stopping(df).collect()}
    assert got == {"a": (4, 0.405, None), "b": (1, 0.5, 4)}


def test_tables_of_rules_and_weights(spark):
    rules = spark.createDataFrame([(0, "x", ["a", "b"]), (0, "x", ["z"]), (1, "y", ["a"])], "rule_ord int, kind string, pattern array<string>")
    texts = spark.createDataFrame([(0, "A then B"), (1, "only a"), (2, "z"), (3, "q")], "ord int, question string")
    got = [r["alert_type"] for r in matching.match_rule_table(texts, rules).orderBy("ord").collect()]
    assert got == ["x", "y", "x", None]
    w = spark.createDataFrame([("k", 2.0)], "key string, weight double")
    df = spark.createDataFrame([("k",), ("u",), (None,)], "key string")
    assert sorted(r["weight"] for r in matching.lookup_weights(df, w, "key", 0.7).collect()) == [0.7, 0.7, 2.0]


def test_profiling(spark):
    df = spark.createDataFrame([(0, "a b", None), (1, "c", "d e f"), (2, "g", "")], "ord int, question string, answer string")
    nulls = {r["column_name"]: r["n_nulls"] for r in profiling.profile_nulls(df).collect()}
    assert nulls == {"ord": 0, "question": 0, "answer": 1}
    stats = {r["measure"]: r for r in profiling.describe(profiling.with_lengths(df)).collect()}
    assert (stats["answer_words"]["max"], stats["answer_words"]["median"]) == (3.0, 0.0)
    flat = spark.createDataFrame([(5.0,)] * 4, "v double")
    bins = profiling.histogram(flat, "v", 4).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [4, 0, 0, 0]
    total = {r["source"]: r["samples"] for r in profiling.collect_summary(spark.createDataFrame([("a",), ("a",), ("b",)], "source string")).collect()}
    assert total == {"a": 2, "b": 1, "TOTAL": 3}


def test_classifier_learns(spark):
    rows = [(i, f"fever cough virus {i}", "flu") for i in range(30)] + [(i + 30, f"sugar insulin thirst {i}", "diabetes") for i in range(30)]
    df = spark.createDataFrame(rows, "ord int, question string, label string")
    model, scored = learning.train_text_classifier(df, df)
    assert scored.where("predicted <> label").count() == 0
    top = learning.top_k_predictions(scored, model.stages[0].labels, "ord", 2).where("ord = 0").orderBy("rank").collect()
    assert top[0]["label"] == "flu" and top[0]["level"] == "HIGH" and len(top) == 2
    trials = ev.trial_summary(learning.tune(df, reg=(0.01, 0.1), elastic=(0.0,))).first()
    assert trials["successful"] == 2 and trials["best_score"] <= trials["worst_score"]
    assert ev.leaderboard(learning.compare_models(df, df)).first()["n_successful"] == 2


def test_texts_are_prepared_once_for_all_models_and_trials(spark, monkeypatch):
    fits, fit = [], learning.IDF._fit
    monkeypatch.setattr(learning.IDF, "_fit", lambda self, data: (fits.append(1), fit(self, data))[1])
    rows = [(f"{'alpha beta' if i % 2 else 'gamma delta'} word{i % 5}", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "question string, label string")
    assert learning.tune(df, reg=(0.01, 0.1), elastic=(0.0,)).count() == 2
    assert len(fits) == 1
    compared = learning.compare_models(df, df)
    assert [r["status"] for r in compared.collect()] == ["success"] * 2
    assert len(fits) == 2
