"""Shape of physical plans: what must hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from qacorpus.operators import dedupe, evaluation, logs, monitoring, retrieval, selection
from qacorpus.plans import curate
from qacorpus.registry.base import FIXTURE, events, qa, table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def before_exchange(text, operator):
    """The operator also runs below the first exchange, on the map side."""
    return operator in text and text.index("Exchange hashpartitioning") < text.rindex(operator)


def test_hot_keys_are_cut_before_the_shuffle(spark):
    docs = table(spark, SF, "documents").withColumn("ord", F.col("doc_id"))
    for df in (dedupe.dedupe_hash(docs, "text"), retrieval.recent_history(events(spark, SF))):
        text = plan(df)
        assert "Final" in text and "Partial" in text and before_exchange(text, "WindowGroupLimit")


def test_counts_are_combined_on_the_map_side(spark):
    text = plan(evaluation.pair_counts(table(spark, SF, "labels"), "quality", "toxic"))
    assert before_exchange(text, "HashAggregate")


def test_no_cross_joins(spark):
    frames = [
        selection.stratified_split(table(spark, SF, "documents"), key="doc_id", strata=F.col("lang")),
        evaluation.class_metrics(table(spark, SF, "labels"), "quality", "toxic"),
        curate.thorough(qa(spark, SF), FIXTURE, fuzzy=False),
        monitoring.alerts(events(spark, SF), {"accuracy": F.col("ok")}),
        logs.rate_limit(events(spark, SF)),
    ]
    for df in frames:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(df))


def test_scans_read_and_filter_only_what_is_needed(spark):
    text = plan(evaluation.qa_analytics(
        events(spark, SF).withColumn("rating", F.col("value")), "2024-01-05", "2024-01-06", "ts", "ok", "value", "rating"))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    pairs = plan(qa(spark, SF))
    # a pair needs the turn that follows, whatever its role: only rows without an order are left out by the scan
    assert "IsNotNull(conv_id), IsNotNull(turn)" in pairs and "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in pairs


def test_text_is_cleaned_once(spark):
    text = plan(curate.thorough(qa(spark, SF), FIXTURE, fuzzy=False))
    # the tag pattern occurs once per cleaned column, not again in a filter or a key
    assert text.count("<[^>]+>") == 2


def test_splits_rank_inside_hash_buckets(spark):
    text = plan(selection.stratified_split(table(spark, SF, "documents"), key="doc_id", strata=F.col("lang")))
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(_g#\d+, _b#\d+", text)


@pytest.mark.parametrize("name", ["txt10_comprehensive_clean", "scr5_selection_score", "cls8_emergency_rule", "fea2_text_features"])
def test_row_operators_do_not_shuffle_or_leave_the_jvm(spark, name):
    from qacorpus.registry import QUERIES

    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Exchange hashpartitioning(text" not in text


def test_ranks_write_keys_only(spark, monkeypatch):
    """Choosing many rows writes no text for the rank, and quantiles run nothing before their result is read."""
    from qacorpus.operators import ordering, profiling
    from qacorpus.sources.readers import max_records

    written = []
    plain = ordering.write_out
    monkeypatch.setattr(ordering, "write_out", lambda df, kind="stage": written.append(df.columns) or plain(df, kind))
    docs = table(spark, SF, "documents").withColumn("ord", F.col("doc_id")).withColumn("score", F.col("n_chars").cast("double"))
    monkeypatch.setattr(ordering.first_n, "__defaults__", (10,))
    for df in (max_records(docs, 50), selection.select_top(docs, 50, 1.0), selection.sample_n(docs, 50), selection.sequential_split(docs)):
        assert df.count() >= 50
    assert written and all(not {"text", "lang", "source"} & set(columns) for columns in written)
    written.clear()
    tracker = spark.sparkContext.statusTracker()
    events_ = events(spark, SF)
    spark.sparkContext.setJobGroup("lazy", "lazy")
    frames = [profiling.boxplot_stats(events_, "value"), profiling.score_stats(events_, "value"), monitoring.ks_statistic(events_, events_, "value"),
              evaluation.eval_summary(events_.select(F.col("value").alias("inference_time"), F.col("value").alias("quality_score"), F.lit(None).cast("string").alias("error"), F.lit("x").alias("response")))]
    assert list(tracker.getJobIdsForGroup("lazy")) == [] and not written
    assert all(df.count() == 1 for df in frames)
    spark.sparkContext.setJobGroup("", "")
