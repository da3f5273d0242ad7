"""Rows that joins and divisions must not lose."""

import pytest
from pyspark.sql import functions as F

from qacorpus.operators.evaluation import confusion_matrix
from qacorpus.operators.logs import latency_tracker
from qacorpus.operators.matching import label_index, match_rule_table
from qacorpus.operators.monitoring import ks_statistic
from qacorpus.operators.ordering import top_n
from qacorpus.operators.retrieval import vector_topk
from qacorpus.operators.selection import stratified_split
from qacorpus.session import shared_dir
from qacorpus.sources.readers import qa_pairs


def test_null_stratum_is_split_like_any_other(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"s{i % 3}") for i in range(30)], "ord long, g string")
    split = stratified_split(rows, (0.8, 0.1, 0.1), strata=F.col("g"))
    assert split.count() == 30 and split.where("g is null").count() == 10


def test_null_function_keeps_its_calls(spark):
    log = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0), (3, "f", 1.0)], "event_id long, function string, duration double")
    got = {r.function: (r.call_count, r.recent_avg) for r in latency_tracker(log, ts="event_id").collect()}
    assert got == {None: (2, 3.0), "f": (1, 1.0)}


def test_empty_samples_have_no_statistic(spark):
    some, none = spark.createDataFrame([(1.0,), (2.0,)], "v double"), spark.createDataFrame([], "v double")
    r = ks_statistic(none, some, "v").first()
    assert (r.n_recent, r.n_reference, r.statistic, r.pvalue, r.recent_mean, r.reference_mean) == (0, 2, None, None, None, 1.5)
    assert ks_statistic(none, none, "v").first().statistic is None
    assert ks_statistic(some, some, "v").first().statistic == 0.0


def test_pairs_across_gaps_and_blocks(spark):
    rows = [
        (1, 1, "user", "a"), (1, 3, "assistant", "b"),  # a gap in the numbers
        (1, 5, "user", "c"), (1, 5_000, "assistant", "d"),  # the answer is some blocks away
        (1, 5_001, "user", "e"), (1, 5_002, "system", "f"), (1, 5_003, "assistant", "g"),  # not the next turn
        (2, 1, "user", "h"), (3, 2, "assistant", "i"),  # another conversation
        (None, 1, "user", "j"), (None, 2, "assistant", "k"), (4, None, "user", "l"),
    ]
    got = qa_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.conv_id, r.turn, r.question, r.answer) for r in got.collect()) == [(1, 1, "a", "b"), (1, 5, "c", "d")]


def test_top_n_is_ordered_beyond_the_heap(spark):
    rows = spark.range(5_000).select(F.col("id").alias("ord"), F.xxhash64("id").alias("h"))
    want = [r.ord for r in rows.orderBy("h", "ord").limit(2_000).collect()]
    assert [r.ord for r in top_n(rows, [F.col("h"), F.col("ord")], 2_000).collect()] == want


def test_no_machine_local_folder_on_a_cluster():
    class Unset:
        """A session of a cluster that names no shared folder."""

        sparkContext = conf = _jsc = property(lambda self: self)
        master = "spark://host:7077"

        def sc(self):
            return self

        getConf = getCheckpointDir = sc

        def isDefined(self):
            return False

        def get(self, key, default=None):
            return default

    with pytest.raises(ValueError):
        shared_dir(Unset())


def test_large_rule_tables_match_like_small_ones(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Chest pain and sweating", "no pain", "ab in x", "", None, "fever"])], "ord long, question string")
    rules = [(1, "heart", ["chest pain", "sweat"]), (0, "short", ["ab", "x"]), (2, "heat", ["fever"]), (3, "late", ["fever"])]
    rules = spark.createDataFrame(rules, "rule_ord int, kind string, pattern array<string>")
    want = {0: "heart", 1: None, 2: "short", 3: None, 4: None, 5: "heat"}
    for inline in (2_000, 0):
        assert {r.ord: r.alert_type for r in match_rule_table(rows, rules, inline=inline).collect()} == want


def test_odd_patterns_are_the_same_in_both_forms(spark):
    """Null, empty and null-holding patterns match nothing, an empty keyword occurs in every text that isn't null."""
    rows = spark.createDataFrame([(0, "abc"), (1, ""), (2, None), (3, "zz")], "ord long, question string")
    odd = [(0, "null", None), (1, "none", []), (2, "hole", ["abc", None]), (3, "blank", ["", "b"])]
    for last, want in (([(9, "all", [""])], {0: "blank", 1: "all", 2: None, 3: "all"}), ([], {0: "blank", 1: None, 2: None, 3: None})):
        rules = spark.createDataFrame(odd + last, "rule_ord int, kind string, pattern array<string>")
        for inline in (2_000, 0):
            assert {r.ord: r.alert_type for r in match_rule_table(rows, rules, inline=inline).collect()} == want
    nothing = spark.createDataFrame(odd[:3], "rule_ord int, kind string, pattern array<string>")
    assert {r.alert_type for r in match_rule_table(rows, nothing).collect()} == {None}


def test_automata_in_blocks(spark, monkeypatch):
    """More keywords than one automaton takes: the texts go through several, and a pattern's keywords may be in different ones."""
    words = [f"w{k:03d}x" for k in range(60)]
    rules = spark.createDataFrame([(k, f"r{k}", [words[k], words[(7 * k + 1) % 60]]) for k in range(60)], "rule_ord int, kind string, pattern array<string>")
    texts = [" ".join(words[(i * 13 + 5 * j) % 60] for j in range(9)) for i in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, question string")
    want = {i: next((f"r{k}" for k in range(60) if words[k] in t and words[(7 * k + 1) % 60] in t), None) for i, t in enumerate(texts)}
    monkeypatch.setattr("qacorpus.operators.matching.KEYWORDS", 20)
    assert {r.ord: r.alert_type for r in match_rule_table(rows, rules, inline=0).collect()} == want


def test_null_labels_count_as_agreement(spark):
    from qacorpus.operators.evaluation import class_metrics, confusion_highlights

    rows = spark.createDataFrame([(None, None), (None, None), ("a", None), ("a", "a")], "expected_category string, predicted_category string")
    got = {r.label: (r.tp, r.fp, r.fn, r.support) for r in class_metrics(rows).collect()}
    assert got == {None: (2, 1, 0, 2), "a": (1, 0, 1, 2)}
    worst = confusion_highlights(rows).first()
    assert (worst.confused_true, worst.confused_pred, worst.confused_n) == ("a", None, 1)


def test_null_labels_in_the_confusion_matrix(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), (None, "a"), (None, None), ("b", "a")], "expected_category string, predicted_category string")
    got = {(r.true_label, r.pred_label): r.n for r in confusion_matrix(rows, dense=True).collect()}
    assert len(got) == 9 and got[("a", None)] == got[(None, "a")] == got[(None, None)] == got[("b", "a")] == 1 and got[("b", "b")] == 0
    sparse = {(r.true_label, r.pred_label): r.share for r in confusion_matrix(rows, normalize=True, dense=False).collect()}
    assert len(sparse) == 5 and sparse[("a", None)] == 0.5 and sparse[("b", "a")] == 1.0


def test_rows_without_a_vector(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    got = vector_topk(rows, rows, 1, query_id="id", doc_id="id").collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(1, 1), (3, 3)]


def test_order_numbers_never_collide(spark):
    rows = spark.createDataFrame([(1 << 40, 1, "user", "a"), (1 << 40, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="too large for ord"):
        qa_pairs(rows).collect()
    assert qa_pairs(rows, turn_bits=16).first().ord == (1 << 56) + 1


def test_label_index_without_one_task(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "label string")
    assert sorted((r.label, r.n, r.label_id) for r in label_index(rows, "label").collect()) == [("a", 1, 0), ("b", 2, 1), ("c", 1, 2)]
