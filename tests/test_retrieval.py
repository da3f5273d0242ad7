"""Vector search against brute force, snippets, templates, history, the answering plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qacorpus.operators import retrieval
from qacorpus.plans.answer import answer_questions


def frame(spark, ids, vectors, name):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block_floats", [8_000_000, 80])  # one broadcast block / many blocks
def test_vector_topk(spark, metric, block_floats):
    rng = np.random.default_rng(0)
    docs = rng.normal(size=(300, 8)).astype(np.float32)
    docs[7] = docs[3]  # a tie
    queries = np.concatenate([rng.normal(size=(30, 8)).astype(np.float32), docs[3:4]])
    got = retrieval.vector_topk(
        frame(spark, range(31), queries, "query_id"), frame(spark, range(300), docs, "doc_id").repartition(5), 3, metric, block_floats=block_floats
    )
    found = {(r["query_id"], r["rank"]): r["doc_id"] for r in got.collect()}
    q, d = queries.astype(float), docs.astype(float)
    dist = ((q[:, None] - d[None]) ** 2).sum(-1)
    if metric == "cosine":
        dist = 1 - (q @ d.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(d, axis=1)
    for i in range(31):
        order = sorted(range(300), key=lambda j: (round(dist[i, j], 9), j))[:3]
        assert [found[(i, r)] for r in (1, 2, 3)] == order


def test_fewer_documents_than_k(spark):
    d = frame(spark, [1, 2], [[0, 0], [1, 1]], "doc_id")
    q = frame(spark, [9], [[0, 1]], "query_id")
    assert retrieval.vector_topk(q, d, 5).count() == 2
    assert retrieval.vector_topk(q.where("false"), d, 5).count() == 0


def test_snippets(spark):
    rows = [
        (1, 1, "Question: skip me entirely, thank you\nlong enough line for a snippet"),
        (1, 2, "short\nThe following symptoms are common:\n  A line that is long enough to count \nAnother line that is long enough"),
        (1, 3, "x" * 400),
        (2, 1, "tiny"),
        (3, 1, "y" * 200 + "\n" + "z" * 200),
    ]
    df = spark.createDataFrame(rows, "query_id int, rank int, content string")
    got = {r["query_id"]: r["snippet"] for r in retrieval.snippets(df).collect()}
    assert got[1] == "A line that is long enough to count Another line that is long enough"
    assert got[2] == ""
    assert len(got[3]) == 300 and got[3].endswith("...")


def test_template_refs_and_keywords(spark):
    df = spark.createDataFrame([("", None), ("heart_attack", "info"), ("x", "")], "n string, i string")
    out = [r["a"] for r in df.select(retrieval.answer_template(F.col("n"), F.col("i")).alias("a")).collect()]
    assert out[0] == retrieval.CLARIFY
    assert out[1].startswith("Based on your symptoms, you likely have **Heart Attack**.\n\n**About this condition:**\ninfo\n")
    assert "About" not in out[2]
    refs = retrieval.source_refs(spark.createDataFrame([("c" * 250, None, None)], "content string, topic string, category string")).first()
    assert (refs["topic"], refs["category"], len(refs["excerpt"])) == ("unknown", "general", 203)
    knowledge = spark.createDataFrame([(1, "เบาหวาน,diabetes, Sugar"), (2, "fever,diabetes")], "id int, keywords string")
    queries = spark.createDataFrame([(5, "Sugar diabetes diabetes"), (6, "none")], "query_id int, query string")
    hits = {(r["query_id"], r["id"]): r["n_keywords"] for r in retrieval.keyword_search(queries, knowledge).collect()}
    assert hits == {(5, 1): 2, (5, 2): 1}


def test_history_and_context(spark):
    rows = [("u", i, i, f"q{i}", "a" * 150) for i in range(8)] + [("v", 0, 9, "only", "short")]
    df = spark.createDataFrame(rows, "user_id string, ts int, event_id int, question string, answer string")
    assert sorted(r["ts"] for r in retrieval.recent_history(df).where("user_id = 'u'").collect()) == [3, 4, 5, 6, 7]
    ctx = {r["user_id"]: r["context"] for r in retrieval.context_strings(df).collect()}
    assert ctx["v"] == "User: only\nAssistant: short..."
    assert [line[:8] for line in ctx["u"].split("\n")][::2] == ["User: q5", "User: q6", "User: q7"]
    assert all(len(line) == len("Assistant: ") + 103 for line in ctx["u"].split("\n")[1::2])


def test_alerts_look_at_the_question_only(spark):
    docs = frame(spark, [1], [[0.0, 0.0]], "doc_id").withColumn("content", F.lit("Chest pain with shortness of breath in a document.")).withColumn(
        "topic", F.lit("heart")).withColumn("category", F.lit("c"))
    asks = frame(spark, [1, 2], [[0, 0], [1, 1]], "query_id").withColumn(
        "question", F.when(F.col("query_id") == 1, "what is high blood pressure").otherwise("crushing chest pain")
    ).withColumn("disease", F.lit("hypertension"))
    out = {r["query_id"]: r for r in answer_questions(asks, docs).collect()}
    assert out[1]["alert_type"] is None and "likely have **Hypertension**" in out[1]["answer"] and "Chest pain with" in out[1]["answer"]
    assert out[2]["answer"].startswith("🚨") and out[2]["sources"][0]["topic"] == "heart"


def test_rows_are_copied_for_few_blocks():
    """600,000 vectors of 64 floats on 12 cores: every row was copied 300 times in blocks of 2,000."""
    per_block = retrieval.QUERY_BLOCK_FLOATS // 64
    assert retrieval._grid(600_000, per_block, 12) == 6
    assert retrieval._grid(10_000_000, per_block, 12) == 80 and retrieval._grid(5, per_block, 12) == 1
    assert retrieval._grid(300, 20, 8) == 15
