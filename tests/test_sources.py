"""Corpus files, per-source layouts, pairs, sinks."""

import json
import os

from pyspark.sql import functions as F

from qacorpus.sources import readers, writers


def dump(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")


def test_read_corpus(spark, tmp_path):
    dump(tmp_path / "medical_datasets_combined_1.json", [{"question": "old", "answer": "x"}])
    dump(tmp_path / "medical_datasets_combined_2.json", {"data": [{"question": "c1", "answer": "1"}, {"question": "c2", "answer": "2"}]})
    os.utime(tmp_path / "medical_datasets_combined_1.json", (1, 1))
    dump(tmp_path / "medical_a.json", [{"question": "a1", "answer": "1", "options": ["x", "y"]}, {"input": "a2", "output": "2"}])
    dump(tmp_path / "b.json", {"entries": [{"prompt": "b1", "response": "1"}]})
    dump(tmp_path / "c.json", {"questions": [{"text": "q1", "target": "1"}]})
    dump(tmp_path / "d.json", {"question": "single", "answer": "1", "extra": 5})
    (tmp_path / "e.json").write_text("not json at all")
    (tmp_path / "skip.txt").write_text("{}")
    rows = readers.with_fallbacks(readers.read_corpus(spark, str(tmp_path))).orderBy("ord").collect()
    # newest combined file first, then the others by name, every file once
    assert [r["question"] for r in rows] == ["c1", "c2", "b1", "q1", "single", "a1", "a2"]
    assert [r["answer"] for r in rows] == ["1", "2", "1", "1", "1", "1", "2"]
    assert rows[5]["options"] == ["x", "y"]
    assert len({r["ord"] for r in rows}) == 7


def test_field_fallbacks_skip_empty_strings(spark):
    df = spark.createDataFrame([("", "in", None, "r"), (None, "", "p", ""), ("q", "in", "p", "r")], "question string, input string, prompt string, response string")
    got = [(r["question"], r["answer"]) for r in readers.with_fallbacks(df).collect()]
    assert got == [("in", "r"), ("p", ""), ("q", "r")]


def test_source_layouts(spark):
    mcq = spark.createDataFrame(
        [("q", "a", "b", "c", "d", i, "s", None, "train") for i in (0, 3, 4, -1)],
        "question string, opa string, opb string, opc string, opd string, cop int, subject_name string, exp string, split string",
    )
    assert [r["answer"] for r in readers.from_medmcqa(mcq).collect()] == ["a", "d", "", "d"]
    medqa = spark.createDataFrame([("q", ["x", "y"], "test"), (None, [], "test"), ("q", None, "test")], "question string, answer array<string>, split string")
    assert [(r["question"], r["answer"]) for r in readers.from_medqa(medqa).collect()] == [("q", "x"), ("", ""), ("q", "")]
    pub = spark.createDataFrame([("q", "yes", (["a", "b"],)), ("q", "no", (None,))], "question string, final_decision string, context struct<contexts:array<string>>")
    assert [r["context"] for r in readers.from_pubmedqa(pub).collect()] == ["a b", ""]
    chat = spark.createDataFrame([("i", "o", None)], "input string, output string, instruction string")
    assert readers.from_chatdoctor(chat).first()["type"] == "medical_conversation"


def test_pairs_of_one_hot_conversation(spark):
    roles = ["system", "user", "assistant", "user", "user", "assistant", "user"]
    rows = [(7, i, r, f"t{i}") for i, r in enumerate(roles)] + [(8, 0, "user", "alone")]
    got = [(r["question"], r["answer"]) for r in readers.qa_pairs(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("ord").collect()]
    assert got == [("t1", "t2"), ("t4", "t5")]


def test_dataset_and_split_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 'say "hi",\nok', ["a"], "train"), (1, "x", None, "test")], "ord int, question string, options array<string>, split string")
    paths = writers.write_dataset(df, str(tmp_path / "d"), df.agg(F.count(F.lit(1)).alias("n")))
    assert spark.read.parquet(paths["parquet"]).count() == spark.read.json(paths["json"]).count() == 2
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths["csv"]).orderBy("ord").collect()
    assert csv[0]["question"] == 'say "hi",\nok' and csv[0]["options"] == '["a"]'
    assert spark.read.json(paths["stats"]).first()["n"] == 2
    summary = writers.write_splits(df, str(tmp_path / "s"), (0.5, 0.0, 0.5)).first()
    assert (summary["total"], summary["train"], summary["val"], summary["test"]) == (2, 1, 0, 1)
    assert spark.read.parquet(summary["test_path"]).first()["ord"] == 1


def test_log_sinks_append(spark, tmp_path):
    row = spark.createDataFrame([(None, "q", "a", ["kb"], 0.5, "2024-01-02 03:04:05")], "user_id string, question string, answer string, sources array<string>, processing_time double, created_at string")
    for _ in range(2):
        writers.audit_log(row, str(tmp_path / "audit"))
    log = spark.read.parquet(str(tmp_path / "audit"))
    assert log.count() == 2 and log.first()["user_id"] == "anonymous" and log.first()["sources"] == '["kb"]'
    decision = spark.createDataFrame([(True, ["r1"]), (False, [])], "retrain boolean, reasons array<string>")
    writers.retrain_log(decision, str(tmp_path / "retrain"), "m", "2024-01-01 00:00:00")
    assert [r["reasons"] for r in spark.read.json(str(tmp_path / "retrain")).collect()] == [["r1"]]
