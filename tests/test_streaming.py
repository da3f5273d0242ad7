"""Streams fed in several micro-batches give what the batch twin gives."""

import datetime as dt
import json

from pyspark.sql import functions as F

from qacorpus.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp, user_id string, question string, answer string, accuracy double"


def feed(spark, folder, batches):
    """One file per batch, read one file per trigger, in name order of modification."""
    import os

    for i, rows in enumerate(batches):
        part = str(folder / f"b{i}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(part)
        for name in os.listdir(part):
            os.utime(f"{part}/{name}", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.json(str(folder))


def row(i, user="u", question="q", accuracy=1.0, minutes=None):
    return (i, T0 + dt.timedelta(minutes=i if minutes is None else minutes), user, question, f"a{i}", accuracy)


def test_dedupe_keeps_the_earliest_row_of_a_question(spark, tmp_path):
    """Whichever batch it comes in: a late row that is earlier in time wins, repeats within the hold never get out."""
    batches = [[row(5, question="A b", minutes=5), row(1, question="c", minutes=1)],
               [row(2, question="a  B ", minutes=2), row(3, question="d", minutes=3), row(4, question="D", minutes=3)],
               [row(8, question="a b", minutes=50), row(9, question="end", minutes=60 * 24 * 3)],
               [row(10, question="c", minutes=60 * 24 * 3 + 5), row(11, question="last", minutes=60 * 24 * 9)],
               [row(12, question="C", minutes=60 * 24 * 10)], [row(13, question="zz", minutes=60 * 24 * 20)]]
    out = jobs.run_available(jobs.dedupe_stream(feed(spark, tmp_path, batches), "ts", delay="1 hour", hold="1 day"))
    # row 10 comes after the watermark has passed the hold of question c, row 12 after that of row 10
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3, 9, 10, 11, 12]
    assert out.schema.names == [c.split(" ")[0] for c in SCHEMA.split(", ")]


def test_dedupe_holds_only_the_columns_asked_for(spark, tmp_path):
    batches = [[row(5, question="A b", minutes=5), row(1, question="c", minutes=1)], [row(2, question="a  B ", minutes=2)],
               [row(9, question="end", minutes=60 * 24 * 3)], [row(10, question="last", minutes=60 * 24 * 9)]]
    out = jobs.run_available(jobs.dedupe_stream(feed(spark, tmp_path, batches), "ts", delay="1 hour", hold="1 day", carry=("event_id",)))
    assert out.columns == ["event_id"] and sorted(r["event_id"] for r in out.collect()) == [1, 2, 9]


def test_memory_keeps_the_last_five(spark, tmp_path):
    batches = [[row(i, "hot") for i in range(0, 4)], [row(i, "hot") for i in (7, 4, 6, 5)] + [row(8, "cold")]]
    out = jobs.run_available(jobs.conversation_memory(feed(spark, tmp_path, batches)), "update")
    last = {r["user_id"]: r for r in out.orderBy("batch_id").collect()}
    assert [x[1] for x in json.loads(last["hot"]["memory"])] == [3, 4, 5, 6, 7]
    assert (last["hot"]["n_seen"], last["cold"]["n_seen"]) == (8, 1)


def test_memory_of_idle_users_leaves_the_state(spark, tmp_path):
    day = 60 * 24
    batches = [[row(0, "back", minutes=0), row(1, "stays", minutes=0), row(6, "gone", minutes=0)], [row(2, "stays", minutes=4 * day)],
               [row(3, "stays", minutes=8 * day)], [row(4, "back", minutes=9 * day), row(5, "stays", minutes=9 * day)]]
    stream = jobs.conversation_memory(feed(spark, tmp_path / "in", batches), delay="1 hour", idle="5 days")
    query = stream.writeStream.outputMode("update").format("memory").queryName("memory_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = {(r.user_id, len(json.loads(r.memory)), r.n_seen) for r in spark.table("memory_rows").collect()}
    assert ("back", 1, 1) in got and not any(u == "back" and n > 1 for u, _, n in got)  # forgotten in between
    assert ("stays", 4, 4) in got and rows[-1] < max(rows)


def test_alerts_per_batch(spark, tmp_path):
    batches = [[row(i, accuracy=1.0) for i in range(80)], [row(i, accuracy=1.0 if i < 100 else 0.0) for i in range(80, 160)],
               [row(i, accuracy=1.0) for i in range(160, 300)]]
    folder = str(tmp_path / "out")
    jobs.start_alerts(feed(spark, tmp_path / "in", batches), folder, "ts").awaitTermination()
    found = spark.read.json(f"{folder}/alerts").collect()
    # rows 60..159 hold 40 right ones; the last 100 of batch 2 are right again
    assert [(r["batch_id"], r["type"], r["baseline"], r["recent"]) for r in found] == [(1, "ACCURACY_DROP", 1.0, 0.4)]


def test_triage_and_validation(spark, tmp_path):
    questions = ["chest pain and arm pain", "a cold", "  ", " anaphylaxis "]
    stream = feed(spark, tmp_path, [[row(i, user="", question=q) for i, q in enumerate(questions)]])
    out = jobs.run_available(jobs.triage_stream(jobs.curate_stream(stream)))
    got = {r["event_id"]: (r["alert_type"], r["severity"], r["user_id"], r["question"]) for r in out.collect()}
    assert got == {
        0: ("heart_attack", "critical", "anonymous", "chest pain and arm pain"),
        3: ("severe_allergic_reaction", "critical", "anonymous", "anaphylaxis"),
    }


def test_log_reader_skips_malformed_lines(spark, tmp_path):
    day = tmp_path / "predictions_20240101.jsonl"
    good = {"timestamp": "2024-01-01T00:00:00", "question": "q", "answer": "a", "prediction": "p", "metrics": {"accuracy": 1.0}}
    day.write_text(json.dumps(good) + "\n{broken\n" + json.dumps({**good, "metrics": {}}) + "\n")
    out = jobs.run_available(jobs.read_prediction_log(spark, str(tmp_path)))
    assert sorted(r["a"] or 0.0 for r in out.select(F.col("metrics")["accuracy"].alias("a")).collect()) == [0.0, 1.0]


def test_windows_match_the_batch_twin(spark, tmp_path):
    rows = [row(i, accuracy=float(i % 3 > 0), minutes=i * 60) for i in range(24 * 6)]
    stream = feed(spark, tmp_path, [rows[:70], rows[70:]])
    args = (F.col("accuracy"), F.col("event_id"), 1 - F.col("accuracy"))
    streamed = {r["window_start"]: r for r in jobs.run_available(jobs.tumbling_metrics(stream, *args, delay="1 hour")).collect()}
    batch = {r["window_start"]: r for r in jobs.tumbling_metrics(spark.createDataFrame(rows, SCHEMA), *args).collect()}
    assert len(batch) == 6 and len(streamed) == 5  # the last day is still open
    assert all(streamed[k] == batch[k] for k in streamed)
