"""Alerts, rolling windows, drift, retraining and log analytics against simple loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from qacorpus.operators import logs, monitoring

T0 = dt.datetime(2024, 1, 1)


def log(spark, accuracies, model="m"):
    rows = [(i, T0 + dt.timedelta(minutes=i), model, a) for i, a in enumerate(accuracies)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, model string, accuracy double").repartition(3)


@pytest.mark.parametrize("n,fires", [(100, False), (101, False), (150, True), (250, True)])
def test_accuracy_alert(spark, n, fires):
    # right for the first 100 rows, wrong afterwards; 101 rows drop by 0.01 only
    df = log(spark, [1.0] * min(n, 100) + [0.0] * max(0, n - 100))
    got = monitoring.alerts(df, {"accuracy": F.col("accuracy")}).collect()
    assert [r["type"] for r in got] == (["ACCURACY_DROP"] if fires else [])


def test_missing_accuracy_counts_zero(spark):
    got = monitoring.first_last(log(spark, [None] * 50 + [1.0] * 50), {"accuracy": F.col("accuracy")}).first()
    assert got["baseline_accuracy"] == 0.5


@pytest.mark.parametrize("n,want", [(200, 0), (201, 1)])
def test_retrain_needs_more_than_200_rows(spark, n, want):
    df = log(spark, [1.0] * 100 + [0.0] * (n - 100))
    got = monitoring.should_retrain(df, F.col("accuracy"), "2024-02-01 00:00:00", "2024-01-02 00:00:00").first()
    assert len(got["reasons"]) == want and got["retrain"] == bool(want)
    late = monitoring.should_retrain(df, F.col("accuracy"), "2024-02-02 00:00:00", "2024-01-02 00:00:00").first()
    assert "Last training was 31 days ago" in late["reasons"]
    report = monitoring.monitoring_report(df, F.col("accuracy"), "2024-02-01 00:00:00").first()
    assert report["recommendations"] == ["retrain_model:high"] * want + ["collect_more_data:medium"]


def test_rolling_accuracy(spark):
    rnd = random.Random(3)
    values = {m: [float(rnd.random() < 0.7) for _ in range(n)] for m, n in (("hot", 1000), ("cold", 40))}
    df = log(spark, values["hot"], "hot").unionByName(log(spark, values["cold"], "cold"))
    got = {(r["model"], r["event_id"]): r["rolling_accuracy"] for r in monitoring.rolling_accuracy(df, F.col("accuracy"), block=100).collect()}
    assert len(got) == 1040
    for m, vs in values.items():
        for i in range(len(vs)):
            window = vs[max(0, i - 99) : i + 1]
            assert got[(m, i)] == pytest.approx(sum(window) / len(window))


def test_ks(spark):
    rnd = random.Random(5)
    a, b = [rnd.randint(0, 20) for _ in range(300)], [rnd.randint(3, 25) for _ in range(200)]
    frames = [spark.createDataFrame([(x,) for x in v], "v int") for v in (a, b)]
    got = monitoring.ks_statistic(*frames, "v").first()
    d = max(abs(sum(x <= t for x in a) / 300 - sum(x <= t for x in b) / 200) for t in a + b)
    assert got["statistic"] == pytest.approx(d) and got["pvalue"] < 0.05
    assert got["recent_mean"] == pytest.approx(sum(a) / 300)
    same = monitoring.detect_drift(frames[0], frames[0], {"v": F.col("v")}).first()
    assert (same["statistic"], same["pvalue"], same["drifted"]) == (0.0, 1.0, False)


def test_rate_limit(spark):
    rnd = random.Random(9)
    rows = [(i, "hot" if rnd.random() < 0.8 else "cold", T0 + dt.timedelta(seconds=rnd.randint(0, 400))) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id string, ts timestamp")
    got = {r["event_id"]: r for r in logs.rate_limit(df, limit=30, seconds=60, block_seconds=60).collect()}
    assert len(got) == 400
    for i, u, t in rows:
        inside = [x for _, v, x in rows if v == u and 0 <= (t - x).total_seconds() < 60]
        assert got[i]["recent_requests"] == len(inside) - 1
        assert got[i]["rejected"] == (len(inside) - 1 >= 30)
        if got[i]["rejected"]:
            assert got[i]["retry_after"] == pytest.approx(60 - (t - min(inside)).total_seconds())


def test_error_logs(spark):
    rows = [(i, T0 + dt.timedelta(minutes=m), k, f"m{i}") for i, (m, k) in enumerate([(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "a"), (9, "a"), (10, "a"), (1435, "b"), (-100, "a")])]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, error_type string, message string")
    burst = logs.error_burst(df).collect()
    assert [(r["error_type"], r["error_count"]) for r in burst] == [("a", 6)]
    s = {r["error_type"]: r for r in logs.error_summary(df, "2024-01-02 00:00:30").collect()}
    assert (s["a"]["total_24h"], s["a"]["recent_1h"], s["a"]["latest_message"]) == (6, 0, "m6")
    assert (s["b"]["total_24h"], s["b"]["recent_1h"]) == (1, 1)


def test_batch_metrics(spark):
    df = spark.createDataFrame([(" Flu ", "flu", 2.0, False), ("x", "y", 4.0, True)], "p string, t string, l double, e boolean")
    m = monitoring.batch_metrics(df, "p", "t", "l", F.col("e")).first()
    assert m.asDict() == {"n_samples": 2, "accuracy": 0.5, "avg_latency_ms": 3.0, "error_rate": 0.5}
    empty = monitoring.batch_metrics(df.where("false"), "p", "t").first()
    assert empty["n_samples"] == 0 and empty["accuracy"] == 0.0
