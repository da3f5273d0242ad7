"""STR1-STR6: the streaming jobs over the tables read as streams, with batch SQL twins where they exist."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import writers
from ..sources.writers import prediction_log
from ..session import new_path
from ..streaming import jobs
from ..operators.monitoring import should_retrain
from . import monitoring, retrieval  # noqa: F401  (their queries are registered first)
from .base import EVENTS, FIXTURE, ORACLES, QA, QUERIES, events, ntz, qa, query, r6, table
from .splits import RATIOS, STRATIFIED, stratified
from .texts import LEVELS, pick_sql, rules_sql


def stream(spark, d, name):
    """The Parquet file of a table as a one-file stream."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/{name}*.parquet")


def event_stream(spark, d):
    e = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("ok", (F.col("event_type") != "error").cast("double"))


WINDOWED = "SELECT window_start, window_end, event_type, n_samples, round(a, 6) AS accuracy, round(v, 6) AS avg_latency_ms, round(e, 6) AS error_rate"


def shaped(df):
    return df.select(
        ntz("window_start"), ntz("window_end"), "event_type", "n_samples", r6("accuracy").alias("accuracy"),
        r6("avg_latency_ms").alias("avg_latency_ms"), r6("error_rate").alias("error_rate"),
    )


def windows(log, length="1 day", slide=None):
    return jobs.tumbling_metrics(
        log, F.col("ok"), F.col("value"), 1 - F.col("ok"), "ts", length, slide, groups=("event_type",)
    )


DAY_SQL = f"""{EVENTS}, w AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n_samples,
 avg(ok) AS a, avg(value) AS v, avg(1 - ok) AS e FROM ev GROUP BY ALL)"""
query("str2_tumbling_metrics_batch", f"WITH {DAY_SQL} {WINDOWED} FROM w")(lambda spark, d: shaped(windows(events(spark, d))))
# windows that the watermark (latest time minus one day) has closed
query("str2_tumbling_metrics", f"WITH {DAY_SQL} {WINDOWED} FROM w WHERE window_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")(
    lambda spark, d: shaped(jobs.run_available(windows(event_stream(spark, d))))
)
query(
    "str2_sliding_week",
    f"""WITH {EVENTS}, g AS (SELECT date_trunc('day', ts) - to_days(i::INTEGER) AS window_start, event_type, ok, value FROM ev, range(7) r(i)),
 w AS (SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, count(*) AS n_samples, avg(ok) AS a, avg(value) AS v, avg(1 - ok) AS e FROM g GROUP BY ALL)
 {WINDOWED} FROM w""",
)(lambda spark, d: shaped(windows(events(spark, d), "7 days", "1 day")))
query(
    "str1_stream_log",
    f"WITH {EVENTS} SELECT event_type AS question, count(*) AS n, round(avg(ok), 6) AS accuracy FROM ev GROUP BY 1",
)(lambda spark, d: _log(spark, d))


def _log(spark, d):
    """Events written as a daily JSON-lines prediction log, then followed as a stream."""
    folder = new_path(spark, "predictions")
    rows = events(spark, d).select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("question"), F.lit("a").alias("answer"), F.lit("a").alias("prediction"),
        F.create_map(F.lit("accuracy"), F.col("ok")).alias("metrics"),
    )
    prediction_log(rows, folder)
    log = jobs.run_available(jobs.read_prediction_log(spark, folder))
    return log.groupBy("question").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("metrics")["accuracy"]), 6).alias("accuracy")
    )


# A last row far behind all others moves the watermark past every question.
END = 1_800_000_000
query(
    "str4_stream_dedupe",
    """WITH r AS (SELECT doc_id, doc_id * 7919 % 1000 AS s, md5(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS k FROM documents WHERE trim(text) <> '')
 SELECT doc_id, 1700000000 + s AS at_second FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY s, doc_id) = 1""",
)(lambda spark, d: _dedupe(spark, d))


def _dedupe(spark, d):
    rows = stream(spark, d, "documents").select(
        "doc_id", F.col("text").alias("question"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 7919 % 1000).alias("at")
    )
    end = F.struct(F.lit(-1).cast("long").alias("doc_id"), F.lit("the end").alias("question"), F.timestamp_seconds(F.lit(END)).alias("at"))
    closing = F.when(F.col("doc_id") == 0, F.array(F.struct("doc_id", "question", "at"), end)).otherwise(F.array(F.struct("doc_id", "question", "at")))
    out = jobs.run_available(jobs.dedupe_stream(rows.select(F.inline(closing)), "at", tie="doc_id", delay="1 day", carry=("doc_id", "at")))
    return out.where("doc_id >= 0").select("doc_id", F.unix_seconds("at").alias("at_second"))


query(
    "str5_stream_memory",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT user_id::VARCHAR AS user_id, max(n) AS n_seen, string_agg(event_id::VARCHAR, ',' ORDER BY p DESC) AS kept FROM r WHERE p <= 5 GROUP BY 1""",
)(lambda spark, d: _memory(spark, d))


def _memory(spark, d):
    rows = event_stream(spark, d).select(
        "user_id", "ts", "event_id", F.col("event_type").alias("question"), F.col("props").alias("answer")
    )
    out = jobs.run_available(jobs.conversation_memory(rows), "update")
    items = F.from_json("memory", "array<array<string>>")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n_seen", "memory"), "batch_id").alias("s")).select("user_id", "s.*")
    return last.select("user_id", "n_seen", F.array_join(F.transform(items, lambda r: r[1]), ",").alias("kept"))


query(
    "str6_stream_triage",
    f"""SELECT conv_id, turn, k AS alert_type, {pick_sql('k', LEVELS)} AS severity FROM (SELECT conv_id, turn, {rules_sql('lower(text)')} AS k FROM conversations WHERE role = 'user') WHERE k IS NOT NULL""",
)(
    lambda spark, d: jobs.run_available(
        jobs.triage_stream(
            stream(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")), FIXTURE
        )
    ).select("conv_id", "turn", "alert_type", "severity")
)
query(
    "str3_stream_alerts",
    """WITH e AS (SELECT *, (ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY)::INTEGER AS m FROM events),
 f AS (SELECT avg(m) AS b FROM (SELECT m FROM e ORDER BY ts, event_id LIMIT 100)), l AS (SELECT avg(m) AS r FROM (SELECT m FROM e ORDER BY ts DESC, event_id DESC LIMIT 100))
 SELECT 'ACCURACY_DROP' AS type, round(b, 6) AS baseline, round(r, 6) AS recent FROM f, l WHERE b - r > 0.05""",
)(lambda spark, d: _alerts(spark, d))


def _alerts(spark, d):
    end = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("t"))
    cut = end.select((F.col("t") - F.expr("INTERVAL 1 DAY")).alias("t")).first()["t"]
    rows = event_stream(spark, d).withColumn("accuracy", (F.col("ts") < F.lit(cut)).cast("double"))
    folder = new_path(spark, "alerts")
    jobs.start_alerts(rows, folder, "ts").awaitTermination()
    found = spark.read.schema("type string, baseline double, recent double").json(f"{folder}/alerts")
    return found.select("type", r6("baseline").alias("baseline"), r6("recent").alias("recent"))


# ---- sinks: written to the shared folder and read back

query(
    "snk1_write_dataset",
    f"""WITH {QA} SELECT unnest(['csv', 'json', 'parquet']) AS format, count(*) AS n, sum(length(question) + length(answer))::BIGINT AS chars FROM qa""",
)(lambda spark, d: _datasets(spark, d))


def _datasets(spark, d):
    paths = writers.write_dataset(qa(spark, d), new_path(spark, "dataset"))
    schema = qa(spark, d).schema
    size = F.sum(F.length("question") + F.length("answer")).cast("bigint").alias("chars")
    csv = {"header": True, "multiLine": True, "escape": '"'}
    out = None
    for fmt in ("csv", "json", "parquet"):
        rows = spark.read.schema(schema).format(fmt).options(**(csv if fmt == "csv" else {})).load(paths[fmt])
        one = rows.agg(F.count(F.lit(1)).alias("n"), size).select(F.lit(fmt).alias("format"), "n", "chars")
        out = one if out is None else out.unionByName(one)
    return out


query(
    "snk2_write_splits",
    f"""WITH {STRATIFIED} SELECT count(*) AS total, count_if(split = 'train')::BIGINT AS train, count_if(split = 'val')::BIGINT AS val, count_if(split = 'test')::BIGINT AS test,
 0.7::DOUBLE AS train_ratio, 0.15::DOUBLE AS val_ratio, 0.15::DOUBLE AS test_ratio FROM split""",
)(
    lambda spark, d: writers.write_splits(stratified(spark, d), new_path(spark, "splits"), RATIOS).drop(
        "train_path", "val_path", "test_path"
    )
)
query(
    "snk3_audit_log",
    f"""WITH {QA} SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(turn), '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT conv_id) AS users FROM qa GROUP BY 1""",
)(lambda spark, d: _audit(spark, d))


def _audit(spark, d):
    path = new_path(spark, "audit")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("turn") * 3600)
    rows = qa(spark, d).select(
        F.col("conv_id").alias("user_id"), "question", "answer", F.array(F.lit("kb")).alias("sources"),
        F.lit(0.5).alias("processing_time"), at.alias("created_at"),
    )
    writers.audit_log(rows, path)
    log = spark.read.parquet(path)
    return log.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )


query("snk5_alert_log", f"SELECT type, 'm' AS model, count(*) AS n FROM ({ORACLES['mon3_latency_error_alerts']}) GROUP BY type")(
    lambda spark, d: _alert_log(spark, d)
)


def _alert_log(spark, d):
    path = new_path(spark, "alerts")
    writers.alert_log(QUERIES["mon3_latency_error_alerts"](spark, d), path, "m", "2024-01-30 12:00:00")
    return spark.read.json(path).groupBy("type", "model").agg(F.count(F.lit(1)).alias("n"))


query("snk4_prediction_log", f"WITH {EVENTS} SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n, round(avg(ok), 6) AS accuracy FROM ev GROUP BY 1")(
    lambda spark, d: _prediction_days(spark, d)
)


def _prediction_days(spark, d):
    """The log as it lies on disk: a folder of JSON lines a day, appended twice."""
    folder = new_path(spark, "predictions")
    rows = events(spark, d).select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("question"), F.create_map(F.lit("accuracy"), F.col("ok")).alias("metrics"),
    )
    for half in (0, 1):
        prediction_log(rows.where(F.col("event_id") % 2 == half).drop("event_id"), folder)
    log = spark.read.schema("timestamp timestamp, question string, metrics map<string,double>, day string").json(folder)
    return log.groupBy("day").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("metrics")["accuracy"])).alias("accuracy"))


query("snk5_retrain_log", f"SELECT reasons, 'm' AS model, TIMESTAMP '2024-01-30 12:00:00' AS at FROM ({ORACLES['mon5_should_retrain']}) WHERE retrain")(
    lambda spark, d: _retrain_log(spark, d)
)


def _retrain_log(spark, d):
    path = new_path(spark, "retrain")
    decision = should_retrain(events(spark, d), F.col("ok"), monitoring.at(monitoring.NOW), monitoring.at("2023-12-16 00:00:00"))
    writers.retrain_log(decision, path, "m", "2024-01-30 12:00:00")
    written = spark.read.schema("timestamp timestamp, reasons array<string>, model string").json(path)
    return written.select(F.array_join("reasons", "|").alias("reasons"), "model", ntz("timestamp").alias("at"))


query("str7_stream_curate", ORACLES["str7_valid_requests"])(
    lambda spark, d: jobs.run_available(jobs.curate_stream(
        stream(spark, d, "conversations").select(
            "conv_id", "turn", F.when(F.col("role") == "system", "   ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("question"),
            F.when(F.col("role") == "user", F.col("conv_id").cast("string")).otherwise("").alias("user_id"),
        )
    ))
)
query(
    "log5_stream_burst",
    """WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS s, event_type FROM events, range(2) r(i)),
 w AS (SELECT s, event_type FROM b GROUP BY ALL HAVING count(*) > 1)
 SELECT DISTINCT event_type, date_trunc('hour', s) AS period FROM w WHERE s + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)(
    lambda spark, d: jobs.run_available(jobs.burst_alerts(event_stream(spark, d), "event_type", more_than=1)).select("event_type", ntz("period").alias("period"))
)
