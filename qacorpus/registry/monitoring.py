"""MON1-MON6, WIN3-WIN5, LOG1-LOG8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import word_count
from ..operators import logs, monitoring
from .base import EVENTS, QA, events, ntz, qa, query, r6, s_nwords, table
from .texts import TRIAGE_CAT, TRIAGE_SEV, TRIAGE_SQL

NOW = "2024-01-30 12:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


query(
    "mon1_batch_metrics",
    f"""WITH {EVENTS}, t AS (SELECT lower(trim(event_type)) = lower(trim(CASE WHEN user_id % 2 = 0 THEN ' View ' ELSE event_type END)) AS same, value, ok FROM ev)
 SELECT count(*) AS n_samples, round(avg(same::INTEGER), 6) AS accuracy, round(avg(value), 6) AS avg_latency_ms, round(avg(1 - ok), 6) AS error_rate FROM t""",
)(
    lambda spark, d: monitoring.batch_metrics(
        events(spark, d).withColumn("truth", F.when(F.col("user_id") % 2 == 0, " View ").otherwise(F.col("event_type"))),
        "event_type", "truth", "value", F.col("ok") == 0,
    ).select("n_samples", *[r6(c).alias(c) for c in ("accuracy", "avg_latency_ms", "error_rate")])
)
FIRST_LAST = f"""{EVENTS}, f AS (SELECT ok, value, 1 - ok AS err FROM ev ORDER BY ts, event_id LIMIT 100), l AS (SELECT ok, value, 1 - ok AS err FROM ev ORDER BY ts DESC, event_id DESC LIMIT 100),
 fl AS (SELECT (SELECT count(*) FROM ev) AS total_rows, (SELECT avg(ok) FROM f) AS ba, (SELECT avg(ok) FROM l) AS ra, (SELECT avg(value) FROM f) AS bl,
 (SELECT avg(value) FROM l) AS rl, (SELECT avg(err) FROM f) AS be, (SELECT avg(err) FROM l) AS re)"""
METRICS = ("accuracy", "latency", "error")


def metrics():
    return {"accuracy": F.col("ok"), "latency": F.col("value"), "error": 1 - F.col("ok")}


query(
    "win3_first_last_n",
    f"""WITH {FIRST_LAST} SELECT total_rows, round(ba, 6) AS baseline_accuracy, round(ra, 6) AS recent_accuracy, round(bl, 6) AS baseline_latency,
 round(rl, 6) AS recent_latency, round(be, 6) AS baseline_error, round(re, 6) AS recent_error FROM fl""",
)(
    lambda spark, d: monitoring.first_last(events(spark, d), metrics()).select(
        "total_rows", *[r6(f"{p}_{m}").alias(f"{p}_{m}") for m in METRICS for p in ("baseline", "recent")]
    )
)
ALERT = "SELECT '{0}' AS type, round({1}, 6) AS baseline, round({2}, 6) AS recent, round({3}, 6) AS change FROM fl WHERE total_rows > 100 AND {3} > {4}::DOUBLE"
# accuracy measured as "not a click": this one falls in the fixture or not as the data has it
query(
    "mon2_accuracy_alert",
    f"""WITH e AS (SELECT *, (ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY)::INTEGER AS m FROM events),
 f AS (SELECT avg(m) AS b FROM (SELECT m FROM e ORDER BY ts, event_id LIMIT 100)), l AS (SELECT avg(m) AS r FROM (SELECT m FROM e ORDER BY ts DESC, event_id DESC LIMIT 100))
 SELECT 'ACCURACY_DROP' AS type, round(b, 6) AS baseline, round(r, 6) AS recent, round(b - r, 6) AS change FROM f, l WHERE b - r > 0.05""",
)(lambda spark, d: _falling(spark, d))


def _falling(spark, d):
    e = events(spark, d)
    end = e.agg(F.max("ts")).scalar()
    e = e.withColumn("m", (F.col("ts") < end - F.expr("INTERVAL 1 DAY")).cast("double"))
    out = monitoring.alerts(e, {"accuracy": F.col("m")})
    return out.select("type", *[r6(c).alias(c) for c in ("baseline", "recent", "change")])


# latency and failures that grow over the month
WORSE = """e AS (SELECT *, value + 5 * day(ts) AS lat, (event_type = 'error' OR day(ts) > 15)::INTEGER AS err FROM events),
 f AS (SELECT * FROM e ORDER BY ts, event_id LIMIT 100), l AS (SELECT * FROM e ORDER BY ts DESC, event_id DESC LIMIT 100),
 fl AS (SELECT (SELECT count(*) FROM e) AS total_rows, (SELECT avg(lat) FROM f) AS bl, (SELECT avg(lat) FROM l) AS rl, (SELECT avg(err) FROM f) AS be, (SELECT avg(err) FROM l) AS re)"""
query(
    "mon3_latency_error_alerts",
    f"WITH {WORSE} " + " UNION ALL ".join([
        ALERT.format("LATENCY_INCREASE", "bl", "rl", "((rl - bl) / bl)", 0.2), ALERT.format("ERROR_RATE_INCREASE", "be", "re", "(re - be)", 0.1),
    ]),
)(
    lambda spark, d: monitoring.alerts(
        events(spark, d),
        {
            "latency": F.col("value") + 5 * F.dayofmonth("ts"),
            "error": ((F.col("event_type") == "error") | (F.dayofmonth("ts") > 15)).cast("double"),
        },
    ).select("type", *[r6(c).alias(c) for c in ("baseline", "recent", "change")])
)
query(
    "win4_rolling_accuracy",
    f"""WITH {EVENTS} SELECT event_id, event_type, round(avg(ok + (event_type = 'error')::INTEGER * (user_id % 2)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS rolling_accuracy FROM ev""",
)(
    lambda spark, d: monitoring.rolling_accuracy(
        events(spark, d), F.col("ok") + F.when(F.col("event_type") == "error", F.col("user_id") % 2).otherwise(0), "event_type", block=1000
    ).select("event_id", "event_type", r6("rolling_accuracy").alias("rolling_accuracy"))
)
KS = """u AS (SELECT v, count(*) FILTER (s = 'a') AS a, count(*) FILTER (s = 'b') AS b FROM x GROUP BY 1),
 c AS (SELECT v, a, b, sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM u), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM u)"""
query(
    "win5_ks_statistic",
    f"""WITH x AS (SELECT value AS v, CASE WHEN event_type = 'view' THEN 'a' WHEN event_type = 'purchase' THEN 'b' END AS s FROM events WHERE event_type IN ('view', 'purchase')), {KS}
 SELECT max(na)::BIGINT AS n_recent, max(nb)::BIGINT AS n_reference, round(max(abs(ca / na - cb / nb)), 6) AS statistic FROM c, n""",
)(
    lambda spark, d: monitoring.ks_statistic(
        table(spark, d, "events").where("event_type = 'view'"), table(spark, d, "events").where("event_type = 'purchase'"), "value"
    ).select("n_recent", "n_reference", r6("statistic").alias("statistic"))
)
query(
    "mon4_drift_statistic",
    f"""WITH {QA}, w AS (SELECT {s_nwords('question')} AS q, {s_nwords('answer')} AS a FROM qa),
 x AS (SELECT q AS v, 'a' AS s FROM w UNION ALL SELECT a, 'b' FROM w), {KS}
 SELECT max(na)::BIGINT AS n_recent, max(nb)::BIGINT AS n_reference, round(max(abs(ca / na - cb / nb)), 6) AS statistic,
 round(sum(v * a) / sum(a), 6) AS recent_mean, round(sum(v * b) / sum(b), 6) AS reference_mean FROM c, n""",
)(lambda spark, d: _drift(spark, d).select("n_recent", "n_reference", *[r6(c).alias(c) for c in ("statistic", "recent_mean", "reference_mean")]))


def _drift(spark, d):
    rows = qa(spark, d)
    return monitoring.ks_statistic(
        rows.select(word_count(F.col("question")).alias("v")), rows.select(word_count(F.col("answer")).alias("v")), "v"
    )


# the p-value is a finite alternating sum, so SQL can say it
@query(
    "mon4_detect_drift",
    f"""WITH d AS (SELECT text, n_chars, quality FROM documents JOIN labels USING (doc_id)),
 x AS (SELECT 'words' AS feature, {s_nwords('text')} AS v, quality FROM d UNION ALL SELECT 'chars', n_chars, quality FROM d),
 g AS (SELECT feature, v, count(*) FILTER (WHERE quality = 0) AS a, count(*) FILTER (WHERE quality = 1) AS b FROM x GROUP BY 1, 2),
 c AS (SELECT feature, v, a, b, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM g
   WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
 s AS (SELECT feature, max(na) AS m, max(nb) AS n, max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS st, sum(v * a)::DOUBLE / sum(a) AS rm, sum(v * b)::DOUBLE / sum(b) AS fm FROM c GROUP BY feature),
 q AS (SELECT *, st * st * m * n / (m + n) AS l FROM s),
 e AS (SELECT *, CASE WHEN l < 0.01::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
   2 * list_sum(list_transform(range(1, 201), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * l))))) END AS p FROM q)
 SELECT feature, m::BIGINT AS n_recent, n::BIGINT AS n_reference, round(st, 6) AS statistic, round(rm, 6) AS recent_mean, round(fm, 6) AS reference_mean,
 round(p, 6) AS pvalue, p < 0.05::DOUBLE AS drifted FROM e""",
)
def _mon4(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    good, bad = docs.where("quality = 1"), docs.where("quality = 0")
    found = monitoring.detect_drift(bad, good, {"words": word_count(F.col("text")), "chars": F.col("n_chars")})
    return found.select("feature", "n_recent", "n_reference", *[r6(c).alias(c) for c in ("statistic", "recent_mean", "reference_mean", "pvalue")], "drifted")


query(
    "mon5_should_retrain",
    f"""WITH {FIRST_LAST} SELECT total_rows, array_to_string(list_filter([
   CASE WHEN total_rows > 200 AND ba - ra > 0.05 THEN 'Accuracy dropped by ' || printf('%.2f', (ba - ra) * 100) || '%' END,
   'Last training was 45 days ago', CASE WHEN total_rows > 10000 THEN 'Accumulated ' || format('{{:,}}', total_rows) || ' new samples' END],
 lambda s: s IS NOT NULL), '|') AS reasons, true AS retrain FROM fl""",
)(
    lambda spark, d: monitoring.should_retrain(events(spark, d), F.col("ok"), at(NOW), at("2023-12-16 00:00:00")).select(
        "total_rows", F.array_join("reasons", "|").alias("reasons"), "retrain"
    )
)
query(
    "mon6_report",
    f"""WITH {FIRST_LAST} SELECT total_rows AS total_predictions, least(total_rows, 100)::BIGINT AS recent_predictions, round(ra, 6) AS avg_accuracy,
 (SELECT count(*) FROM events WHERE event_type = 'error') AS total_alerts,
 array_to_string(list_filter([CASE WHEN (total_rows > 200 AND ba - ra > 0.05) OR total_rows > 10000 THEN 'retrain_model:high' END, CASE WHEN total_rows < 1000 THEN 'collect_more_data:medium' END],
 lambda s: s IS NOT NULL), '|') AS recommendations FROM fl""",
)(
    lambda spark, d: monitoring.monitoring_report(
        events(spark, d), F.col("ok"), at(NOW), alert_log=events(spark, d).where("event_type = 'error'")
    ).select(
        "total_predictions", F.col("recent_predictions").cast("bigint").alias("recent_predictions"), r6("avg_accuracy").alias("avg_accuracy"),
        "total_alerts", F.array_join("recommendations", "|").alias("recommendations"),
    )
)

# ---- logs

query(
    "log1_daily_stats",
    f"""WITH {EVENTS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_questions, round(avg(ok), 6) AS avg_confidence, count(DISTINCT user_id) AS unique_users,
 round(count(*) / count(DISTINCT user_id), 6) AS questions_per_user, CASE WHEN avg(ok) > 0.8 THEN 'Good' ELSE 'Needs Review' END AS health FROM ev GROUP BY 1""",
)(
    lambda spark, d: logs.daily_stats(events(spark, d), confidence="ok", good=0.8).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "total_questions", r6("avg_confidence").alias("avg_confidence"), "unique_users",
        r6("questions_per_user").alias("questions_per_user"), "health",
    )
)
query("log2_usage_totals", f"WITH {EVENTS} SELECT count(*) AS total_questions, round(avg(ok), 6) AS avg_confidence, count(DISTINCT user_id) AS unique_users FROM ev")(
    lambda spark, d: logs.usage_totals(events(spark, d), confidence="ok").withColumn("avg_confidence", r6("avg_confidence"))
)
CUT = "2024-01-23 00:00:00"
query(
    "log3_recent_stats",
    f"WITH {EVENTS} SELECT count(*) AS total_questions, round(avg(ok), 6) AS avg_confidence, round(avg(value), 6) AS avg_response_time FROM ev WHERE ts >= '{CUT}'",
)(
    lambda spark, d: logs.recent_stats(events(spark, d), CUT, confidence="ok", latency="value")
    .withColumn("avg_confidence", r6("avg_confidence"))
    .withColumn("avg_response_time", r6("avg_response_time"))
)
query("log3_recent_topics", f"SELECT event_type, count(*) AS n FROM events WHERE ts >= '{CUT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda spark, d: logs.recent_topics(events(spark, d), CUT, "event_type")
)
query(
    "log4_error_summary",
    f"""SELECT event_type AS error_type, count(*) AS total_24h, count_if(ts > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)::BIGINT AS recent_1h, max(ts) AS latest_ts,
 arg_max(props, event_id) AS latest_message FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR GROUP BY 1""",
)(
    lambda spark, d: logs.error_summary(events(spark, d), NOW, "event_type", message="props").select(
        F.col("event_type").alias("error_type"), "total_24h", "recent_1h", ntz("latest_ts"), "latest_message"
    )
)
query(
    "log5_error_burst",
    """SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end, event_type, count(*) AS error_count
 FROM events GROUP BY ALL HAVING count(*) > 1""",
)(
    lambda spark, d: logs.error_burst(events(spark, d), "event_type", more_than=1).select(
        ntz("window_start"), ntz("window_end"), "event_type", "error_count"
    )
)
query(
    "log6_rate_limit",
    """WITH r AS (SELECT event_id, user_id, ts, count(*) OVER w - 1 AS recent_requests, min(ts) OVER w AS oldest FROM events
   WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW))
 SELECT event_id, recent_requests, recent_requests >= 4 AS rejected, CASE WHEN recent_requests >= 4 THEN round(86400 - epoch_us(ts) / 1e6 + epoch_us(oldest) / 1e6, 3) END AS retry_after FROM r""",
)(
    lambda spark, d: logs.rate_limit(events(spark, d), limit=4, seconds=86_400, block_seconds=3 * 86_400).select(
        "event_id", "recent_requests", "rejected", F.round("retry_after", 3).alias("retry_after")
    )
)
query(
    "log7_latency_tracker",
    """WITH l AS (SELECT event_type, avg(value) AS ra FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 100 GROUP BY 1)
 SELECT e.event_type, count(*) AS call_count, round(sum(value), 4) AS total_time, round(avg(value), 6) AS avg_time, count_if(value > 5.0)::BIGINT AS slow_calls, round(any_value(ra), 6) AS recent_avg
 FROM events e JOIN l ON e.event_type = l.event_type GROUP BY 1""",
)(
    lambda spark, d: logs.latency_tracker(events(spark, d), "event_type", "value").select(
        "event_type", "call_count", F.round("total_time", 4).alias("total_time"), r6("avg_time").alias("avg_time"), "slow_calls",
        r6("recent_avg").alias("recent_avg"),
    )
)


def triaged(spark, d):
    return logs.triage(qa(spark, d), "question", TRIAGE_SEV, TRIAGE_CAT)


query("log8_triage_counts", f"WITH {QA}, {TRIAGE_SQL} SELECT triage_category, count(*) AS n FROM triage GROUP BY 1")(
    lambda spark, d: logs.triage_counts(triaged(spark, d))
)
query("log8_severe_cases", f"WITH {QA}, {TRIAGE_SQL} SELECT ord, triage_category FROM triage WHERE triage_severity = 'severe'")(
    lambda spark, d: logs.severe_cases(triaged(spark, d), "conv_id", "ord").select("ord", "triage_category")
)
query("log8_newest", f"WITH {QA}, {TRIAGE_SQL} SELECT ord, triage_category, next_action FROM triage ORDER BY ord DESC LIMIT 10")(
    lambda spark, d: triaged(spark, d).orderBy(F.desc("ord")).limit(10).select("ord", "triage_category", "next_action")
)
