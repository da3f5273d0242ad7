"""Log analytics (LOG1-LOG8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.common import moment
from ..functions.classify import triage_action, triage_category, triage_severity


def daily_stats(log: DataFrame, ts: str = "ts", user: str = "user_id", confidence: str = "confidence", good: float = 0.7) -> DataFrame:
    """LOG1: per day; distinct users are counted in two steps (day and user first), so a hot day spreads."""
    return (
        log.groupBy(F.to_date(ts).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("total_questions"),
            F.avg(confidence).alias("avg_confidence"),
            F.count_distinct(user).alias("unique_users"),
        )
        .withColumn("questions_per_user", F.col("total_questions") / F.greatest("unique_users", F.lit(1)))
        .withColumn("health", F.when(F.col("avg_confidence") > good, "Good").otherwise("Needs Review"))
    )


def usage_totals(log: DataFrame, user: str = "user_id", confidence: str = "confidence") -> DataFrame:
    """LOG2"""
    return log.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.avg(confidence).alias("avg_confidence"),
        F.count_distinct(user).alias("unique_users"),
    )


def recent_stats(log: DataFrame, cutoff, ts: str = "ts", confidence: str = "confidence", latency: str = "response_time") -> DataFrame:
    """LOG3"""
    return log.where(F.col(ts) >= moment(log, ts, cutoff)).agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.avg(confidence).alias("avg_confidence"),
        F.avg(latency).alias("avg_response_time"),
    )


def recent_topics(log: DataFrame, cutoff, topic: str, ts: str = "ts", k: int = 10) -> DataFrame:
    """LOG3: most frequent topics since the cutoff."""
    return (
        log.where(F.col(ts) >= moment(log, ts, cutoff)).groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), topic).limit(k)
    )


def error_summary(errors: DataFrame, now, kind: str = "error_type", ts: str = "ts", tie: str = "event_id", message: str = "message") -> DataFrame:
    """LOG4: per error type of the last 24 hours: count, last-hour count, latest record."""
    at = moment(errors, ts, now)
    day = errors.where(F.col(ts) > at - F.expr("INTERVAL 24 HOURS"))
    return day.groupBy(kind).agg(
        F.count(F.lit(1)).alias("total_24h"),
        F.count_if(F.col(ts) > at - F.expr("INTERVAL 1 HOUR")).alias("recent_1h"),
        F.max(ts).alias("latest_ts"),
        F.max_by(message, F.struct(ts, tie)).alias("latest_message"),
    )


def error_burst(errors: DataFrame, kind: str = "error_type", ts: str = "ts", minutes: int = 10, more_than: int = 5, slide: int | None = None) -> DataFrame:
    """LOG5: windows (every ``slide`` minutes if given) with more errors of a type than allowed.  Works on batch and (watermarked) streams."""
    w = F.window(ts, f"{minutes} minutes", f"{slide} minutes" if slide else None)
    return (
        errors.groupBy(w.alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("error_count"))
        .where(F.col("error_count") > more_than)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "error_count")
    )


def rate_limit(
    requests: DataFrame, user: str = "user_id", ts: str = "ts", limit: int = 100, seconds: int = 60, block_seconds: int | None = None
) -> DataFrame:
    """LOG6: earlier requests of the user in the trailing window, rejection and seconds to wait.

    A user's requests are cut into time blocks; those within a window's length of a block's end are also
    given to the next block.  A user with a large share of all requests becomes many tasks.
    """
    span = seconds * 1_000_000
    block = max(block_seconds or 60 * seconds, seconds) * 1_000_000
    t = requests.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    own = F.floor(F.col("_t") / block)
    late = F.pmod(F.col("_t"), F.lit(block)) >= block - span
    spread = t.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    # strictly younger than the window, the request itself included
    w = W.partitionBy(user, "_block").orderBy("_t").rangeBetween(-(span - 1), 0)
    out = spread.withColumn("recent_requests", F.count(F.lit(1)).over(w) - 1).withColumn("_oldest", F.min("_t").over(w))
    out = out.where(F.col("_block") == F.col("_own"))
    rejected = F.col("recent_requests") >= limit
    wait = (F.lit(span) - (F.col("_t") - F.col("_oldest"))) / F.lit(1_000_000.0)
    return (
        out.withColumn("rejected", rejected).withColumn("retry_after", F.when(rejected, wait))
        .drop("_t", "_own", "_block", "_oldest")
    )


def latency_tracker(log: DataFrame, function: str = "function", duration: str = "duration", ts: str = "ts",
                    tie: str = "event_id", recent: int = 100, slow: float = 5.0) -> DataFrame:
    """LOG7: per function: calls, total, mean, mean of the last 100, slow calls.

    The last-100 list is cut by a group limit before its exchange; totals are combined map-side.
    """
    totals = log.groupBy(function).agg(
        F.count(F.lit(1)).alias("call_count"),
        F.sum(duration).alias("total_time"),
        F.avg(duration).alias("avg_time"),
        F.count_if(F.col(duration) > slow).alias("slow_calls"),
    )
    pos = F.row_number().over(W.partitionBy(function).orderBy(F.desc(ts), F.desc(tie)))
    last = log.withColumn("_p", pos).where(F.col("_p") <= recent).groupBy(function).agg(F.avg(duration).alias("recent_avg"))
    last = last.withColumnRenamed(function, "_function")
    return totals.join(last, F.col(function).eqNullSafe(F.col("_function")), "left").drop("_function")


def triage(df: DataFrame, text: str = "question", severities: dict | None = None, categories: dict | None = None) -> DataFrame:
    """CLS10 as columns."""
    low = df.withColumn("_low", F.lower(text))
    return (
        low.withColumn("triage_severity", triage_severity(F.col("_low"), severities))
        .withColumn("triage_category", triage_category(F.col("_low"), categories))
        .withColumn("next_action", triage_action(F.col("triage_severity"), F.col("triage_category")))
        .drop("_low")
    )


def triage_counts(df: DataFrame) -> DataFrame:
    """LOG8: rows per category."""
    return df.groupBy("triage_category").agg(F.count(F.lit(1)).alias("n"))


def severe_cases(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """LOG8: severe rows, newest first."""
    return df.where(F.col("triage_severity") == "severe").orderBy(F.desc(ts), F.desc(tie))
