"""Prediction-log monitoring (MON1-MON6, WIN3-WIN5).

Log rows carry ``ts``, a unique ``event_id`` and numeric metrics.  First-n and last-n are heaps
(``orderBy.limit``), trailing windows are cut into blocks that overlap by the window length, and the
drift statistic works on counts per value, so one model or one day may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.score import exact_match
from .ordering import cumulative, ranked

# fixed values: alert limits
ACCURACY_DROP, LATENCY_INCREASE, ERROR_INCREASE = 0.05, 0.20, 0.10
BASE_ROWS, RETRAIN_ROWS, RETRAIN_DAYS, NEW_ROWS, FEW_ROWS = 100, 200, 30, 10_000, 1_000


def batch_metrics(df: DataFrame, prediction: str, truth: str, latency: str | None = None, error: Column | None = None) -> DataFrame:
    """MON1"""
    ok = exact_match(F.col(prediction), F.col(truth))
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("accuracy"),
        (F.coalesce(F.avg(latency), F.lit(0.0)) if latency else F.lit(0.0)).alias("avg_latency_ms"),
        (F.coalesce(F.avg(error.cast("double")), F.lit(0.0)) if error is not None else F.lit(0.0)).alias("error_rate"),
    )


def first_last(log: DataFrame, metrics: dict[str, Column], ts: str = "ts", tie: str = "event_id", n: int = BASE_ROWS) -> DataFrame:
    """WIN3: row count and the mean of each metric over the first and the last ``n`` rows; absent counts 0."""
    cols = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in metrics.items()]
    rows = log.select(ts, tie, *cols)

    def means(part: DataFrame) -> Column:
        return part.agg(F.struct(*[F.avg(k).alias(k) for k in metrics])).scalar()

    first = means(rows.orderBy(ts, tie).limit(n))
    last = means(rows.orderBy(F.desc(ts), F.desc(tie)).limit(n))
    out = log.agg(F.count(F.lit(1)).alias("total_rows"))
    for k in metrics:
        out = out.withColumn(f"baseline_{k}", first[k]).withColumn(f"recent_{k}", last[k])
    return out


def alerts(log: DataFrame, metrics: dict[str, Column], ts: str = "ts", tie: str = "event_id", n: int = BASE_ROWS) -> DataFrame:
    """MON2 / MON3: one row per exceeded limit.  ``metrics`` may hold accuracy, latency and error."""
    base = first_last(log, metrics, ts, tie, n)
    enough = F.col("total_rows") > n
    checks = []
    if "accuracy" in metrics:
        b, r = F.col("baseline_accuracy"), F.col("recent_accuracy")
        checks.append(("ACCURACY_DROP", b - r, b, r, F.lit(ACCURACY_DROP)))
    if "latency" in metrics:
        b, r = F.col("baseline_latency"), F.col("recent_latency")
        checks.append(("LATENCY_INCREASE", F.coalesce(F.try_divide(r - b, b), F.lit(0.0)), b, r, F.lit(LATENCY_INCREASE)))
    if "error" in metrics:
        b, r = F.col("baseline_error"), F.col("recent_error")
        checks.append(("ERROR_RATE_INCREASE", r - b, b, r, F.lit(ERROR_INCREASE)))
    rows = [
        F.when(
            enough & (change > limit),
            F.struct(F.lit(kind).alias("type"), b.alias("baseline"), r.alias("recent"), change.alias("change")),
        )
        for kind, change, b, r, limit in checks
    ]
    return base.select(F.inline(F.array_compact(F.array(*rows))))


def rolling_accuracy(
    log: DataFrame, metric: Column, model: str = "model", ts: str = "ts", tie: str = "event_id",
    rows: int = BASE_ROWS, block: int = 100_000,
) -> DataFrame:
    """WIN4: trailing mean over ``rows`` rows per model, one value per log row.

    Rows get a global rank in (model, time) order and are cut into blocks; the last ``rows - 1`` rows of a
    block are also given to the next one, so a model with most of the log is spread over many tasks.
    """
    block = max(block, rows)
    halo = rows - 1
    r = ranked(log.withColumn("_m", F.coalesce(metric.cast("double"), F.lit(0.0))), [F.col(model), F.col(ts), F.col(tie)], "_rank")
    pos, own = F.pmod(F.col("_rank") - 1, F.lit(block)), F.floor((F.col("_rank") - 1) / block)
    copies = F.when(pos >= block - halo, F.array(own, own + 1)).otherwise(F.array(own))
    spread = r.withColumn("_own", own).withColumn("_block", F.explode(copies))
    w = W.partitionBy("_block", model).orderBy("_rank").rowsBetween(-halo, 0)
    return (
        spread.withColumn("rolling_accuracy", F.avg("_m").over(w))
        .where(F.col("_block") == F.col("_own"))
        .drop("_m", "_rank", "_own", "_block")
    )


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """WIN5 / MON4: two-sample Kolmogorov-Smirnov D with sizes, means and the asymptotic p-value.

    Each sample is counted per distinct value before any shuffle; running totals come from buckets of values.
    With an empty sample the statistic, the p-value and that sample's mean are null.
    """
    def side(df: DataFrame, first: bool) -> DataFrame:
        counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        zero = F.lit(0).cast("bigint")
        return counts.select("v", (F.col("c") if first else zero).alias("a"), (zero if first else F.col("c")).alias("b"))

    counts = side(a, True).unionByName(side(b, False)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cum = cumulative(counts, "v", ["a", "b"])
    gap = F.abs(F.try_divide("upto_a", F.nullif("all_a", F.lit(0))) - F.try_divide("upto_b", F.nullif("all_b", F.lit(0))))
    d = cum.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_recent"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_reference"),
        F.max(gap).alias("statistic"),
        F.try_divide(F.sum(F.col("v") * F.col("a")), F.sum("a")).alias("recent_mean"),
        F.try_divide(F.sum(F.col("v") * F.col("b")), F.sum("b")).alias("reference_mean"),
    )
    lam2 = F.try_divide(F.col("statistic") * F.col("statistic") * F.col("n_recent") * F.col("n_reference"), F.col("n_recent") + F.col("n_reference"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * lam2),
    )
    # the alternating series does not settle for tiny lambda, where p is 1
    p = F.when(lam2 < F.lit(0.01), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) * series)))
    return d.withColumn("pvalue", F.when(F.col("statistic").isNotNull(), p))


def detect_drift(recent: DataFrame, reference: DataFrame, features: dict[str, Column], alpha: float = 0.05) -> DataFrame:
    """MON4: one row per named feature with D, p-value, means and whether it drifted."""
    out = None
    for name, col in features.items():
        one = ks_statistic(recent.select(col.alias("v")), reference.select(col.alias("v")), "v")
        one = one.select(F.lit(name).alias("feature"), "*", (F.col("pvalue") < alpha).alias("drifted"))
        out = one if out is None else out.unionByName(one)
    return out


def should_retrain(
    log: DataFrame, accuracy: Column, now, last_training=None, ts: str = "ts", tie: str = "event_id"
) -> DataFrame:
    """MON5: one row: whether to retrain and why."""
    base = first_last(log, {"accuracy": accuracy}, ts, tie)
    drop = F.col("baseline_accuracy") - F.col("recent_accuracy")
    days = F.lit(None).cast("int") if last_training is None else F.floor(
        (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.lit(last_training).cast("timestamp"))) / 86400
    ).cast("int")
    reasons = F.array_compact(
        F.array(
            F.when((F.col("total_rows") > RETRAIN_ROWS) & (drop > ACCURACY_DROP),
                   F.concat(F.lit("Accuracy dropped by "), F.format_number(drop * 100, 2), F.lit("%"))),
            F.when(days > RETRAIN_DAYS, F.concat(F.lit("Last training was "), days.cast("string"), F.lit(" days ago"))),
            F.when(F.col("total_rows") > NEW_ROWS,
                   F.concat(F.lit("Accumulated "), F.format_number("total_rows", 0), F.lit(" new samples"))),
        )
    )
    return base.withColumn("reasons", reasons).withColumn("retrain", F.size("reasons") > 0)


def monitoring_report(
    log: DataFrame, accuracy: Column, now, last_training=None, alert_log: DataFrame | None = None,
    ts: str = "ts", tie: str = "event_id",
) -> DataFrame:
    """MON6: totals, recent accuracy, alert count and recommendations."""
    base = should_retrain(log, accuracy, now, last_training, ts, tie)
    n_alerts = F.lit(0).cast("bigint") if alert_log is None else alert_log.agg(F.count(F.lit(1))).scalar()
    advice = F.array_compact(
        F.array(
            F.when(F.col("retrain"), "retrain_model:high"),
            F.when(F.col("total_rows") < FEW_ROWS, "collect_more_data:medium"),
        )
    )
    return base.select(
        F.col("total_rows").alias("total_predictions"),
        F.least(F.col("total_rows"), F.lit(BASE_ROWS)).alias("recent_predictions"),
        F.col("recent_accuracy").alias("avg_accuracy"),
        n_alerts.alias("total_alerts"),
        advice.alias("recommendations"),
        "reasons",
    )
