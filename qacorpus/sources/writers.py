"""Sinks (SNK1-SNK5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, stats: DataFrame | None = None, formats=("parquet", "json", "csv")) -> dict[str, str]:
    """SNK1: the data set in several formats plus its statistics.

    The plan runs once, into Parquet; the other formats are rewritten from that copy.
    """
    spark = df.sparkSession
    out = {"parquet": f"{path}/parquet"}
    df.write.mode("overwrite").parquet(out["parquet"])
    copy = spark.read.parquet(out["parquet"])
    for fmt in formats:
        if fmt == "json":
            out[fmt] = f"{path}/json"
            copy.write.mode("overwrite").json(out[fmt])
        elif fmt == "csv":
            out[fmt] = f"{path}/csv"
            flat = [
                F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in copy.dtypes
            ]
            copy.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(out[fmt])
    if stats is not None:
        out["stats"] = f"{path}/stats"
        stats.coalesce(1).write.mode("overwrite").json(out["stats"])
    return out


def write_splits(df: DataFrame, path: str, ratios: tuple[float, float, float]) -> DataFrame:
    """SNK2: one write partitioned by split; returns (and stores) the one-row summary."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits")
    counts = df.sparkSession.read.parquet(f"{path}/splits")
    s = F.col("split")
    summary = counts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "train").alias("train"),
        F.count_if(s == "val").alias("val"),
        F.count_if(s == "test").alias("test"),
    )
    for name, r in zip(("train", "val", "test"), ratios):
        summary = summary.withColumn(f"{name}_ratio", F.lit(float(r))).withColumn(
            f"{name}_path", F.lit(f"{path}/splits/split={name}")
        )
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return summary


def audit_rows(df: DataFrame, user: str = "user_id", sources: str = "sources") -> DataFrame:
    """Audit table layout: sources as JSON text."""
    as_json = F.to_json(sources) if dict(df.dtypes)[sources].startswith(("array", "struct", "map")) else F.col(sources)
    return df.select(
        F.coalesce(F.col(user).cast("string"), F.lit("anonymous")).alias("user_id"),
        "question", "answer", as_json.alias("sources"), F.col("processing_time").cast("double").alias("processing_time"),
        F.col("created_at").cast("timestamp").alias("created_at"),
    )


def audit_log(df: DataFrame, path: str) -> None:
    """SNK3: append interactions, partitioned by day."""
    audit_rows(df).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def prediction_log(df: DataFrame, path: str) -> None:
    """SNK4: append JSON lines, one folder per day."""
    df.withColumn("day", F.date_format("timestamp", "yyyyMMdd")).write.mode("append").partitionBy("day").json(path)


def alert_rows(alerts: DataFrame, model: str, now) -> DataFrame:
    pct = lambda c: F.concat(F.format_number(F.col(c) * 100, 2), F.lit("%"))
    message = F.concat(
        F.lit("changed by "), pct("change"), F.lit(" (from "), F.col("baseline").cast("string"), F.lit(" to "),
        F.col("recent").cast("string"), F.lit(")"),
    )
    return alerts.select(
        F.lit(now).cast("timestamp").alias("timestamp"), "type", message.alias("message"), F.lit(model).alias("model")
    )


def alert_log(alerts: DataFrame, path: str, model: str, now) -> None:
    """SNK5: append alert records."""
    alert_rows(alerts, model, now).write.mode("append").json(path)


def retrain_log(decision: DataFrame, path: str, model: str, now) -> None:
    """SNK5: append a retrain trigger when the decision asks for it."""
    decision.where("retrain").select(
        F.lit(now).cast("timestamp").alias("timestamp"), "reasons", F.lit(model).alias("model")
    ).write.mode("append").json(path)
