"""Exact deduplication (DUP1, DUP2, DUP4, DUP5) and exclusion (JN1).

First wins: the row with the smallest ``ord``.  ``row_number() = 1`` is planned with a group limit
before the exchange, so a key that holds a large share of all rows is cut to one row per map task
before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.common import strip
from ..functions.text import text_hash
from .staging import compute, keep


def first_per_key(df: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """Drop rows without a key, keep the first row of every key."""
    w = W.partitionBy("_key").orderBy(order)
    return (
        keep(compute(df, {"_key": key}), F.col("_key").isNotNull())
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1)
        .drop("_key", "_rn")
    )


def dedupe_exact(df: DataFrame, column: str = "question", order: str = "ord") -> DataFrame:
    """DUP1: key = trimmed lower-cased text; blank dropped."""
    return first_per_key(df, F.nullif(F.lower(strip(F.col(column))), F.lit("")), order)


def dedupe_hash(df: DataFrame, column: str = "question", order: str = "ord") -> DataFrame:
    """DUP2: key = md5 of the whitespace-normalised text; blank dropped."""
    return first_per_key(df, text_hash(strip(F.col(column))), order)


def dedupe_raw(df: DataFrame, column: str = "question", order: str = "ord") -> DataFrame:
    """DUP5: raw equality."""
    return first_per_key(df, F.col(column), order)


def exclude_seen(df: DataFrame, seen: DataFrame, column: str = "question", seen_column: str = "question") -> DataFrame:
    """JN1: drop rows whose normalised text is in ``seen``.

    Only 16-byte digests of ``seen`` are shuffled, once each: duplicates are combined before the exchange.
    Blank text is kept here (it matches nothing).
    """
    keys = seen.select(text_hash(strip(F.col(seen_column))).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    return df.withColumn("_key", text_hash(strip(F.col(column)))).join(keys, "_key", "left_anti").drop("_key")


def dedupe_incremental(df: DataFrame, seen: DataFrame, column: str = "question", order: str = "ord") -> DataFrame:
    """DUP4: not seen in earlier batches, then first inside the batch."""
    return dedupe_hash(exclude_seen(df, seen, column, column), column, order)


def dedupe_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, rows kept, rows removed."""
    n = before.agg(F.count(F.lit(1)).alias("n"))
    k = after.agg(F.count(F.lit(1)).alias("k")).scalar()
    return n.select(F.col("n").alias("rows_in"), k.alias("rows_kept"), (F.col("n") - k).alias("rows_removed"))
