"""Exact duplicates by progressive refinement: length, then a hash of the first characters, then the full hash.

Each level keeps only groups of two rows or more, and only rows of groups that outlive the prefix level have their whole text
hashed.  DataFrame operations only.

Rows are compared after lower-casing A-Z; null text counts as empty.  Any other column may be null, ids may repeat (a repeated
row is one more copy) and further columns of the input don't matter: only the two named ones are read.  A null id is never the
id of the row that stays unless all ids of its group are null.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import lower_ascii, query, staged, table

#: Characters of the second level.
PREFIX_CHARS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id, full_hash, group_size, keep_id, kept``.

    ``keep_id`` is the largest id of the group.  ``full_hash`` (SHA-256 of the normalised text, hex) is null for rows that an
    earlier level found to be alone, unless ``digest_all`` asks for it.  Counts are combined before the shuffle, and the two
    joins are plain equi-joins between written tables, so that adaptive execution splits a hot group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("length"),
        F.xxhash64(lower_ascii(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"),
    )
    by_prefix = staged(rows.groupBy("length", "prefix").agg(F.count("*").alias("n")), "prefix")
    lengths = by_prefix.groupBy("length").agg(F.sum("n").alias("n")).where("n > 1").select("length")
    shared = staged(
        by_prefix.where("n > 1").join(lengths, "length", "left_semi").select("length", "prefix", F.lit(True).alias("shared")), "shared"
    )
    full = F.sha2(lower_ascii(F.col("text")), 256)
    hashed = staged(
        rows.join(shared, ["length", "prefix"], "left")
        .select("id", F.coalesce("shared", F.lit(False)).alias("shared"), (full if digest_all else F.when(F.col("shared"), full)).alias("full_hash")),
        "hashed",
    )
    groups = staged(
        hashed.where("shared").groupBy("full_hash").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id")).where("group_size > 1"),
        "groups",
    )
    columns = ["id", "full_hash", "group_size", "keep_id"]
    # rows found to be alone have no hash to join on: one null key would hold nearly all rows
    alone = hashed.where("full_hash is null").select("id", "full_hash", F.lit(None).cast("long").alias("group_size"), F.lit(None).cast(hashed.schema["id"].dataType).alias("keep_id"))
    out = hashed.where("full_hash is not null").join(groups, "full_hash", "left").select(*columns).union(alone)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        "id", "full_hash", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.alias("keep_id"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
    )


SQL = """
WITH h AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)
"""


@query("op6_exact_dedup", SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))
