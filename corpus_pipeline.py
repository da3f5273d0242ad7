"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, pieces.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns a DataFrame; all but the last
return the columns of ``documents``.  A stage that judges rows gives each of them a number of its own in a written table, so null ids
and ids on several rows are no matter: every row is judged by itself.  Ties between rows of one id go by that number.

A stage begins when its predecessor's rows are written, so what that one had staged on the way is deleted then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qacorpus.llm.base import discard, scratch, staged, table
from qacorpus.llm.decontaminate import contamination, is_contaminated
from qacorpus.llm.exact_dedup import exact_groups
from qacorpus.llm.language_id import identify, query_model
from qacorpus.llm.merge_dropout import encode_rows
from qacorpus.llm.minhash_dedup import near_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_done: list[scratch] = []


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _done:
            before = _done.pop()
            if all(df.sparkSession.sparkContext is spark.sparkContext for df in before.frames):
                before.clear()
        with scratch() as here:
            out = fn(spark, docs, sf_dir)
        _done.append(here)
        return out

    return run_stage


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with ``_row``, a number of their own; written once, so that it stays."""
    return staged(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, also where there is no label to learn a language from."""
    named = identify(docs, query_model(docs), COLUMNS)
    return named.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")).select(*COLUMNS)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays (null before all ids)."""
    rows = _numbered(docs)
    judged = exact_groups(rows.select(F.struct("doc_id", "_row").alias("key"), "text"), "key")
    gone = staged(judged.where("not kept").select("id._row"), "gone")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id stays (null behind all ids)."""
    rows = _numbered(docs)
    judged = near_groups(rows, "_row").select(F.col("id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = judged.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(staged(first.select("first._row"), "kept"), "_row", "left_semi").select(*COLUMNS)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words from benchmark items go."""
    rows = _numbered(docs)
    found = contamination(rows, table(spark, sf_dir, "benchmark"), "_row")
    gone = staged(found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("id").alias("_row")), "gone")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


@_stage
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as pieces, checked to decode to the text."""
    return encode_rows(docs).select("doc_id", "lang", "source", "pieces", "n_pieces", "lossless")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("merge_dropout_pieces", pieces),
]
#: Language ID and merge-dropout can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
