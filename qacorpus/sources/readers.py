"""Sources (SRC1, SRC2, SRC4, SRC5)."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.common import first_filled
from ..operators.ordering import first_n
from ..schema import ENVELOPE, RAW_ROW

_ROW_BITS = 33


def with_fallbacks(df: DataFrame) -> DataFrame:
    """Question and answer from the first filled alternative field; an empty string counts as missing."""
    def pick(names: tuple[str, ...]) -> Column:
        return first_filled(*[F.col(n) for n in names if n in df.columns])

    return df.withColumn("question", pick(("question", "input", "prompt", "text"))).withColumn(
        "answer", pick(("answer", "output", "response", "target"))
    )


def corpus_files(spark: SparkSession, folder: str, combined: str = "medical_datasets_combined_*") -> list[str]:
    """Newest combined file first, then every other JSON file by name; each file once."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    found = listing.select("path", "modificationTime").collect()  # file names only, contents are not read
    is_combined = [r for r in found if fnmatch.fnmatch(r["path"].rsplit("/", 1)[-1], combined)]
    newest = sorted(is_combined, key=lambda r: r["modificationTime"])[-1:]
    taken = {r["path"] for r in is_combined}
    return [r["path"] for r in newest] + sorted(r["path"] for r in found if r["path"] not in taken)


def read_corpus(spark: SparkSession, folder: str, combined: str = "medical_datasets_combined_*") -> DataFrame:
    """SRC1: rows of all corpus files with ``ord`` (file order, then row order) and ``file_name``.

    ``ord`` is fixed while a file is read, before any shuffle.  A JSON array file is one task; for large
    corpora keep many files or write them once as Parquet.
    """
    files = corpus_files(spark, folder, combined)
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).json(files).select("*", "_metadata.file_name")
    lists = F.coalesce("data", "entries", "questions")
    # a combined file is an array or holds its rows in data / entries only
    is_combined = F.col("file_name").like(combined.replace("_", "\\_").replace("*", "%"))
    nested = F.when(is_combined, F.coalesce("data", "entries")).otherwise(lists)
    itself = F.struct(*[F.col(f) for f in RAW_ROW.fieldNames()])
    filled = F.coalesce(*[F.col(f).cast("string") for f in RAW_ROW.fieldNames()]).isNotNull()
    rows = raw.select(
        "file_name",
        F.explode(F.coalesce(nested, F.when(filled, F.array(itself)), F.array().cast(nested_type()))).alias("r"),
    )
    idx = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    rows = rows.select("file_name", "r.*").withColumn("_i", idx)
    ranks = spark.createDataFrame(
        [(p.rsplit("/", 1)[-1], i) for i, p in enumerate(files)], "file_name string, _rank bigint"
    )
    return (
        rows.join(ranks, "file_name")
        .withColumn("ord", F.shiftleft("_rank", _ROW_BITS) + F.col("_i"))
        .drop("_rank", "_i")
    )


def nested_type() -> str:
    return f"array<{RAW_ROW.simpleString()}>"


def from_medqa(df: DataFrame) -> DataFrame:
    """SRC2: question, answer array<string>, split."""
    return df.select(
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce(F.get("answer", 0), F.lit("")).alias("answer"),
        F.lit("MedQA").alias("source"), "split", F.lit("medical_qa").alias("type"),
    )


def from_pubmedqa(df: DataFrame) -> DataFrame:
    """SRC2: question, final_decision, context struct<contexts array<string>>."""
    return df.select(
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("final_decision", F.lit("")).alias("answer"),
        F.coalesce(F.array_join("context.contexts", " "), F.lit("")).alias("context"),
        F.lit("PubMedQA").alias("source"), F.lit("biomedical_qa").alias("type"),
    )


def from_medmcqa(df: DataFrame) -> DataFrame:
    """SRC2: question, opa..opd, cop (0-based; negative counts from the end), subject_name, exp, split."""
    options = F.array("opa", "opb", "opc", "opd")
    cop = F.col("cop").cast("int")
    chosen = F.get(options, F.when(cop < 0, cop + 4).otherwise(cop))
    return df.select(
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce(chosen, F.lit("")).alias("answer"),
        options.alias("options"),
        F.coalesce("subject_name", F.lit("")).alias("subject"),
        F.coalesce("exp", F.lit("")).alias("explanation"),
        F.lit("MedMCQA").alias("source"), "split", F.lit("medical_mcq").alias("type"),
    )


def from_chatdoctor(df: DataFrame) -> DataFrame:
    """SRC2: input, output, instruction."""
    return df.select(
        F.coalesce("input", F.lit("")).alias("question"),
        F.coalesce("output", F.lit("")).alias("answer"),
        F.coalesce("instruction", F.lit("")).alias("instruction"),
        F.lit("ChatDoctor").alias("source"), F.lit("medical_conversation").alias("type"),
    )


def max_records(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """SRC4: first ``n`` rows of the load order."""
    return first_n(df, [(order, False)], n)


def qa_pairs(conversations: DataFrame, turn_bits: int = 24, block: int = 1_024) -> DataFrame:
    """SRC5: every user turn whose next turn, whatever its number, is the assistant's, with that turn as the answer.

    Turns are ordered inside blocks of ``block`` turn numbers, and the last turn of a block takes the first one of the conversation's
    next block from a table of one row per block: one very long conversation is many tasks, never one.  Turns of equal
    number follow each other by role and text; rows without a conversation or turn are in no pair.

    ``ord`` packs (conversation, turn) into one number; values that don't fit are an error, never a number that another row has.
    Give fewer ``turn_bits`` for larger conversation ids, or number the conversations first.
    """
    rows = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "role", "text")
    rows = rows.withColumns({"_block": F.floor(F.col("turn") / block).cast("bigint"), "_turn": F.struct("turn", "role", "text")})
    inside = W.partitionBy("conv_id", "_block").orderBy("_turn")
    heads = rows.groupBy("conv_id", "_block").agg(F.min("_turn").alias("_head"))
    heads = heads.select("conv_id", "_block", F.lead("_head").over(W.partitionBy("conv_id").orderBy("_block")).alias("_after"))
    follows = rows.withColumn("_next", F.lead("_turn").over(inside)).where("role = 'user'").join(heads, ["conv_id", "_block"], "left")
    reply = F.coalesce("_next", "_after")
    most = 1 << (63 - turn_bits)
    fits = F.col("conv_id").between(-most, most - 1) & F.col("turn").between(0, (1 << turn_bits) - 1)
    return follows.where(reply["role"] == "assistant").select(
        F.when(fits, F.shiftleft("conv_id", turn_bits) + F.col("turn")).otherwise(F.raise_error(F.lit("conversation or turn too large for ord"))).alias("ord"),
        "conv_id", "turn",
        F.col("text").alias("question"), reply["text"].alias("answer"),
    )
