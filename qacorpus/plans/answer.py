"""Batch question answering: alert rules, retrieval, template, audit row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import emergency_message, emergency_rule
from ..functions.common import strip
from ..lexicon import MEDICAL, Profile
from ..operators.retrieval import answer_template, snippets, source_refs, vector_topk


def valid_requests(requests: DataFrame, question: str = "question", user: str = "user_id") -> DataFrame:
    """STR7: trimmed, non-empty questions; missing user becomes ``anonymous``.  Batch or stream."""
    cleaned = requests.withColumn(question, strip(F.col(question))).where(F.coalesce(question, F.lit("")) != "")
    name = F.nullif(F.col(user).cast("string"), F.lit(""))
    return cleaned.withColumn(user, F.coalesce(name, F.lit("anonymous")))


def answer_questions(questions: DataFrame, docs: DataFrame, profile: Profile = MEDICAL, k: int = 3, shown: int = 2) -> DataFrame:
    """One answer per question (query_id, user_id, question, disease, embedding).

    Alert rules read the question only, never retrieved text.
    """
    top = vector_topk(questions, docs, k)
    content = docs.select("doc_id", "content", "topic", "category")
    ranked = top.join(content, "doc_id")
    refs = source_refs(ranked.where(F.col("rank") <= shown))
    item = F.struct("rank", "topic", "category", "excerpt")
    sources = refs.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("sources"))
    joined = questions.drop("embedding").join(snippets(ranked), "query_id", "left").join(sources, "query_id", "left")
    staged = joined.withColumn("_low", F.lower("question")).withColumn("alert_type", emergency_rule(F.col("_low"), profile)).drop("_low")
    return staged.withColumn(
        "answer",
        F.coalesce(emergency_message(F.col("alert_type"), profile), answer_template(F.col("disease"), F.col("snippet"))),
    )
