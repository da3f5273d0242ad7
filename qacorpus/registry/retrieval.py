"""RET1-RET5, JN4, WIN1, WIN2, the answering plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from ..plans.answer import answer_questions, valid_requests
from .base import FIXTURE, QA, events, lit, ntz, qa, query, r6, s_strip, s_words, table
from .texts import pick_sql, rules_sql

# the query side of the vector search: one mean vector per label
CENTRES = """ctr AS (SELECT label AS query_id, list(v ORDER BY i) AS embedding FROM (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"""


def centres(spark, d):
    dims = 64
    e = table(spark, d, "embeddings")
    means = [F.avg(F.element_at("embedding", i + 1).cast("double")) for i in range(dims)]
    return e.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.array(*means).alias("embedding"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def topk_sql(distance, k):
    return f"""WITH {CENTRES}, p AS (SELECT query_id, vec_id AS doc_id, {distance} AS distance FROM ctr, embeddings e)
 SELECT query_id, doc_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INTEGER AS rank
 FROM p QUALIFY rank <= {k}"""


L2 = "list_sum(list_transform(range(1, 65), lambda i: (ctr.embedding[i] - e.embedding[i]::DOUBLE) * (ctr.embedding[i] - e.embedding[i]::DOUBLE)))"
COS = "1 - list_cosine_similarity(ctr.embedding, e.embedding::DOUBLE[])"
query("ret1_vector_topk", topk_sql(L2, 3))(
    lambda spark, d: retrieval.vector_topk(centres(spark, d), vectors(spark, d), 3).withColumn("distance", r6("distance"))
)
query("ret1_vector_topk_cosine", topk_sql(COS, 3))(
    lambda spark, d: retrieval.vector_topk(centres(spark, d), vectors(spark, d), 3, "cosine").withColumn("distance", r6("distance"))
)
query(
    "jn4_all_neighbours",
    """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS distance
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
 SELECT query_id, doc_id, round(distance, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) <= 2""",
)(lambda spark, d: _all_neighbours(spark, d))


def _all_neighbours(spark, d):
    v = vectors(spark, d)
    top = retrieval.vector_topk(v.withColumnRenamed("doc_id", "query_id"), v, 2, exclude_self=True)
    return top.select("query_id", "doc_id", r6("distance").alias("distance"))


query(
    "ret2_source_refs",
    "SELECT doc_id, coalesce(source, 'unknown') AS topic, CASE WHEN lang = 'es' THEN 'general' ELSE lang END AS category, left(text, 200) || '...' AS excerpt FROM documents",
)(
    lambda spark, d: retrieval.source_refs(
        table(spark, d, "documents").select(
            "doc_id", F.col("text").alias("content"), F.col("source").alias("topic"),
            F.when(F.col("lang") != "es", F.col("lang")).alias("category"),
        )
    ).select("doc_id", "topic", "category", "excerpt")
)
# documents of a source, in id order, stand for a ranked result list of three
RANKED = "rk AS (SELECT source AS query_id, doc_id, text AS content, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS rank FROM documents QUALIFY rank <= 3)"
LINES = f"list_filter(string_split(content, chr(10)), lambda s: {s_strip('s')} <> '' AND length(s) > 20 AND NOT ends_with(s, ':'))"
SNIPPET = f"""{RANKED}, ln AS (SELECT query_id, rank, CASE WHEN contains(content, 'Question:') OR contains(content, 'Answer:') THEN []
  ELSE list_transform({LINES}, lambda s: {s_strip('s')})[1:3] END AS l FROM rk),
 fl AS (SELECT query_id, array_to_string(flatten(list(l ORDER BY rank))[1:2], ' ') AS t FROM ln GROUP BY 1),
 snip AS (SELECT query_id, CASE WHEN length(t) > 300 THEN left(t, 297) || '...' ELSE t END AS snippet FROM fl)"""


def ranked_docs(spark, d):
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", F.col("text").alias("content"))
    return docs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id"))).where(F.col("rank") <= 3)


query("ret3_snippet", f"WITH {SNIPPET} SELECT * FROM snip")(lambda spark, d: retrieval.snippets(ranked_docs(spark, d)))
query(
    "ret4_keyword_search",
    f"""WITH {QA}, k AS (SELECT DISTINCT item_id AS id, unnest({s_words("lower(replace(text, ',', ' '))")}) AS keyword FROM benchmark),
 w AS (SELECT ord AS query_id, unnest(list_distinct(string_split_regex(lower({s_strip('question')}), '\\s+'))) AS keyword FROM qa)
 SELECT query_id, id, count(*) AS n_keywords FROM w JOIN k USING (keyword) GROUP BY ALL""",
)(
    lambda spark, d: retrieval.keyword_search(
        qa(spark, d).select(F.col("ord").alias("query_id"), F.col("question").alias("query")),
        table(spark, d, "benchmark").select(
            F.col("item_id").alias("id"), F.regexp_replace(F.regexp_replace("text", "[,]", " "), r"\s+", ",").alias("keywords")
        ),
    )
)
TITLE = r"array_to_string(list_transform(regexp_extract_all(replace(name, '_', ' '), '\p{L}+|\P{L}+'), lambda s: upper(s[1]) || lower(s[2:])), '')"
query(
    "ret5_answer_template",
    f"""WITH {SNIPPET}, n AS (SELECT *, CASE WHEN query_id = 'src0' THEN '' ELSE query_id || '_disease' END AS name FROM snip)
 SELECT query_id, CASE WHEN name = '' THEN {lit(retrieval.CLARIFY)} ELSE 'Based on your symptoms, you likely have **' || {TITLE} || '**.' || chr(10)
 || CASE WHEN snippet <> '' THEN chr(10) || '**About this condition:**' || chr(10) || snippet || chr(10) ELSE '' END || {lit(retrieval.RECOMMEND)} END AS answer FROM n""",
)(
    lambda spark, d: retrieval.snippets(ranked_docs(spark, d))
    .withColumn("name", F.when(F.col("query_id") == "src0", "").otherwise(F.concat("query_id", F.lit("_disease"))))
    .select("query_id", retrieval.answer_template(F.col("name"), F.col("snippet")).alias("answer"))
)
query(
    "win1_recent_history",
    "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS recency FROM events QUALIFY recency <= 5",
)(lambda spark, d: retrieval.recent_history(events(spark, d)).select("user_id", "event_id", ntz("ts"), "recency"))
query(
    "win2_context_string",
    f"""WITH {QA}, r AS (SELECT conv_id, question, answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rc FROM qa QUALIFY rc <= 3)
 SELECT conv_id, string_agg('User: ' || question || chr(10) || 'Assistant: ' || left(answer, 100) || '...', chr(10) ORDER BY rc DESC) AS context FROM r GROUP BY 1""",
)(lambda spark, d: retrieval.context_strings(qa(spark, d), "conv_id", "turn", "ord"))
query(
    "str7_valid_requests",
    f"""SELECT conv_id, turn, {s_strip('t')} AS question, coalesce(nullif(u, ''), 'anonymous') AS user_id
 FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '   ' ELSE ' ' || text || chr(10) END AS t, CASE WHEN role = 'user' THEN conv_id::VARCHAR ELSE '' END AS u FROM conversations)
 WHERE {s_strip('t')} <> ''""",
)(
    lambda spark, d: valid_requests(
        table(spark, d, "conversations").select(
            "conv_id", "turn",
            F.when(F.col("role") == "system", "   ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("question"),
            F.when(F.col("role") == "user", F.col("conv_id").cast("string")).otherwise("").alias("user_id"),
        )
    )
)
# answering: label centres ask, the nearest vectors are the documents of the same id
query(
    "plan_answer_questions",
    f"""WITH {CENTRES}, p AS (SELECT query_id, vec_id AS doc_id, {L2} AS distance FROM ctr, embeddings e JOIN documents dd ON dd.doc_id = vec_id),
 top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p QUALIFY rank <= 3),
 rk AS (SELECT query_id, rank, text AS content FROM top JOIN documents USING (doc_id)),
 ln AS (SELECT query_id, rank, CASE WHEN contains(content, 'Question:') OR contains(content, 'Answer:') THEN []
  ELSE list_transform({LINES}, lambda s: {s_strip('s')})[1:3] END AS l FROM rk),
 fl AS (SELECT query_id, array_to_string(flatten(list(l ORDER BY rank))[1:2], ' ') AS t FROM ln GROUP BY 1),
 snip AS (SELECT query_id, CASE WHEN length(t) > 300 THEN left(t, 297) || '...' ELSE t END AS snippet FROM fl),
 qs AS (SELECT query_id, text AS question, lower(text) AS low, source || '_x' AS name FROM ctr JOIN documents ON doc_id = query_id),
 al AS (SELECT qs.*, snippet, {rules_sql('low')} AS k FROM qs LEFT JOIN snip USING (query_id))
 SELECT query_id, k AS alert_type, coalesce({pick_sql('k', FIXTURE.alert_messages)}, 'Based on your symptoms, you likely have **' || {TITLE} || '**.' || chr(10)
 || CASE WHEN coalesce(snippet, '') <> '' THEN chr(10) || '**About this condition:**' || chr(10) || snippet || chr(10) ELSE '' END || {lit(retrieval.RECOMMEND)}) AS answer FROM al""",
)(lambda spark, d: _answers(spark, d))


def _answers(spark, d):
    docs = table(spark, d, "documents")
    base = vectors(spark, d).join(docs.select("doc_id", F.col("text").alias("content"), F.col("source").alias("topic"), F.col("lang").alias("category")), "doc_id")
    asks = centres(spark, d).join(
        docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"), F.concat("source", F.lit("_x")).alias("disease")), "query_id"
    )
    return answer_questions(asks, base, FIXTURE).select("query_id", "alert_type", "answer")


