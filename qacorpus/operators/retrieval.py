"""Vector and keyword retrieval, memory of recent exchanges (RET1-RET5, JN4, WIN1, WIN2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.common import strip
from ..functions.text import title_name
from ..lexicon import CLARIFY, LIKELY, RECOMMEND

# A block of queries is at most this many floats (about 64 MB as float64), whatever the query count.
QUERY_BLOCK_FLOATS = 8_000_000


def _block_topk(k: int, metric: str):
    """Top-k of one (query block, document batch) pair by exact distance; matrix work in numpy."""

    def distances(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None, :]
            return 1.0 - (q @ d.T) / np.where(norms == 0.0, 1.0, norms)
        sq = (-2.0 * q) @ d.T
        sq += (q * q).sum(1)[:, None]
        sq += (d * d).sum(1)[None, :]
        return np.maximum(sq, 0.0, out=sq)

    def best(q_ids, q, d_ids, d, bound=None):
        """``bound``: distances that a query's k nearest don't exceed, where they are known."""
        dist = distances(q, d)
        keep = min(k, len(d_ids))
        if bound is not None:
            rows, cols = np.nonzero(dist <= bound[:, None] + 1e-9)
        elif keep < len(d_ids):
            # everything up to the k-th distance (a little slack keeps equal distances together)
            kth = np.partition(dist, keep - 1, axis=1)[:, keep - 1 : keep]
            rows, cols = np.nonzero(dist <= kth + 1e-9)
        else:
            rows, cols = np.nonzero(np.ones_like(dist, bool))
        part = pd.DataFrame({"q": rows, "doc_id": np.asarray(d_ids)[cols], "c": cols})
        # exact distance for the few that remain, summed per pair
        diff = q[rows] - d[cols]
        if metric == "cosine":
            part["distance"] = dist[rows, cols]
        else:
            part["distance"] = np.einsum("ij,ij->i", diff, diff)
        part = part.sort_values(["q", "distance", "doc_id"]).groupby("q", sort=False).head(k)
        part["query_id"] = np.asarray(q_ids)[part["q"].to_numpy()]
        return part[["q", "query_id", "doc_id", "distance"]]

    return best


def vector_topk(
    queries: DataFrame, docs: DataFrame, k: int = 3, metric: str = "l2", query_id: str = "query_id",
    doc_id: str = "doc_id", vector: str = "embedding", exclude_self: bool = False,
    block_floats: int = QUERY_BLOCK_FLOATS,
) -> DataFrame:
    """RET1 / JN4: the k nearest documents per query, exact, ties by document id.

    A query table that fits one block (its size is counted first) travels to the tasks and the documents
    stay where they are.  A larger one is cut into blocks; every block meets every bounded part of the
    documents in a task of its own, and nothing passes through the driver.  Either way two blocks meet as
    a matrix product and only k rows per query leave a task.  All pairs are looked at, so beyond some blocks copies of rows grow
    with the square of the rows, divided by the rows of a block.

    Rows without a vector are in no result; vectors of different widths are an error.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(vector).alias("embedding")).where(F.col("embedding").isNotNull())
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).alias("embedding")).where(F.col("embedding").isNotNull())
    first = q.select(F.size("embedding").alias("n")).first()
    dims = max(1, first["n"] if first else 1)
    per_block = max(1, block_floats // dims)
    count = q.limit(per_block + 1).count()
    best = _block_topk(k + int(exclude_self), metric)
    schema = "query_id bigint, doc_id bigint, distance double"
    if count <= per_block:
        out = _scan_with_broadcast(q, d, best, schema, k + int(exclude_self))
    else:
        out = _block_by_block(q, d, best, schema, per_block, k + int(exclude_self))
    if exclude_self:
        out = out.where(F.col("query_id") != F.col("doc_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _first_k(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "distance", "doc_id"]).groupby("query_id", sort=False).head(k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _scan_with_broadcast(q: DataFrame, d: DataFrame, best, schema: str, k: int) -> DataFrame:
    pdf = q.toPandas()  # at most one block
    vectors = _matrix(pdf["embedding"]) if len(pdf) else np.zeros((0, 1))
    shared = q.sparkSession.sparkContext.broadcast((pdf["query_id"].to_numpy(), vectors))

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_vecs = shared.value
        step = max(1, 4_000_000 // max(1, len(q_ids)))  # bounds the distance matrix
        so_far = None
        for batch in it:
            for i in range(0, len(batch) if len(q_ids) else 0, step):
                piece = batch.iloc[i : i + step]
                found = best(q_ids, q_vecs, piece["doc_id"].to_numpy(), _matrix(piece["embedding"]))[["query_id", "doc_id", "distance"]]
                so_far = found if so_far is None else _first_k(pd.concat([so_far, found]), k)
        if so_far is not None:
            yield so_far

    return d.mapInPandas(scan, schema)


def _grid(rows: int, per_block: int, cores: int) -> int:
    """Blocks that a side is cut into: enough for three pairs of blocks a core, and none above ``per_block`` rows."""
    return max(1, -(-rows // per_block), min(math.ceil(math.sqrt(3 * cores)), -(-rows // 2_000)))


def _block_by_block(q: DataFrame, d: DataFrame, best, schema: str, per_block: int, k: int) -> DataFrame:
    """Every row is copied once for each block of the other side, so blocks are as large as a task may hold."""
    cores = q.sparkSession.sparkContext.defaultParallelism
    blocks, parts = _grid(q.count(), per_block, cores), _grid(d.count(), per_block, cores)
    every_part, every_block = F.sequence(F.lit(0), F.lit(parts - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    left = q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("p", F.explode(every_part))
    right = d.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("b", F.explode(every_block))

    def meet(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ds.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        q_ids, q_vecs, d_ids, d_vecs = qs["query_id"].to_numpy(), _matrix(qs["embedding"]), ds["doc_id"].to_numpy(), _matrix(ds["embedding"])
        out = []
        for i in range(0, len(q_ids), 500):
            ids, vecs = q_ids[i : i + 500], q_vecs[i : i + 500]
            # the first documents bound what is looked at in the others
            found, bound = [best(ids, vecs, d_ids[:4_000], d_vecs[:4_000])], None
            for j in range(4_000, len(d_ids), 4_000):
                if bound is None:
                    bound = found[0].groupby("q")["distance"].max().to_numpy()
                found.append(best(ids, vecs, d_ids[j : j + 4_000], d_vecs[j : j + 4_000], bound))
            part = pd.concat(found).sort_values(["q", "distance", "doc_id"])
            out.append(part.groupby("q", sort=False).head(k))
        return pd.concat(out)[["query_id", "doc_id", "distance"]]

    # pairs of blocks are few and heavy: an explicit count keeps adaptive execution from merging them
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * blocks * parts)
    left, right = (x.repartition(tasks, "b", "p").groupBy("b", "p") for x in (left, right))
    return left.cogroup(right).applyInPandas(meet, schema)


def source_refs(df: DataFrame, content: str = "content", topic: str = "topic", category: str = "category") -> DataFrame:
    """RET2: topic and category with defaults, first 200 characters and an ellipsis."""
    return (
        df.withColumn("topic", F.coalesce(F.col(topic), F.lit("unknown")))
        .withColumn("category", F.coalesce(F.col(category), F.lit("general")))
        .withColumn("excerpt", F.concat(F.substring(content, 1, 200), F.lit("...")))
    )


def informative_lines(content: Column) -> Column:
    """Up to three lines of a document: not blank, longer than 20, not ending in a colon."""
    lines = F.filter(
        F.split(content, "\n"), lambda s: (strip(s) != "") & (F.length(s) > 20) & ~s.endswith(":")
    )
    qa = content.contains("Question:") | content.contains("Answer:")
    return F.when(qa, F.array().cast("array<string>")).otherwise(F.slice(F.transform(lines, strip), 1, 3))


def snippets(ranked_docs: DataFrame, query_id: str = "query_id", rank: str = "rank", content: str = "content") -> DataFrame:
    """RET3: first two informative lines over the ranked documents of a query, at most 300 characters.

    Only the first two lines are used, so the early stop at six lines never changes the result.  Input is a
    top-k list: the group per query is k rows.
    """
    lines = ranked_docs.select(query_id, rank, informative_lines(F.col(content)).alias("lines"))
    grouped = lines.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(F.col(rank), "lines"))).alias("d"))
    text = F.array_join(F.slice(F.flatten(F.col("d.lines")), 1, 2), " ")
    return grouped.select(
        query_id,
        F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 297), F.lit("..."))).otherwise(text).alias("snippet"),
    )


def keyword_index(knowledge: DataFrame, id_column: str = "id", keywords: str = "keywords") -> DataFrame:
    return knowledge.select(
        id_column, F.explode(F.split(F.col(keywords), ",")).alias("_k")
    ).select(id_column, F.lower(strip(F.col("_k"))).alias("keyword")).where(F.col("keyword") != "").distinct()


def keyword_search(queries: DataFrame, knowledge: DataFrame, query_id: str = "query_id", query: str = "query",
                   id_column: str = "id", keywords: str = "keywords") -> DataFrame:
    """RET4: documents listing a word of the query as keyword, with the number of shared keywords."""
    words = queries.select(query_id, F.explode(F.array_distinct(F.split(F.lower(strip(F.col(query))), r"\s+"))).alias("keyword"))
    index = keyword_index(knowledge, id_column, keywords)
    return words.join(index, "keyword").groupBy(query_id, id_column).agg(F.count(F.lit(1)).alias("n_keywords"))


def answer_template(name: Column, info: Column) -> Column:
    """RET5: clarification request without a name, else name, information and recommendation."""
    about = F.when(
        F.coalesce(info, F.lit("")) != "", F.concat(F.lit("\n**About this condition:**\n"), info, F.lit("\n"))
    ).otherwise("")
    text = F.concat(
        F.lit(LIKELY[0]), title_name(name), F.lit(LIKELY[1]), about, F.lit(RECOMMEND)
    )
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(CLARIFY)).otherwise(text)


def recent_history(log: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", keep: int = 5) -> DataFrame:
    """WIN1: last ``keep`` exchanges per user; a group limit before the exchange keeps hot users small."""
    pos = F.row_number().over(W.partitionBy(user).orderBy(F.desc(ts), F.desc(tie)))
    return log.withColumn("recency", pos).where(F.col("recency") <= keep)


def context_strings(log: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", last: int = 3) -> DataFrame:
    """WIN2: the last three exchanges as text, oldest first."""
    recent = recent_history(log, user, ts, tie, last)
    line = F.concat(
        F.lit("User: "), F.col("question"), F.lit("\nAssistant: "), F.substring("answer", 1, 100), F.lit("...")
    )
    parts = F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("o"), line.alias("t"))))
    return recent.groupBy(user).agg(F.array_join(parts["t"], "\n").alias("context"))
