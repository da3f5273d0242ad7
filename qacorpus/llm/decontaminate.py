"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window).  Seen as a set of word shingles, a
window can only lie in a document that holds *all* its shingles, so one of them is a sufficient join key; the rarest one in
the corpus makes the fewest candidates.  Steps, DataFrame operations only:

1. the documents' shingles that occur in any item are written once, with their position (``occurrences``);
2. shingles are ordered by how often they occur, and each window takes its rarest as its prefix token.  A window with a shingle
   that occurs nowhere is out;
3. occurrences join the prefix tokens; a candidate must start at or after the first word and end at or before the last
   (positional and length bound);
4. each candidate is verified over its whole window: every shingle of the window must stand at its place;
5. hit words are counted on the union of the verified windows.

Tokens are the words themselves, not hashes, so results are exact.  The tables of item shingles and of prefix tokens are joined
without a hint: Spark broadcasts them when their written size is under its threshold, and shuffles otherwise.

Null or empty texts have no words: zero counts, not contaminated; such items have no window.  Every row of the documents gives
one row, repeated rows and null ids included (rows are told apart by a number, not by id).  Items with the same id count once in
``n_items``, null item ids are left out of the item list.  Empty tables and extra columns are fine: only ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import lower_ascii, query, staged, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
#: One row per document carries its word count through the same join, spread over this many tokens that are no words.
MARKS = 512


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingle(ws: Column, at: Column, length: int) -> Column:
    return F.concat_ws(" ", *[F.get(ws, at + i) for i in range(length)])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: ``w`` (its words joined by a space), ``ws`` (the words), ``items`` (ids as strings, distinct)."""
    listed = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    cut = listed.select("item", "ws", F.explode(starts).alias("at")).select("item", F.slice("ws", F.col("at") + 1, F.lit(window)).alias("ws"))
    return cut.groupBy("ws").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.concat_ws(" ", "ws").alias("w"), "ws", "items")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, n_items, item_list`` (sorted ids)."""
    wins = staged(item_windows(items, item_id, item_text, window), "windows")
    # a window of n words has shingles of min(n, SHINGLE) words; lengths below SHINGLE only occur with very short items
    parts = staged(
        wins.withColumn("k", F.least(F.size("ws"), F.lit(SHINGLE)))
        .select("w", "ws", "k", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("ws") - F.col("k")), lambda i: i)).alias("o", "i"))
        .select("w", F.size("ws").alias("len"), "o", "k", F.array_join(F.slice("ws", F.col("i") + 1, F.col("k")), " ").alias("token")),
        "parts",
    )
    marks = docs.sparkSession.range(MARKS).select(F.concat(F.lit("#"), F.col("id").cast("string")).alias("token"))
    known = staged(parts.select("token").distinct().union(marks), "known")
    lengths = [r.k for r in parts.select("k").distinct().collect()]  # at most SHINGLE values

    ws = F.concat(F.array(F.lit("")), words(F.col(text_col)))  # place 0 carries the word count
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), ws.alias("ws"))
    whole = rows.select(
        "id", "row", (F.size("ws") - 1).alias("n_words"),
        F.posexplode(F.arrays_zip(*[F.slice("ws", 1 + i, F.greatest(F.size("ws") - i, F.lit(0))).alias(f"w{i}") for i in range(SHINGLE)])).alias("at", "z"),
    )
    mark = F.concat(F.lit("#"), F.pmod(F.col("row"), F.lit(MARKS)).cast("string"))

    def token(k: int) -> Column:
        return F.when(F.col("at") == 0, mark if k == SHINGLE else F.lit(None)).otherwise(
            F.when(F.col(f"z.w{k - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"z.w{i}") for i in range(k)]))
        )

    if set(lengths) <= {SHINGLE}:
        spots = whole.withColumn("token", token(SHINGLE))
    else:
        spots = whole.withColumn("token", F.explode(F.array(*[token(k) for k in sorted({*lengths, SHINGLE})])))
    spots = spots.select("id", "row", "n_words", "at", "token").where(F.col("token").isNotNull())
    occurrences = staged(spots.join(known, "token", "left_semi"), "occurrences")
    seen = occurrences.where("at > 0").withColumn("at", F.col("at") - 1)
    base = occurrences.where("at = 0").select("id", "row", "n_words")

    often = seen.groupBy("token").agg(F.count("*").alias("often"))
    ranked = parts.join(often, "token", "left")
    prefix = staged(
        ranked.groupBy("w", "len").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token", "o")).alias("rare"), F.count("*").alias("parts"),
                                       F.min(F.coalesce("often", F.lit(0))).alias("least"))
        .where("least > 0").select("w", "len", "parts", F.col("rare.token").alias("token"), F.col("rare.o").alias("offset")),
        "prefix",
    )
    candidates = (
        seen.join(prefix, "token")
        .withColumn("start", F.col("at") - F.col("offset"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        .select("row", "w", "len", "parts", "start")
    )
    need = candidates.join(parts.select("w", "o", "token"), "w").select("row", (F.col("start") + F.col("o")).alias("at"), "token", "w", "len", "start", "parts")
    found = (
        need.join(seen.select("row", "at", "token"), ["row", "at", "token"])
        .groupBy("row", "w", "len", "start", "parts").agg(F.count("*").alias("n")).where("n = parts").select("row", "w", "len", "start")
    )
    hits = staged(found, "hits")

    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.max("end").over(W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    covered = spans.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit")
    )
    listed = (
        hits.select("row", "w").distinct().join(wins.select("w", F.explode("items").alias("item")), "w")
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_list"))
    )
    zero = F.lit(0).cast("long")
    return base.join(covered.join(listed, "row", "left"), "row", "left").select(
        "id", F.col("n_words").cast("long").alias("n_words"), F.coalesce(F.col("n_hit").cast("long"), zero).alias("n_hit"),
        F.coalesce(F.size("item_list").cast("long"), zero).alias("n_items"), F.coalesce("item_list", F.array().cast("array<string>")).alias("item_list"),
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (
  SELECT item_id, len(v) AS n, array_to_string(v, ' ') AS w FROM (
    SELECT item_id, unnest(list_transform(range(greatest(len(ws) - 12, 1)), lambda x: ws[x + 1 : x + 13])) AS v FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
dw AS (
  SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS w FROM (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN w ON dw.w = w.w AND dw.n = w.n),
spot AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN spot USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op3_benchmark_decontamination", SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_list", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
