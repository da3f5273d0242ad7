"""SRT4, SMP1, SPL1-SPL3, WIN6, AGG16, JN8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling, selection
from ..operators.ordering import hash_ranked
from ..sources import readers
from .base import LABELLED, QA, events, labelled, ntz, qa, query, r6, table

RATIOS = (0.70, 0.15, 0.15)
RANK = "row_number() OVER (PARTITION BY {g} ORDER BY md5('42|' || {k}::VARCHAR), {k})"


def floor_rule(rank, n):
    return (
        f"CASE WHEN {rank} <= floor({n} * 0.7::DOUBLE) THEN 'train' "
        f"WHEN {rank} <= floor({n} * 0.7::DOUBLE) + floor({n} * 0.15::DOUBLE) THEN 'val' ELSE 'test' END"
    )


def strata(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source")


STRATIFIED = f"""ranked AS (SELECT doc_id, lang, source, {RANK.format(g='lang', k='doc_id')} AS rk, count(*) OVER (PARTITION BY lang) AS n FROM documents),
 split AS (SELECT doc_id, lang, source, {floor_rule('rk', 'n')} AS split FROM ranked)"""


def stratified(spark, d):
    return selection.stratified_split(strata(spark, d), RATIOS, "doc_id", strata=F.col("lang"))


query("spl1_stratified_split", f"WITH {STRATIFIED} SELECT * FROM split")(stratified)
# the pair strata hold groups of fewer than three rows, so the random rule applies
query(
    "spl1_small_stratum_fallback",
    f"""WITH {LABELLED}, r AS (SELECT ord, {RANK.format(g='1', k='ord')} AS rk, count(*) OVER () AS n FROM labelled)
 SELECT ord, {floor_rule('rk', 'n')} AS split FROM r""",
)(
    lambda spark, d: selection.stratified_split(
        labelled(spark, d), RATIOS, strata=F.concat_ws("_", "specialty", "severity_level", "source", "conv_id")
    ).select("ord", "split")
)
query(
    "spl2_random_split",
    f"WITH r AS (SELECT event_id, {RANK.format(g='1', k='event_id')} AS rk, count(*) OVER () AS n FROM events) SELECT event_id, {floor_rule('rk', 'n')} AS split FROM r",
)(lambda spark, d: selection.random_split(table(spark, d, "events").select("event_id"), RATIOS, "event_id"))
query(
    "spl3_sequential_split",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rk, count(*) OVER () AS n FROM events)
 SELECT event_id, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r""",
)(lambda spark, d: selection.sequential_split(table(spark, d, "events").select("event_id"), 0.8, "event_id"))
query(
    "win6_split_rank",
    f"SELECT event_id, {RANK.format(g='event_type', k='event_id')} AS rank, count(*) OVER (PARTITION BY event_type) AS rank_n FROM events",
)(
    lambda spark, d: hash_ranked(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], F.col("event_id")).select(
        "event_id", "rank", "rank_n"
    )
)
query("smp1_random_sample", "SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id::VARCHAR), doc_id LIMIT 100")(
    lambda spark, d: selection.sample_n(table(spark, d, "documents").select("doc_id", "source"), 100, "doc_id")
)
query("srt4_newest_history", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")(
    lambda spark, d: selection.newest(events(spark, d)).select("event_id", ntz("ts"), "user_id")
)
query(
    "agg16_split_distribution",
    f"""WITH {STRATIFIED}, c AS (SELECT split, source AS value, count(*) AS n FROM split GROUP BY ALL)
 SELECT split, value, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY split), 6) AS pct,
 row_number() OVER (PARTITION BY split ORDER BY n DESC, value)::INTEGER AS position FROM c QUALIFY position <= 5""",
)(lambda spark, d: profiling.split_distribution(stratified(spark, d), "source").withColumn("pct", r6("pct")))
query(
    "jn8_dataset_compare",
    f"""WITH {STRATIFIED}, {QA}, r AS (SELECT ord, {RANK.format(g='1', k='ord')} AS rk, count(*) OVER () AS n FROM qa), s2 AS (SELECT {floor_rule('rk', 'n')} AS split FROM r),
 a AS (SELECT count(*) AS total_1, count_if(split = 'train')::BIGINT AS train_1, count_if(split = 'val')::BIGINT AS val_1, count_if(split = 'test')::BIGINT AS test_1 FROM split),
 b AS (SELECT count(*) AS total_2, count_if(split = 'train')::BIGINT AS train_2, count_if(split = 'val')::BIGINT AS val_2, count_if(split = 'test')::BIGINT AS test_2 FROM s2)
 SELECT *, total_1 - total_2 AS gain, round((total_1 - total_2) * 100.0::DOUBLE / total_2, 6) AS gain_pct FROM a, b""",
)(
    lambda spark, d: profiling.compare_datasets(
        stratified(spark, d), selection.random_split(qa(spark, d), RATIOS)
    ).withColumn("gain_pct", r6("gain_pct"))
)


# ---- many rows: the cut is found among the keys

query(
    "srt2_select_many",
    "SELECT event_id, value FROM events WHERE value >= 0.5::DOUBLE ORDER BY value DESC, event_id LIMIT 3000",
)(
    lambda spark, d: selection.select_top(table(spark, d, "events").withColumns({"score": F.col("value"), "ord": F.col("event_id")}), 3_000, 0.5).select("event_id", "value")
)
query("src4_many_records", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 4000")(
    lambda spark, d: readers.max_records(table(spark, d, "events"), 4_000, "event_id").select("event_id", "event_type")
)
query("smp1_large_sample", "SELECT event_id, ts FROM events ORDER BY md5('42|' || event_id::VARCHAR), event_id LIMIT 2500")(
    lambda spark, d: selection.sample_n(table(spark, d, "events"), 2_500, "event_id").select("event_id", "ts")
)
