"""Dataset profiling (AGG1-AGG7, AGG16-AGG18, SRC3, JN8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import word_count
from ..functions.text import detect_language
from .ordering import quantile_columns


def profile_nulls(df: DataFrame) -> DataFrame:
    """AGG1: one row per column: type, rows, nulls.  One scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(df.columns)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col("_n").alias("n_rows"),
                     (F.col("_n") - F.col(f"_{i}")).alias("n_nulls"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return counts.select(F.inline(rows))


def with_lengths(df: DataFrame) -> DataFrame:
    out = df
    for c in ("question", "answer"):
        text = F.coalesce(F.col(c), F.lit(""))
        out = out.withColumn(f"{c}_words", word_count(text)).withColumn(f"{c}_chars", F.length(text))
    return out


LENGTHS = ("question_words", "question_chars", "answer_words", "answer_chars")


def describe(df: DataFrame, columns=LENGTHS) -> DataFrame:
    """AGG2: count, mean, sample std, min, quartiles, max per column, in one pass.

    Lengths are small integers, so the exact ``percentile`` holds few distinct values; for real-valued
    columns use :func:`ordering.quantile_columns`.
    """
    aggs = []
    for c in columns:
        aggs.append(
            F.struct(
                F.lit(c).alias("measure"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.percentile(c, F.lit(0.25)).alias("q1"),
                F.percentile(c, F.lit(0.5)).alias("median"),
                F.percentile(c, F.lit(0.75)).alias("q3"),
                F.max(c).cast("double").alias("max"),
            ).alias(f"_{c}")
        )
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_{c}") for c in columns])))


def value_counts(df: DataFrame, column: str, levels: list[str] | None = None) -> DataFrame:
    """AGG3: count and share per value; with ``levels`` exactly those levels, 0 where absent."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    if levels is not None:
        # one map of the few wanted levels instead of a join with a level table
        wanted = counts.where(F.col("value").isin(*levels)).agg(
            F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("m")
        )
        counts = wanted.select("m", F.explode(F.array(*[F.lit(v) for v in levels])).alias("value")).select(
            "value", F.coalesce(F.try_element_at("m", F.col("value")), F.lit(0)).cast("bigint").alias("n")
        )
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / F.greatest(total, F.lit(1)))


def histogram(df: DataFrame, value: str | Column, bins: int) -> DataFrame:
    """AGG4: equal-width bins between min and max, last bin closed; empty bins included."""
    v = F.col(value) if isinstance(value, str) else value
    values = df.select(v.cast("double").alias("v")).where(F.col("v").isNotNull())
    bounds = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / F.lit(float(bins))
    slot = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("v") - lo, width)), F.lit(bins - 1))
    )
    counts = values.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    filled = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # <= bins rows
    return filled.select("m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin",
        (lo + F.col("bin") * width).alias("left"),
        (lo + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("bigint").alias("n"),
    )


def boxplot_stats(df: DataFrame, value: str) -> DataFrame:
    """AGG5: quartiles, whiskers at the last value inside 1.5 IQR, outlier count."""
    v = F.col(value).cast("double")
    q = quantile_columns(df, {"v": v}, [0.25, 0.5, 0.75]).agg(F.first(F.struct("q0", "q1", "q2"))).scalar()
    reach = F.lit(1.5) * (q["q2"] - q["q0"])
    inside = v.between(q["q0"] - reach, q["q2"] + reach)
    return df.where(v.isNotNull()).agg(
        F.max(q["q0"]).alias("q1"), F.max(q["q1"]).alias("median"), F.max(q["q2"]).alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"),
    )


def correlation(df: DataFrame, columns=LENGTHS) -> DataFrame:
    """AGG6: Pearson matrix in long form; one scan, upper triangle computed once."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = []
    for a in columns:
        for b in columns:
            name = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
            rows.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{name}`").alias("r")))
    return one.select(F.inline(F.array(*rows)))


def score_stats(df: DataFrame, score: str = "score") -> DataFrame:
    """AGG7: population standard deviation."""
    median = quantile_columns(df, {"v": F.col(score)}, [0.5]).agg(F.first("q0")).scalar()
    return df.agg(
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.avg(score).alias("mean"),
        F.max(median).alias("median"),
        F.stddev_pop(score).alias("std"),
    )


def split_distribution(df: DataFrame, column: str, top: int | None = 5) -> DataFrame:
    """AGG16: per split the most common values with their share; only counts reach the windows."""
    from pyspark.sql import Window as W

    counts = df.groupBy("split", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("split"))
    pos = F.row_number().over(W.partitionBy("split").orderBy(F.desc("n"), "value"))
    out = counts.withColumn("pct", F.col("n") * F.lit(100.0) / total).withColumn("position", pos)
    return out if top is None else out.where(F.col("position") <= top)


def retention_report(funnel: DataFrame, status: str = "status", kept: str = "cleaned") -> DataFrame:
    """AGG17: kept share and removed share by reason, divisors at least 1."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))

    def share(cond: Column) -> Column:
        return F.count_if(cond) * F.lit(100.0) / n

    s = F.col(status)
    return funnel.agg(
        F.count(F.lit(1)).alias("original_count"),
        F.count_if(s == kept).alias("final_count"),
        share(s == kept).alias("data_retention_rate"),
        share(s == "duplicate").alias("duplicates_removed_percentage"),
        share(s == "irrelevant").alias("irrelevant_removed_percentage"),
        share(s == "offensive").alias("offensive_removed_percentage"),
        share(s == "incomplete").alias("incomplete_removed_percentage"),
        F.bool_or(s == "irrelevant").alias("relevance_filtering"),
        F.bool_or(s == "offensive").alias("offensive_removal"),
    )


def raw_sample_profile(df: DataFrame, order: str = "ord", rows: int = 1000) -> DataFrame:
    """AGG18: first rows of the load order: mean lengths and language counts."""
    sample = df.select(order, "question", "answer").orderBy(order).limit(rows)
    q, a = F.nullif(F.col("question"), F.lit("")), F.nullif(F.col("answer"), F.lit(""))
    lang = F.when(q.isNotNull(), detect_language(q))
    return sample.withColumn("_lang", lang).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.avg(F.length(q)), F.lit(0.0)).alias("avg_question_length"),
        F.coalesce(F.avg(F.length(a)), F.lit(0.0)).alias("avg_answer_length"),
        F.count_if(F.col("_lang") == "english").alias("n_english"),
        F.count_if(F.col("_lang") == "thai").alias("n_thai"),
        F.count_if(F.col("_lang") == "unknown").alias("n_unknown"),
    )


def collect_summary(df: DataFrame, source: str = "source", descriptions: dict | None = None, large: int = 10_000) -> DataFrame:
    """SRC3: rows per dataset, their total (source ``TOTAL``) and whether the large-corpus mark is reached."""
    counts = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("samples"))
    both = counts.rollup("source").agg(F.sum("samples").alias("samples"), F.grouping("source").alias("_g"))
    name = F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("source"))
    out = both.select(name.alias("source"), "samples", (F.col("samples") >= large).alias("is_large"))
    if descriptions:
        text = F.lit("")
        for k, v in descriptions.items():
            text = F.when(F.col("source") == k, v).otherwise(text)
        out = out.withColumn("description", text)
    return out


def compare_datasets(first: DataFrame, second: DataFrame, split: str = "split") -> DataFrame:
    """JN8: totals per split of two datasets side by side, gain and gain per cent of the first over the second."""

    def totals(df: DataFrame, tag: str) -> list[Column]:
        s = F.col(split)
        one = df.agg(
            F.struct(
                F.count(F.lit(1)).alias("total"),
                F.count_if(s == "train").alias("train"),
                F.count_if(s == "val").alias("val"),
                F.count_if(s == "test").alias("test"),
            )
        ).scalar()
        return [one[f].alias(f"{f}_{tag}") for f in ("total", "train", "val", "test")]

    row = first.sparkSession.range(1).select(*totals(first, "1"), *totals(second, "2"))
    gain = F.col("total_1") - F.col("total_2")
    return row.withColumn("gain", gain).withColumn(
        "gain_pct", F.coalesce(F.try_divide(gain * F.lit(100.0), F.col("total_2")), F.lit(0.0))
    )
