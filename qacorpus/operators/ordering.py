"""Ranks and running totals over a total order, without a single-partition window.

``ranked`` range-partitions on the order columns, sorts inside partitions, numbers the rows and writes
them to the shared folder, so that partition and position are fixed; a row's rank is its position plus
the number of rows in earlier partitions.  The order columns must end in a unique column: then a hot
value is split over ranges like any other run of rows.

``hash_ranked`` ranks inside groups by a hash.  A hot group is cut into hash buckets first, so
no task ever sorts a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import write_out

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def _with_layout(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mono = F.monotonically_increasing_id()
    laid = df.repartitionByRange(count, *order).sortWithinPartitions(*order).select(
        "*",
        F.shiftrightunsigned(mono, _ROW_BITS).alias("_part"),
        mono.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_pos"),
    )
    return write_out(laid, "ranked")


def _offsets(laid: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per-partition totals turned into exclusive running totals; one row per partition."""
    per = laid.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return per.select(
        "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums]
    )


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add the 1-based global rank (bigint)."""
    laid = _with_layout(df, order, partitions)
    offsets = F.broadcast(_offsets(laid, {"_before": F.lit(1)}))  # one row per partition
    return (
        laid.join(offsets, "_part")
        .withColumn(name, (F.col("_before") + F.col("_pos") + 1).cast("bigint"))
        .drop("_part", "_pos", "_before")
    )


def running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Add inclusive running totals along the order."""
    laid = _with_layout(df, order, partitions)
    offsets = F.broadcast(_offsets(laid, {f"_b_{n}": c for n, c in sums.items()}))
    upto = W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    out = laid.join(offsets, "_part")
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(upto) + F.col(f"_b_{n}"))
    return out.drop("_part", "_pos", *[f"_b_{n}" for n in sums])


def seeded_hash(key: Column, seed: int | str = 42) -> Column:
    """Reproducible pseudo-random text key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_ranked(
    df: DataFrame, groups: Sequence[str], key: Column, name: str = "rank", seed: int | str = 42,
    bucket_digits: int = 3,
) -> DataFrame:
    """Add the rank by seeded hash inside each group, and the group size ``<name>_n``.

    Buckets are the first hex digits of the hash (16^digits of them).  The table of bucket sizes is
    counted with map-side combining and is at most groups x buckets rows; it is joined on its keys, and the
    window that follows needs no further shuffle.  Groups are joined as structs, in which a null equals a
    null, so rows with a null group are a group like any other; ``key`` must be unique.
    """
    group = F.struct(*groups) if groups else F.lit(0)
    h = df.withColumns({"_h": seeded_hash(key, seed), "_g": group}).withColumn("_b", F.substring("_h", 1, bucket_digits))
    sizes = h.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        "_g",
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy("_g")).alias(f"{name}_n"),
    )
    inside = W.partitionBy("_g", "_b").orderBy("_h", key)
    joined = h.join(sizes, ["_g", "_b"])
    return (
        joined.withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("bigint"))
        .drop("_h", "_g", "_b", "_before")
    )


def top_n(df: DataFrame, order: Sequence[Column], n: int, report_rows: int = 1_000) -> DataFrame:
    """First ``n`` rows of the order, in that order.  Small n keeps a per-task heap; large n cuts by global rank."""
    if n <= report_rows:
        return df.orderBy(*order).limit(n)
    return ranked(df, order, "_rank").where(F.col("_rank") <= n).orderBy("_rank").drop("_rank")


def cut_at(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int) -> Row | None:
    """The ``keys`` (name, descending) of the ``n``-th row in their order; None if there are fewer rows.

    Only the key columns are ranked and written, so choosing rows by a cut costs no copy of their texts.
    """
    named = [F.col(name).alias(f"k{i}") for i, (name, _) in enumerate(keys)]
    order = [F.desc(f"k{i}") if down else F.asc(f"k{i}") for i, (_, down) in enumerate(keys)]
    return ranked(df.select(*named), order, "_rank").where(F.col("_rank") == n).drop("_rank").first() if n > 0 else None


def up_to(keys: Sequence[tuple[str, bool]], cut: Row) -> Column:
    """Whether a row's keys stand at or before the cut; nulls first where ascending, last where descending, as Spark sorts."""
    out = F.lit(True)
    for (name, down), value in reversed(list(zip(keys, cut))):
        c = F.col(name)
        if value is None:
            before = c.isNotNull() if down else F.lit(False)
        else:
            before = (c > F.lit(value)) if down else (c.isNull() | (c < F.lit(value)))
        out = F.coalesce(before, F.lit(False)) | (c.eqNullSafe(F.lit(value)) & out)
    return out


def first_n(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int, report_rows: int = 1_000) -> DataFrame:
    """First ``n`` rows in the order of ``keys`` (name, descending; the last one unique), in that order.

    Small n keeps a heap in each task.  For large n the n-th key is found among the keys alone, then the rows up to it are taken
    from the input and sorted by ranges.
    """
    order = [F.desc(name) if down else F.asc(name) for name, down in keys]
    if n <= report_rows:
        return df.orderBy(*order).limit(n)
    cut = cut_at(df, keys, n)
    return (df if cut is None else df.where(up_to(keys, cut))).orderBy(*order)


#: Buckets for each doubling of a value.
_PER_OCTAVE = 4_096


def _bucket(v: Column) -> Column:
    """A whole number that rises with a double, the same for every table: its sign and logarithm."""
    size = F.floor((F.log2(F.abs(v)) + 1_100) * _PER_OCTAVE).cast("long")
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def cumulative(counts: DataFrame, value: str, sums: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running totals ``upto_<s>`` and group totals ``all_<s>`` along a double column; nothing runs before the result is read.

    Totals are taken for each bucket of values and inside each bucket, so no task holds all values; the table of buckets is at
    most some thousands of rows a doubling, however many values there are.
    """
    inside = counts.withColumn("_bucket", _bucket(F.col(value)))
    per = inside.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_b_{c}") for c in sums])
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*groups, "_bucket", *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
                     *[F.sum(f"_b_{c}").over(whole).alias(f"all_{c}") for c in sums])
    along = W.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = inside.join(per, [*groups, "_bucket"])
    return out.withColumns({f"upto_{c}": F.sum(c).over(along) + F.col(f"_before_{c}") for c in sums}).drop("_bucket", *[f"_before_{c}" for c in sums])


def quantile_columns(df: DataFrame, measures: dict[str, Column], probabilities: Sequence[float]) -> DataFrame:
    """``measure, n, q0, q1, ...``: exact linear-interpolated quantiles of several columns from one pass, lazily.

    Values are counted first, stacked by measure and combined before the shuffle; a measure without a value has no row.
    """
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), c.cast("double").alias("v")) for name, c in measures.items()])))
    counts = stacked.where(F.col("v").isNotNull()).groupBy("measure", "v").agg(F.count(F.lit(1)).alias("c"))
    cum = cumulative(counts, "v", ["c"], ["measure"])

    def at(position: Column) -> Column:
        return F.max(F.when((position >= F.col("upto_c") - F.col("c")) & (position < F.col("upto_c")), F.col("v")))

    place = [(F.col("all_c") - 1) * F.lit(float(p)) for p in probabilities]
    found = cum.groupBy("measure").agg(F.max("all_c").alias("n"), *[at(F.floor(x)).alias(f"l{i}") for i, x in enumerate(place)], *[at(F.ceil(x)).alias(f"h{i}") for i, x in enumerate(place)])
    share = [((F.col("n") - 1) * F.lit(float(p))) - F.floor((F.col("n") - 1) * F.lit(float(p))) for p in probabilities]
    return found.select("measure", "n", *[(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * x).alias(f"q{i}") for i, x in enumerate(share)])


def quantile_values(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float | None]:
    """Exact linear-interpolated quantiles of one column (None for no rows).

    Values are counted first (map-side combined), then ranked by range partitions, so memory does not
    grow with the number of distinct values as it does in the ``percentile`` aggregate.  Only the few
    wanted values reach the driver.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cum = running_totals(counts, [F.col("v")], {"upto": F.col("c")})
    n = cum.agg(F.max("upto")).first()[0]
    if not n:
        return [None] * len(probabilities)
    positions = [(n - 1) * float(p) for p in probabilities]

    def at(position: int) -> Column:
        inside = (F.lit(position) >= F.col("upto") - F.col("c")) & (F.lit(position) < F.col("upto"))
        return F.max(F.when(inside, F.col("v"))).cast("double")

    wanted = sorted({math.floor(x) for x in positions} | {math.ceil(x) for x in positions})
    row = cum.agg(*[at(x).alias(str(x)) for x in wanted]).first()
    out = []
    for x in positions:
        low, high = row[str(math.floor(x))], row[str(math.ceil(x))]
        out.append(low + (high - low) * (x - math.floor(x)))
    return out


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """:func:`quantile_values` as rows (p, value)."""
    rows = list(zip([float(p) for p in probabilities], quantile_values(df, value, probabilities)))
    return df.sparkSession.createDataFrame(rows, "p double, value double")
