"""Ranks, splits, samples, augmentation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from qacorpus.operators import ordering, selection


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "ord").repartition(7)


def test_ranked_is_the_position_in_the_order(spark):
    rnd = random.Random(0)
    rows = [(i, rnd.choice([1, 1, 1, 5, rnd.randint(0, 9)])) for i in range(3000)]  # a hot value
    df = spark.createDataFrame(rows, "ord bigint, v int").repartition(9)
    got = {r["ord"]: r["rank"] for r in ordering.ranked(df, [F.desc("v"), F.col("ord")]).collect()}
    want = {o: i + 1 for i, (o, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_running_totals_and_quantiles(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    v = np.round(rnd.normal(size=2001), 3)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = ordering.quantile_values(df, "v", [0.0, 0.1, 0.25, 0.5, 0.999, 1.0])
    assert got == pytest.approx(list(np.quantile(v, [0.0, 0.1, 0.25, 0.5, 0.999, 1.0])))
    assert ordering.quantile_values(df.where("v > 99"), "v", [0.5]) == [None]


def test_lazy_quantiles_and_totals(spark):
    import numpy as np

    rng = random.Random(5)
    values = [rng.choice([0.0, -0.0, 1.5, -3.25, rng.gauss(0, 1), rng.gauss(0, 1e-9), 1e300 * rng.random(), -(2.0 ** rng.randint(-60, 60))]) for _ in range(3_000)]
    df = spark.createDataFrame([(float(v), None if i % 3 else float(i)) for i, v in enumerate(values)], "a double, b double")
    p = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r.measure: r for r in ordering.quantile_columns(df, {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None).cast("double")}, p).collect()}
    assert set(got) == {"a", "b"} and (got["a"].n, got["b"].n) == (3_000, 1_000)
    for name, column in (("a", values), ("b", [float(i) for i in range(3_000) if i % 3 == 0])):
        assert np.allclose([got[name][f"q{i}"] for i in range(len(p))], np.quantile(column, p), rtol=1e-12)
    counts = df.groupBy("a").agg(F.count("*").alias("c"))
    rows = ordering.cumulative(counts, "a", ["c"]).collect()
    assert {(r.upto_c, r.all_c) for r in rows} == {(sum(v <= r.a for v in values), 3_000) for r in rows}


@pytest.mark.parametrize("keys", [[("s", True), ("ord", False)], [("s", False), ("ord", True)], [("t", False), ("s", True), ("ord", False)]])
def test_first_n_by_a_cut(spark, keys):
    """Nulls, ties and every direction give what sorting all rows gives."""
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 1.0, 2.0, float("nan")]), rng.choice([None, "a", "b"])) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, s double, t string").repartition(3)
    order = [F.desc(k) if down else F.asc(k) for k, down in keys]
    want = [r.ord for r in df.orderBy(*order).collect()]
    for n in (1, 77, 150, 299, 300, 400):
        assert [r.ord for r in ordering.first_n(df, keys, n, report_rows=0).collect()] == want[:n]


def test_hash_rank(spark):
    df = ids(spark, 500).withColumn("g", F.when(F.col("ord") < 400, "hot").otherwise("cold"))
    got = {(r["g"], r["ord"]): (r["rank"], r["rank_n"]) for r in ordering.hash_ranked(df, ["g"], F.col("ord")).collect()}
    for g, members in (("hot", range(400)), ("cold", range(400, 500))):
        order = sorted(members, key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        for i, o in enumerate(order):
            assert got[(g, o)] == (i + 1, len(members))


@pytest.mark.parametrize("n,ratios,want", [(20, (0.7, 0.15, 0.15), (14, 3, 3)), (10, (0.8, 0.1, 0.1), (8, 1, 1)), (3, (0.7, 0.15, 0.15), (2, 0, 1))])
def test_floor_rule(spark, n, ratios, want):
    split = selection.random_split(ids(spark, n), ratios)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == want


def test_stratified_split_and_fallback(spark):
    rows = [(i, "a" if i < 20 else "b", "low") for i in range(30)]
    df = spark.createDataFrame(rows, "ord bigint, specialty string, severity_level string")
    split = selection.stratified_split(df)
    counts = {(r["specialty"], r["split"]): r["count"] for r in split.groupBy("specialty", "split").count().collect()}
    assert counts == {("a", "train"): 14, ("a", "val"): 3, ("a", "test"): 3, ("b", "train"): 7, ("b", "val"): 1, ("b", "test"): 2}
    small = df.unionByName(spark.createDataFrame([(99, "c", "low")], df.schema))
    got = {r["ord"]: r["split"] for r in selection.stratified_split(small).collect()}
    want = {r["ord"]: r["split"] for r in selection.random_split(small).collect()}
    assert got == want and len(got) == 31
    with pytest.raises(ValueError):
        selection.random_split(df, (0.5, 0.5, 0.5))


def test_sequential_split_and_top(spark):
    got = selection.sequential_split(ids(spark, 11), 0.8)
    assert sorted(r["ord"] for r in got.where("split = 'train'").collect()) == list(range(8))
    df = ids(spark, 50).withColumn("score", (F.col("ord") % 5) / 4.0)
    few = [(r["score"], r["ord"]) for r in ordering.top_n(df, [F.desc("score"), F.col("ord")], 12).collect()]
    many = [(r["score"], r["ord"]) for r in ordering.top_n(df, [F.desc("score"), F.col("ord")], 12, report_rows=1).collect()]
    assert sorted(few) == sorted(many) and len(few) == 12
    assert selection.select_top(df, None, 0.75).count() == 20
    assert selection.sample_n(df, 7).count() == 7
    assert kept_ids(selection.sample_n(df, 7)) == kept_ids(selection.sample_n(df.repartition(3), 7))


def kept_ids(df):
    return sorted(r["ord"] for r in df.collect())


def test_augment(spark):
    rows = [
        (0, "What is flu?", "cardiology", "critical"), (1, "How to rest", "cardiology", "low"), (2, "How to eat", "general_medicine", "high"),
        (3, "How to run", "neurology", "high"), (4, "plain", "neurology", "high"),
    ]
    df = spark.createDataFrame(rows, "ord bigint, question string, specialty string, severity_level string")
    out = selection.augment(df, 0.4)
    copies = sorted(r["question"] for r in out.where("augmented").collect())
    assert copies == ["Can you explain what is flu?", "What is flu, please?", "What is the best way to run"]
    assert out.count() == 8
