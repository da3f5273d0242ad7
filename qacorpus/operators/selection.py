"""Sorting, top-n, sampling, splitting and augmentation (SRT1-4, SET1, SMP1, SPL1-3, FEA3)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import question_variations
from ..functions.score import selection_details
from ..lexicon import MEDICAL, Profile
from .ordering import cut_at, first_n, hash_ranked, seeded_hash, up_to
from .staging import compute, keep


def sort_by_quality(df: DataFrame, score: str = "quality_score", order: str = "ord") -> DataFrame:
    """SRT1"""
    return df.orderBy(F.desc(score), order)


def score_rows(df: DataFrame, profile: Profile = MEDICAL) -> DataFrame:
    """SCR5 as columns ``score`` and ``feature_details``."""
    details = selection_details(
        F.col("question"), F.col("answer"), F.col("specialty"), F.col("severity_level"), F.col("type"), profile
    )
    return df.withColumn("feature_details", details).withColumn("score", F.col("feature_details.score"))


def select_top(df: DataFrame, target: int | None = 50_000, min_score: float = 0.8, order: str = "ord") -> DataFrame:
    """SRT2 / FLT10: score at least ``min_score``, best first, at most ``target`` rows."""
    passed = keep(compute(df, {"score": F.col("score")}), F.col("score") >= F.lit(float(min_score)))
    return passed if target is None else first_n(passed, [("score", True), (order, False)], target)


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    """SRT3"""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def newest(df: DataFrame, ts: str = "ts", tie: str = "event_id", limit: int = 20) -> DataFrame:
    """SRT4"""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def concat_all(frames: list[DataFrame]) -> DataFrame:
    """SET1"""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample_n(df: DataFrame, n: int, key: str = "ord", seed: int = 42) -> DataFrame:
    """SMP1: reproducible simple random sample of ``n`` rows."""
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed))
    return first_n(hashed, [("_h", False), (key, False)], n).drop("_h")


def _check(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-8:
        raise ValueError(f"ratios must sum to 1.0, got {sum(ratios)}")


def _label(rank, size, ratios):
    """Floor rule: int(n * train), int(n * val), rest test."""
    train = F.floor(size * F.lit(float(ratios[0])))
    val = F.floor(size * F.lit(float(ratios[1])))
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def stratum(specialty: str = "specialty", severity: str = "severity_level", profile: Profile = MEDICAL):
    return F.concat_ws(
        "_",
        F.coalesce(F.col(specialty), F.lit(profile.specialty_default)),
        F.coalesce(F.col(severity), F.lit(profile.severity_default)),
    )


def random_split(
    df: DataFrame, ratios=(0.70, 0.15, 0.15), key: str = "ord", seed: int = 42
) -> DataFrame:
    """SPL2: one seeded permutation of all rows."""
    _check(ratios)
    r = hash_ranked(df, [], F.col(key), "_rank", seed)
    return r.withColumn("split", _label(F.col("_rank"), F.col("_rank_n"), ratios)).drop("_rank", "_rank_n")


def stratified_split(
    df: DataFrame, ratios=(0.70, 0.15, 0.15), key: str = "ord", seed: int = 42, strata=None, min_stratum: int = 3
) -> DataFrame:
    """SPL1: floor rule inside every stratum; any stratum below ``min_stratum`` rows means SPL2 instead.

    One small aggregate decides between the two rules.  Ranks are taken in hash buckets, so a stratum with
    a third of all rows is still many tasks.
    """
    _check(ratios)
    keyed = df.withColumn("_stratum", stratum() if strata is None else strata)
    smallest = keyed.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).first()["n"]
    if smallest is None or smallest < min_stratum:
        return random_split(keyed.drop("_stratum"), ratios, key, seed)
    r = hash_ranked(keyed, ["_stratum"], F.col(key), "_rank", seed)
    return r.withColumn("split", _label(F.col("_rank"), F.col("_rank_n"), ratios)).drop("_rank", "_rank_n", "_stratum")


def sequential_split(df: DataFrame, ratio: float = 0.8, order: str = "ord") -> DataFrame:
    """SPL3: first ``int(ratio * n)`` rows are train, the rest val."""
    keys = [(order, False)]
    cut = cut_at(df, keys, math.floor(df.count() * float(ratio)))
    return df.withColumn("split", F.lit("val") if cut is None else F.when(up_to(keys, cut), "train").otherwise("val"))


def augment(
    df: DataFrame, ratio: float = 0.1, order: str = "ord", profile: Profile = MEDICAL,
    levels=("critical", "high"), starts=None,
) -> DataFrame:
    """FEA3: append reworded copies of the first ``int(n * ratio)`` severe, specialised rows."""
    options = {} if starts is None else {"starts": starts}
    keys = [(order, False)]
    candidates = df.where(F.col("severity_level").isin(*levels) & (F.col("specialty") != profile.specialty_default))
    wanted = math.floor(df.count() * float(ratio))
    cut = cut_at(candidates, keys, wanted)
    chosen = candidates.where(up_to(keys, cut)) if cut is not None else candidates.where(F.lit(wanted > 0))
    copies = (
        chosen.withColumn("question", F.explode(question_variations(F.col("question"), **options)))
        .withColumn("augmented", F.lit(True))
        .withColumn("augmentation_method", F.lit("paraphrase"))
    )
    base = df.withColumn("augmented", F.lit(False)).withColumn("augmentation_method", F.lit(None).cast("string"))
    return base.unionByName(copies)
