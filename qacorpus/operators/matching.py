"""Rule tables, lookups and label tables (JN3, JN6, JN7, FEA5)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import emergency_rule
from ..lexicon import MEDICAL
from ..session import write_out
from .ordering import ranked

#: Up to so many patterns become one expression over the text; larger rule tables go through keyword automata.
INLINE_RULES = 2_000
#: Keywords of one automaton.
KEYWORDS = 50_000


def match_rule_table(df: DataFrame, rules: DataFrame, text: str = "question", out: str = "alert_type", inline: int = INLINE_RULES) -> DataFrame:
    """JN3: first rule (by ``ord``) with a pattern whose keywords all occur in the text.

    ``rules``: rule_ord int, kind string, pattern array<string>.  A pattern that is null, empty or holds a null keyword matches no text;
    an empty keyword occurs in every text that isn't null; of rules with one ``rule_ord`` the first kind by name counts.  A small
    rule table is configuration: it is read once and becomes one expression, and the text table is neither joined nor shuffled.
    A larger one is matched by automata; the rows that come out are the same.
    """
    usable = rules.where((F.size("pattern") > 0) & F.forall("pattern", lambda w: w.isNotNull())).select("rule_ord", "kind", "pattern")
    rows = usable.orderBy("rule_ord", "kind").limit(inline + 1).collect()
    if len(rows) > inline:
        return _match_by_automaton(df, usable, text, out)
    grouped: dict[tuple, list] = {}
    for r in rows:
        grouped.setdefault((r["rule_ord"], r["kind"]), []).append(tuple(r["pattern"]))
    if not grouped:
        return df.withColumn(out, F.lit(None).cast("string"))
    profile = replace(MEDICAL, alert_rules=tuple((k, "critical", tuple(ps)) for (_, k), ps in grouped.items()))
    return df.withColumn("_low", F.lower(F.col(text))).withColumn(out, emergency_rule(F.col("_low"), profile)).drop("_low")


def _keyword_ids(low: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """``_id, ids``: numbers of all keywords that occur in each text; rows without one are left out.

    One Aho-Corasick automaton for each block of at most about ``KEYWORDS`` keywords, built once and sent to the tasks; the texts
    stream through it and only numbers come out.  More keywords mean more passes over the texts, not larger automata.
    """

    def through(block: int) -> DataFrame:
        automaton = ahocorasick.Automaton()
        for r in words.where(F.col("block") == block).select("word", "w").toLocalIterator():
            automaton.add_word(r["word"], r["w"])
        automaton.make_automaton()
        shared = low.sparkSession.sparkContext.broadcast(automaton)

        @F.arrow_udf("array<bigint>")
        def found(texts: pa.Array) -> pa.Array:
            machine = shared.value
            return pa.array([sorted({w for _, w in machine.iter(t)}) if t else [] for t in texts.to_pylist()], pa.list_(pa.int64()))

        return low.select("_id", found("low").alias("ids"))

    passes = [through(k) for k in range(blocks)]
    whole = reduce(lambda a, b: a.union(b), passes).where(F.size("ids") > 0)
    if blocks > 1:
        whole = whole.groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    return whole


def _match_by_automaton(df: DataFrame, rules: DataFrame, text: str, out: str) -> DataFrame:
    """Texts to keyword numbers, those to patterns through each pattern's rarest keyword, then the first whole pattern.

    A text meets a pattern only where the keyword of it that the fewest texts hold occurs, and the numbers it carries tell whether the
    others do, so texts are never copied and a keyword of every other text brings no join rows unless a pattern has no rarer one.
    """
    rows = write_out(df.withColumn("_id", F.monotonically_increasing_id()), "ruled")
    patterns = write_out(rules.select("rule_ord", "kind", F.array_distinct("pattern").alias("pattern")).withColumn("_p", F.monotonically_increasing_id()), "rules")
    keyed = patterns.select("_p", F.explode("pattern").alias("word"))
    words = keyed.where("word != ''").select("word").distinct()
    blocks = -(-words.count() // KEYWORDS)
    words = write_out(words.select("word", F.monotonically_increasing_id().alias("w"), F.pmod(F.xxhash64("word"), F.lit(max(1, blocks))).alias("block")), "words")
    low = rows.select("_id", F.lower(F.col(text)).alias("low"))
    numbered = keyed.join(words.select("word", "w"), "word")
    if blocks:
        met = write_out(_keyword_ids(low, words, blocks), "met")
        held = write_out(met.select(F.explode("ids").alias("w")).groupBy("w").agg(F.count("*").alias("c")), "held")
        # patterns with a keyword that no text holds fall out of the join
        whole = numbered.join(held, "w", "left").groupBy("_p").agg(F.collect_list("w").alias("need"), F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "w")).alias("rare"))
        whole = whole.where("rare.c > 0").join(patterns.select("_p", "rule_ord", "kind"), "_p").select(F.col("rare.w").alias("w"), "need", "rule_ord", "kind")
        pairs = met.select("_id", "ids", F.explode("ids").alias("w")).join(whole, "w")
        hits = pairs.where(F.size(F.array_except("need", "ids")) == 0).select("_id", "rule_ord", "kind")
    else:
        hits = low.select("_id", F.lit(0).alias("rule_ord"), F.lit("").alias("kind")).limit(0)
    # patterns of the empty keyword alone hold for every text that isn't null
    always = patterns.where(F.forall("pattern", lambda w: w == "")).agg(F.min(F.struct("rule_ord", "kind")).alias("r")).first()["r"]
    if always is not None:
        hits = hits.union(low.where(F.col("low").isNotNull()).select("_id", F.lit(always["rule_ord"]), F.lit(always["kind"])))
    best = hits.groupBy("_id").agg(F.min(F.struct("rule_ord", "kind"))["kind"].alias(out))
    return rows.join(best, "_id", "left").drop("_id")


def lookup_weights(df: DataFrame, weights: DataFrame, key: str, default: float, out: str = "weight") -> DataFrame:
    """JN6: weight by key with a default for unknown keys.

    A plain left join on the key: a small weight table is broadcast by its size statistics, a large one
    is shuffled and a hot key is split by adaptive skew handling.
    """
    w = weights.select(F.col(key), F.col("weight").alias("_w"))
    return df.join(w, key, "left").withColumn(out, F.coalesce("_w", F.lit(float(default)))).drop("_w")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """FEA5: sorted distinct labels, 0-based index, row count.  Ranks come from ranges of labels, not from one task."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, [F.col("label")], "_rank").withColumn("label_id", (F.col("_rank") - 1).cast("int")).drop("_rank")


def join_label_index(df: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """JN7"""
    return df.join(labels.select(F.col("label").alias(label), "label_id"), label)
