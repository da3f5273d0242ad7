"""From band keys to verified links, without all pairs of a group.

A bucket (items that share a band key) of up to ``SMALL`` items is compared pair by pair, which is at most ``SMALL`` candidates for a
row.  Larger buckets are mostly near copies of one item, so:

1. the item that is in most large buckets is the pivot of each of its buckets, and all members are verified against it; members
   of one component need no more comparisons among each other;
2. items of buckets that still span components go, once each, through an exact prefix join: shingles are ordered by rarity among
   these items, and two sets that reach the threshold must share one of their first shingles: one of the first n - ceil(t n) + 1 of the
   larger set and of the first n - ceil(2t / (1 + t) n) + 1 of the smaller one, so a shingle that only stands further back in all of
   them makes no pair.  Sets meet by shingle and band of sizes.  Only pairs of different components are compared, probing from the
   items outside the largest component of a shingle.  This step has no cap, and it loses no link that the buckets held.

Where a caller can compare short texts by themselves (``within``), buckets that one task holds go there before step 1, larger ones after it as
far as their size is bounded, and only the rest to step 2.

Every link is confirmed on full sets of 64-bit shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged
from .bitmaps import maybe_any
from .components import components

SMALL = 8
PIVOT_ROUNDS = 2


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def sizes(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def holds(self, both: Column, a: Column, b: Column) -> Column:
        return both * self.den >= (a + b - both) * self.num

    def short_prefix(self, n: Column) -> Column:
        """Shingles of a set that must hold one in common with any set at least as large: n - ceil(2t / (1 + t) n) + 1."""
        return n - F.expr(f"cast((2 * {self.num} * n + {self.num + self.den - 1}) div {self.num + self.den} as int)") + 1

    def band(self, n: Column) -> Column:
        """Band of sizes: sets that reach the threshold stand in the same band or in neighbouring ones.  Any rounding is the same for one size."""
        return F.floor(F.log(n.cast("double")) / F.lit(math.log(self.den / self.num)) + F.lit(1e-6)).cast("int")


def _pairs(left: DataFrame, right: DataFrame, key: str, t: Threshold, more: Column | None = None) -> DataFrame:
    """Distinct pairs ``u > v`` of nodes that share ``key``."""
    a, b = left.alias("a"), right.alias("b")
    ok = (F.col(f"a.{key}") == F.col(f"b.{key}")) & t.sizes(F.col("a.n"), F.col("b.n"))
    ok = ok & (F.col("a.node") > F.col("b.node") if more is None else (F.col("a.node") != F.col("b.node")) & more)
    return a.join(b, ok).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    pairs = staged(pairs, "pairs")
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("x")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("items").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return staged(both.where(t.holds(shared, F.size("x"), F.size("y"))).select("u", "v"), "links")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the component of their node so far; those of keys that hold one component only are left out."""
    known = staged(components(links), "known")
    named = staged(rows.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    spans = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return named.join(staged(spans, "spans"), "key", "left_semi")


def _outside(rows: DataFrame) -> DataFrame:
    """Rows of each key that are not in the key's largest component."""
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("m"))
    top = staged(counts.groupBy("key").agg(F.max(F.struct("m", "component"))["component"].alias("top")), "top")
    return rows.join(top, "key").where("component != top").drop("top")


def _prefix_rows(rows: DataFrame, items_of: Callable[[DataFrame], DataFrame], t: Threshold) -> DataFrame:
    """``key`` (a shingle), ``node, n, component, at``: each node's first shingles in order of rarity."""
    nodes = staged(rows.select("node", "component").distinct(), "nodes")
    one = staged(items_of(nodes).join(nodes, "node").select("node", "component", F.size("items").alias("n"), F.explode("items").alias("key")), "tokens")
    rarity = staged(one.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "rarity")
    # shingles of one node only can't be shared: they only push the others back, so their number is enough
    shared = one.join(rarity, "key").groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("order"))
    alone = F.col("n") - F.size("order")
    first = shared.select("node", "component", "n", alone.alias("alone"), F.expr(f"slice(order, 1, greatest(0, n - cast(ceil(n * {t.num} / {t.den}) as int) + 1 - (n - size(order))))").alias("order"))
    return first.select("node", "component", "n", "alone", F.posexplode("order").alias("p", "o")).select(
        F.col("o.key").alias("key"), "node", "component", "n", (F.col("alone") + F.col("p")).alias("at")
    )


def _sized(larger: DataFrame, smaller: DataFrame, t: Threshold, more: Column) -> DataFrame:
    """Pairs of a set and one at most as large that share a shingle of the first one's prefix and of the second one's short prefix."""
    band = t.band(F.col("n"))
    a = larger.withColumn("band", F.explode(F.array(band, band - 1, band - 2)))
    b = smaller.where(F.col("at") < t.short_prefix(F.col("n"))).withColumn("band", band)
    spot = F.struct("key", "band")
    return _pairs(a.withColumn("spot", spot), b.withColumn("spot", spot), "spot", t, more & (F.col("a.n") >= F.col("b.n")))


def links(
    items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], t: Threshold,
    verify: Callable[[DataFrame, DataFrame, Threshold], DataFrame] = verified, shingles: Callable[[DataFrame], DataFrame] = lambda sets: sets,
    within: Callable[[DataFrame, DataFrame, Threshold, bool], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Verified ``u, v`` among ``items`` (``node, n, bands``: an id, its set size and its band keys; one row per node).

    ``sets_of`` gets a table of nodes and returns ``node, items`` (distinct shingle hashes).  Where sets are larger than what they are
    made from, it may return that instead: ``verify`` then confirms pairs on it, and ``shingles`` makes ``node, items`` of it.
    ``within`` gets ``key, node, component`` and the sets; it returns verified links that join the components of each key as far as
    its pairs do, and the keys that it left.  It is asked first for keys that one task can hold, then for those still open after the pivots.
    """
    rows = items.select("node", "n", F.explode("bands").alias("key"))
    ends = [F.count("*").alias("c"), F.min("node").alias("v"), F.max("node").alias("u"), F.min("n").alias("lo"), F.max("n").alias("hi")]
    many = staged(rows.groupBy("key").agg(*ends).where("c > 1"), "many")
    # most keys hold two nodes: these are the pair, so only the rows of the other keys are looked up
    two = many.where((F.col("c") == 2) & (F.col("u") > F.col("v")) & t.sizes(F.col("lo"), F.col("hi"))).select("u", "v")
    keys = staged(many.where("c > 2").select("key", "c"), "keys")
    some = items.select("node", "n", maybe_any("bands", keys, "key").alias("bands")).select("node", "n", F.explode("bands").alias("key"))
    more = staged(some.join(keys, "key"), "more")
    nodes = more.select("node").union(two.select("u")).union(two.select("v")).distinct()
    sets = staged(sets_of(nodes), "sets")
    small = more.where(F.col("c") <= SMALL)
    found = verify(two.union(_pairs(small, small, "key", t)).distinct(), sets, t)
    large = more.where(F.col("c") > SMALL).drop("c")
    if large.isEmpty():
        return found
    if within is not None:
        joined, left = within(large.select("key", "node", F.col("node").alias("component")), sets, t, True)
        found = staged(found.union(joined).distinct(), "links")
        large = large.join(left, "key", "left_semi")
        if large.isEmpty():
            return found
    large = staged(large.join(large.groupBy("node").agg(F.count("*").alias("degree")), "node"), "large")
    for _ in range(PIVOT_ROUNDS):
        open_rows = staged(_labelled(large, found), "open")
        if open_rows.isEmpty():
            return found
        outside = _outside(open_rows)
        best = outside.groupBy("key").agg(F.max(F.struct("degree", -F.col("node"), "node", "n", "component")).alias("p"))
        pivots = staged(best.select("key", F.col("p.node").alias("node"), F.col("p.n").alias("n"), F.col("p.component").alias("component")), "pivots")
        other = F.col("a.component") != F.col("b.component")
        found = staged(found.union(verify(_pairs(open_rows, pivots, "key", t, other), sets, t)).distinct(), "links")
    open_rows = staged(_labelled(large, found), "open")
    if open_rows.isEmpty():
        return found
    if within is not None:
        joined, left = within(open_rows.select("key", "node", "component"), sets, t, False)
        found = staged(found.union(joined).distinct(), "links")
        open_rows = open_rows.join(left, "key", "left_semi")
        if open_rows.isEmpty():
            return found
        open_rows = staged(_labelled(open_rows.drop("component"), found), "open")

    def items_of(nodes: DataFrame) -> DataFrame:
        return shingles(sets.join(nodes, "node", "left_semi"))

    first = staged(_prefix_rows(open_rows, items_of, t), "prefix")
    spans = staged(first.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "spans")
    first = staged(first.join(spans, "key", "left_semi"), "prefix")
    # at the first shingle two sets share, what follows it must be enough for the overlap the threshold needs
    need = F.ceil((F.col("a.n") + F.col("b.n")) * t.num / (t.den + t.num))
    room = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    more = (F.col("a.component") != F.col("b.component")) & (room >= need)
    outside = staged(_outside(first), "outside")
    rest = _sized(outside, first, t, more).union(_sized(first, outside, t, more)).distinct()
    return staged(found.union(verify(rest, sets, t)).distinct(), "links")
