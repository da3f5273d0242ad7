"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard verification, distributed union-find.

A line is a part of a text between line feeds, compared after trimming white space and lower-casing A-Z.  Its set is its distinct
shingles of ``CHARS`` characters (a shorter line is one shingle).  One permutation gives all coordinates of a line's signature: a
shingle costs one place, not ``COORDINATES``.  Lines of similarity 0.85 or more are linked (a pair right at
the limit is missed with a chance of 6e-4 or less, one of 0.9 with 2e-5), every link is verified on the full sets, and of each component
the first line by (document id, row, line number) stays; copies of one line are one node.  Blank lines are kept, they belong to
no component.

Null texts stay null with zero lines; empty texts have no line.  Of rows that repeat whole one keeps its lines and the others lose all.  A
null document id comes before all others.  Extra columns don't matter.  No rows give no rows.  Lines are told apart by 128-bit hashes
and numbered once for union-find.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, staged, table
from .bitmaps import maybe_in
from .circulant import SEED, mix, odd
from .components import components
from .near import Threshold, links

CHARS, COORDINATES, ROWS = 8, 40, 4
LIKE = Threshold(85, 100)
#: Shingles in hand at a time: they stay in the processor's cache.
CHUNK = 16_000
#: Lines and characters of a bucket's tile, and tiles of a bucket: a line is copied once for each tile that its own one meets.
TILE, TILE_CHARS, TILES = 512, 4_000_000, 8
#: Bins of the counts that bound what two lines share.
BINS, ABREAST = 256, 16
#: Characters of lines in one batch of results, and lines that a task remembers as signed.
HELD, MET = 1_000_000, 1 << 18
#: A coordinate without a shingle; above all values.
EMPTY = np.uint64(1 << 32)


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """Hashes of the characters of the basic plane."""
    return mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines, one after the other, and the number of each line.  Lines aren't empty."""
    pad = "\0" * (CHARS - 1)
    points = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _characters()[points] if points.max() < 1 << 16 else mix(points.astype(np.uint64) + np.uint64(1))
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < CHARS:  # polynomials over 2, 4, 8 characters
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor & (1 << 64) - 1
    sizes = np.array([len(x) for x in lines])
    counts = np.maximum(sizes - CHARS + 1, 1)
    first = np.cumsum(sizes + CHARS - 1) - (sizes + CHARS - 1)
    return mix(np.concatenate([h[a : a + c] for a, c in zip(first.tolist(), counts.tolist())])), counts


def chunks(lines: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for x in lines:
        part.append(x)
        held += len(x)
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """Where an empty place looks for a value: every place in an order of its own, the same for all lines."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return np.argsort(rng.random((COORDINATES, COORDINATES)), axis=1).T


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash by one permutation: the upper half of a shingle's hash tells its coordinate, the least lower half there is the value.

    A coordinate without a shingle takes the value of the first filled one in its own order of all coordinates (densification).
    """
    sig = np.full(len(counts) * COORDINATES, EMPTY, np.uint64)
    place = ((h >> np.uint64(32)) * np.uint64(COORDINATES)) >> np.uint64(32)
    np.minimum.at(sig, np.repeat(np.arange(len(counts)) * COORDINATES, counts) + place.astype(np.int64), h & np.uint64(0xFFFFFFFF))
    sig = sig.reshape(-1, COORDINATES)
    own = sig.copy()
    for donor in _donors():
        line, at = np.nonzero(sig == EMPTY)
        if not len(line):
            break
        sig[line, at] = own[line, donor[at]]
    return sig


def line_bands(lines: list[str]) -> np.ndarray:
    """Band keys of each line."""
    return np.concatenate([np.zeros((0, COORDINATES // ROWS), np.int64), *(_bands(signatures(*shingle_hashes(part))) for part in chunks(lines))])


def _bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature; the band's number is part of the key."""
    parts = sig.reshape(len(sig), -1, ROWS)
    h = (mix(parts) * odd(ROWS, 4)).sum(axis=2, dtype=np.uint64) + np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h).view(np.int64)


def normal_lines(text: str) -> list[str]:
    """Lines as they are compared: A-Z lower-cased, trimmed."""
    return [part.strip(" \t\r\x0b\x0c") for part in text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").split("\n")]


def _spots(rows: DataFrame) -> DataFrame:
    """``id, row, at, a, b, bands`` of every line that isn't blank, in one pass over ``id, row, text``.

    ``a, b`` are 128 bits of a hash of the line.  Only the first time that a task meets a line (as far as it remembers) it is signed;
    elsewhere ``bands`` is null.
    """

    def out(batch: pa.RecordBatch, docs: list[int], ats: list[int], lines: list[str], met: set[bytes]) -> pa.RecordBatch:
        digests = [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
        fresh = np.zeros(len(lines), bool)
        for k, d in enumerate(digests):
            if d not in met:
                fresh[k] = True
                if len(met) < MET:
                    met.add(d)
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        bands = line_bands([x for x, new in zip(lines, fresh) if new])
        offsets = np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32) * (COORDINATES // ROWS)
        signed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()), mask=pa.array(~fresh))
        of = pa.array(docs, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(of), batch.column(1).take(of), pa.array(ats, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), signed],
            names=["id", "row", "at", "a", "b", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            docs, ats, lines, held = [], [], [], 0
            for k, text in enumerate(batch.column(2)):
                for at, line in enumerate(normal_lines(text.as_py())):
                    if line:
                        docs.append(k)
                        ats.append(at)
                        lines.append(line)
                        held += len(line)
                        if held >= HELD:
                            yield out(batch, docs, ats, lines, met)
                            docs, ats, lines, held = [], [], [], 0
            if lines:
                yield out(batch, docs, ats, lines, met)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row long, at int, a long, b long, bands array<long>")


def _lines_at(texts: DataFrame) -> DataFrame:
    """``node, line`` from ``text, places`` (line numbers and nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lines = [], []
            for text, places in zip(batch.column(0), batch.column(1).to_pylist()):
                every = normal_lines(text.as_py())
                for p in places:
                    if p["at"] < len(every):
                        nodes.append(p["node"])
                        lines.append(every[p["at"]])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], names=["node", "line"])

    return texts.mapInArrow(run, "node long, line string")


def _sets(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for part in chunks(batch.column(1).to_pylist()):
                h, counts = shingle_hashes(part)
                sets.extend(np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(counts)[:-1]))
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["node", "items"])

    return lines.mapInArrow(run, "node long, items array<long>")


def same_lines(xs: list[str], ys: list[str], t: Threshold) -> np.ndarray:
    """Which pairs of lines reach the threshold on their full sets."""
    h, counts = shingle_hashes([line for pair in zip(xs, ys) for line in pair])
    line = np.repeat(np.arange(len(counts)), counts)
    pair = line >> 1
    # the lowest bit of a shingle tells the line it is from, so both lines' copies of one shingle stand together
    key = (h & ~np.uint64(1)) | (line & 1).astype(np.uint64)
    order = np.lexsort((key, pair))
    key, pair = key[order], pair[order]
    new, other = np.ones(len(key), bool), np.ones(len(key), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])
    other[1:] = (pair[1:] != pair[:-1]) | (key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1))
    total, union = np.bincount(pair[new], minlength=len(xs)), np.bincount(pair[other], minlength=len(xs))
    return t.holds(total - union, total, 0)


def verified_lines(pairs: DataFrame, lines: DataFrame, t: Threshold) -> DataFrame:
    """Pairs ``u, v`` whose lines reach the threshold.  Lines travel with the pairs, an eighth of what their sets would take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, a, held = [], 0, 0
            for k, (x, y) in enumerate(zip(xs, ys), 1):
                held += len(x) + len(y)
                if held >= CHUNK or k == len(xs):
                    keep.append(same_lines(xs[a:k], ys[a:k], t))
                    a, held = k, 0
            if keep:
                yield batch.select(["u", "v"]).filter(pa.array(np.concatenate(keep)))

    pairs = staged(pairs, "pairs")
    left = pairs.join(lines.select(F.col("node").alias("u"), F.col("line").alias("x")), "u")
    both = left.join(lines.select(F.col("node").alias("v"), F.col("line").alias("y")), "v")
    return staged(both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "links")


def tile_links(lines: list[str], component: np.ndarray, tile: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Links between lines of two tiles (or of one, if there is just that) that join components which no link joined before.

    Counts of shingles by the upper bits of their hash bound what two lines share, which leaves few pairs for their full sets.
    """
    sets = []
    for part in chunks(lines):
        h, counts = shingle_hashes(part)
        sets.extend(np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1]))
    n = np.array([len(x) for x in sets])
    spot = np.repeat(np.arange(len(n)) * BINS, n) + (np.concatenate(sets) >> np.uint64(56)).astype(np.int64)
    bins = np.bincount(spot, minlength=len(n) * BINS).reshape(-1, BINS)
    bins = bins.astype(np.uint8 if bins.max() < 256 else np.uint32)
    component = np.unique(component, return_inverse=True)[1]
    crossed = tile.min() != tile.max()
    found = []
    for k in range(1, len(n), ABREAST):  # some lines with all lines before them at a time
        rows = np.arange(k, min(k + ABREAST, len(n)))
        most = np.minimum(bins[rows, None], bins[None, : rows[-1]]).sum(axis=2, dtype=np.int32)
        near = t.holds(most, n[rows, None], n[None, : rows[-1]]) & (component[rows, None] != component[None, : rows[-1]])
        near &= rows[:, None] > np.arange(rows[-1])
        if crossed:
            near &= tile[rows, None] != tile[None, : rows[-1]]
        for x, m in zip(*(ends.tolist() for ends in np.nonzero(near))):
            x += k
            if component[m] != component[x] and t.holds(len(np.intersect1d(sets[m], sets[x], assume_unique=True)), n[m], n[x]):
                found.append((m, x))
                component[component == component[m]] = component[x]
    return found


def linked_tiles(rows: DataFrame, lines: DataFrame, t: Threshold, one: bool) -> tuple[DataFrame, DataFrame]:
    """Verified ``u, v`` that join the components of each ``key`` of ``one`` or up to ``TILES`` tiles, and the keys of more.

    Every two lines of a key meet in a task that holds two tiles; what a task holds and how often a line is copied is bounded.
    """

    def run(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        found = tile_links(group.column("line").to_pylist(), group.column("component").to_numpy(), group.column("tile").to_numpy(), t)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        ends = np.sort(node[pairs], axis=1)
        return pa.table({"u": ends[:, 1], "v": ends[:, 0]})

    sized = rows.join(lines.select("node", F.char_length("line").alias("chars")), "node").groupBy("key").agg(F.count("*").alias("m"), F.sum("chars").alias("chars"))
    keys = staged(sized.select("key", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("chars") / TILE_CHARS)).cast("int").alias("tiles")), "tiles")
    few = F.col("tiles") <= (1 if one else TILES)
    fit = rows.join(keys.where(few), "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    met = fit.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", "component")
    out = met.join(lines, "node").groupBy("key", "p", "q").applyInArrow(run, "u long, v long")
    return staged(out.distinct(), "links"), keys.where(~few).select("key")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Threshold = LIKE) -> DataFrame:
    """One row per input row: ``id, text`` (without the dropped lines), ``n_lines``, ``n_dropped``, ``dropped`` (line numbers from 0)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    spots = staged(_spots(rows.where("text != ''")), "spots")
    # every different line once; a line that stands in very many documents leaves each task once
    counted = spots.groupBy("a", "b").agg(
        F.min(F.struct("id", "row", "at")).alias("first"), F.first("bands", ignorenulls=True).alias("bands"), F.count("*").alias("c"))
    lines = staged(counted.withColumn("node", F.monotonically_increasing_id()), "lines")
    # the set sizes a pair may have aren't looked at before it is verified: band keys tell more
    items = lines.select("node", F.lit(1).alias("n"), "bands")

    def lines_of(nodes: DataFrame) -> DataFrame:
        """The text of a line from its first place alone, so that copies don't meet in one task."""
        own = lines.join(nodes, "node").groupBy("first.id", "first.row").agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "node")).alias("places"))
        own = staged(own.select(F.xxhash64("id", "row").alias("spot"), "places"), "places")
        texts = rows.where("text != ''").select(F.xxhash64("id", "row").alias("spot"), "text")
        return _lines_at(maybe_in(texts, "spot", own, "spot").join(own, "spot").select("text", "places")).dropDuplicates(["node"])

    found = staged(components(links(items, lines_of, like, verified_lines, _sets, linked_tiles)), "components")
    named = staged(lines.select("a", "b", "c", "node", "first").join(found, "node", "left"), "named")
    # the line that stays, only for components of more than one node; lines that stand once and by themselves stay anyway
    stays = staged(named.where("component is not null").groupBy("component").agg(F.min("first").alias("stay")), "stays")
    nodes = staged(named.where("c > 1 or component is not null").join(stays, "component", "left").select("a", "b", F.coalesce("stay", "first").alias("stay")), "stay")
    places = maybe_in(spots.select("id", "row", "at", "a", "b"), "a", nodes, "a")
    gone = places.join(nodes, ["a", "b"]).where(~F.struct("id", "row", "at").eqNullSafe(F.col("stay")))
    dropped = gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("at")).alias("dropped"))
    # rows that repeat whole: one of them keeps its lines, the others drop all
    again = rows.groupBy("id", "row").agg(F.count("*").alias("m")).where("m > 1")
    marks = staged(dropped.select("id", "row", "dropped", F.lit(None).cast("long").alias("m")).union(again.select("id", "row", F.lit(None).cast("array<int>"), "m"))
                   .groupBy("id", "row").agg(F.max("dropped").alias("dropped"), F.max("m").alias("m")), "marks")
    none = F.array().cast("array<int>")
    met = rows.alias("d").join(marks.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.row") == F.col("g.row")), "left")
    met = met.select("d.id", "d.text", F.coalesce("g.dropped", none).alias("dropped"), "g.m")
    out = met.where("m is null").select("id", "text", "dropped")
    if not marks.where("m is not null").isEmpty():
        full = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), _bare(x).alias("x"))), lambda p: p["x"] != ""), lambda p: p["i"])
        repeated = met.where("m is not null").groupBy("id", "text", "dropped").agg(F.count("*").alias("m")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m"))))
        out = out.union(repeated.select("id", "text", F.when(F.col("k") == 1, F.col("dropped")).otherwise(F.coalesce(full, none)).alias("dropped")))
    # lines are cut behind the join, which moves each text once
    out = out.withColumn("parts", F.split("text", "\n"))
    kept = F.filter("parts", lambda x, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("text").isNull() | (F.size("dropped") == 0), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter("parts", lambda x: _bare(x) != "")).cast("long"), F.lit(0).cast("long"))
    return out.select("id", text.alias("text"), n_lines.alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


@query("op2_fuzzy_line_dedup")
def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
