"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct shingles of five words (A-Z lower-cased, words divided by ASCII white space; fewer words are one
shingle).  Documents with equal sets form one class, the node of all that follows; classes get circulant MinHash signatures of
``COORDINATES`` values in bands of ``ROWS`` (a pair of similarity 0.75 is missed with a chance of 5e-6), and links between classes
are verified on full sets (see :mod:`.near`).  Components come from a distributed union-find.

Null or empty texts have no set: size 0, linked with nothing.  An id on several rows is one document: the classes of its texts hang
together.  Rows with a null id link like others; they get the smallest id of their component, null where it has none.
Repeated rows are repeated in the result; other columns don't matter.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, staged, table
from .bitmaps import maybe_in
from .circulant import band_keys, set_hash, shingle_set, signature
from .components import components
from .near import Threshold, links

WORDS, COORDINATES, ROWS = 5, 128, 4
#: Sets that a task of the verification remembers.
KNOWN = 256
LIKE = Threshold(75, 100)


def _described(docs: DataFrame, words: int) -> DataFrame:
    """``id, node, n, h1, h2, bands`` of every row of ``id, node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, bands = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                a, b = set_hash(s) if len(s) else (0, 0)
                h1.append(a)
                h2.append(b)
                bands.append(band_keys(signature(s, COORDINATES), ROWS) if len(s) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                names=["id", "node", "n", "h1", "h2", "bands"],
            )

    return docs.mapInArrow(run, "id long, node long, n int, h1 long, h2 long, bands array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``node, items`` of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), words).view(np.int64) for text in batch.column(1)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["node", "items"])

    return texts.mapInArrow(run, "node long, items array<long>")


def _verify(words: int):
    """Pairs whose full sets reach the threshold.  Texts travel with the pairs, less than half of what their sets would take."""

    def verified_texts(pairs: DataFrame, texts: DataFrame, t: Threshold) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, np.ndarray] = {}

            def set_of(node: int, text: pa.Scalar) -> np.ndarray:
                if node not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[node] = shingle_set(text.as_py(), words)
                return known[node]

            for batch in batches:
                keep = []
                for u, v, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                    a, b = set_of(v, y), set_of(u, x)
                    keep.append(bool(t.holds(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        pairs = staged(pairs, "pairs")
        left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
        both = left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
        return staged(both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "links")

    return verified_texts


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, like: Threshold = LIKE) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``."""
    # a row's spot tells its text again without shuffling the copies of a text
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    every = staged(_described(texts, words), "described")
    sets = every.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("first"), F.min("node").alias("spot"))
    classes = staged(sets.withColumn("class", F.monotonically_increasing_id()), "classes")
    owners = every.select("h1", "h2", "n", F.col("node").alias("spot"), "bands").join(classes, ["h1", "h2", "n", "spot"])
    items = owners.select(F.col("class").alias("node"), "n", "bands").dropDuplicates(["node"])

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = staged(classes.select(F.col("class").alias("node"), "spot").join(nodes, "node"), "wanted")
        some = maybe_in(texts.where(F.col("text").isNotNull()).withColumnRenamed("node", "spot"), "spot", wanted, "spot")
        return some.join(wanted, "spot").groupBy("node").agg(F.first("text").alias("text"))

    rows = staged(every.join(classes.select("h1", "h2", "n", "class"), ["h1", "h2", "n"], "left").select("id", "n", "class"), "rows")
    linked = links(staged(items, "items"), texts_of, like, _verify(words), lambda some: _sets(some, words))
    joined = components(linked.union(shared_ids(rows)))
    named = classes.select(F.col("class").alias("node"), "first").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = staged(named.join(staged(smallest, "smallest"), "component").select(F.col("node").alias("class"), "component_id"), "components")
    out = rows.join(named, "class", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def shared_ids(rows: DataFrame) -> DataFrame:
    """``u, v``: classes (``class``) in which one id stands."""
    spans = rows.where("id is not null and class is not null").groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
    return rows.join(spans, "id").where("class > lo").select(F.col("class").alias("u"), F.col("lo").alias("v"))


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
