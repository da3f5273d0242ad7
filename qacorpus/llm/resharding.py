"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the block transfers that move the fewest bytes.

Law ``bytes``: sizes of the new shards are near equal.  The flow network has one node per old and per new shard (a number fixed
by the caller, not by the data); an arc from old shard i to new shard j costs 0 a byte when j = i (the data stays) and 1
otherwise, or what the caller's ``cost`` says.  Its solution gives every old shard a list of byte ranges and their new shards.

Rows of an old shard are lined up in blocks, large size classes first, so that cuts between ranges fall among small rows and
shards differ from their capacity by little more than such a row.  A block is a bounded number of rows, spread by hash, so
no task holds a shard: positions in a shard are the totals of the blocks before plus a running sum inside the block.

Null text counts 0 bytes (a row has 8 bytes besides).  Null or repeated ids and repeated rows are rows like any others, each
gets a slot of its own.  No rows give no rows.  Extra columns are carried into the files; ``_``-prefixed names used here
(``_size``, ``_crc``, ``_old``, ``_block``, ``_shard``, ``_slot``) are replaced if the input has them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from qacorpus.session import new_path

from .base import query, staged, table

#: Rows of a block, unless a size class of a shard would then have more than CLASS_BLOCKS of them.
BLOCK_ROWS, CLASS_BLOCKS = 128, 4_000
ROW_BYTES = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at the least total cost: successive shortest paths with potentials.

    The graph has ``len(supply) + len(capacity) + 2`` nodes whatever the data holds.
    """
    assert sum(supply) <= sum(capacity), "capacities must hold all bytes"
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    arcs: list[list[int]] = []  # to, left, cost; arc k ^ 1 is the way back
    out: list[list[int]] = [[] for _ in range(m + n + 2)]

    def add(a: int, b: int, cap: int, c: int) -> None:
        out[a].append(len(arcs))
        arcs.append([b, cap, c])
        out[b].append(len(arcs))
        arcs.append([a, 0, -c])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
        for j in range(n):
            add(i, m + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        add(m + j, sink, c, 0)
    potential = [0] * len(out)
    left = sum(supply)
    while left:
        best, via, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for k in out[a]:
                b, cap, c = arcs[k]
                if cap and (e := d + c + potential[a] - potential[b]) < best.get(b, 1 << 62):
                    best[b], via[b] = e, k
                    heapq.heappush(heap, (e, b))
        far = max(best.values())
        for a in range(len(out)):
            potential[a] += best.get(a, far)
        path, b = [], sink
        while b != source:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        step = min(left, *(arcs[k][1] for k in path))
        for k in path:
            arcs[k][1] -= step
            arcs[k ^ 1][1] += step
        left -= step
    return {(i, arcs[k][0] - m): arcs[k ^ 1][1] for i in range(m) for k in out[i] if k % 2 == 0 and m <= arcs[k][0] < m + n and arcs[k ^ 1][1]}


def even_capacity(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text",
            cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Rows with ``_size``, ``_crc``, ``_old``, ``_shard``, ``_slot``, and the flow they follow.

    ``old_shard`` is a shard number below ``n_old`` (null: shard 0).  Columns of ``docs`` with one of the names used here are replaced.  Rows of :func:`affected` shards are written anew with their
    texts, one folder per new shard, under the shared folder; the files of the other shards stay as they are.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    taken = ["_size", "_crc", "_old", "_class", "_block", "_blocks", "_shard", "_slot", "_at", "_start", "_tie", "_offset"]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    sized = docs.drop(*[c for c in taken if c in docs.columns]).withColumns(
        {"_size": size, "_crc": F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), "_old": F.coalesce(old_shard.cast("int"), F.lit(0))}
    ).withColumn("_class", F.floor(F.log2(F.col("_size"))).cast("int"))
    # at most n_old x 40 rows
    classes = sized.groupBy("_old", "_class").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()
    supply = [0] * n_old
    for r in classes:
        supply[r["_old"]] += r["b"]
    flow = min_cost_flow(supply, even_capacity(sum(supply), n_new), cost)
    blocks = spark.createDataFrame([(r["_old"], r["_class"], 1 + min(CLASS_BLOCKS, r["n"] // BLOCK_ROWS)) for r in classes], "_old int, _class int, _blocks long")
    # a row's block: its size class and a hash; the bounded table above gives the number of blocks of the class
    spread = F.xxhash64(F.col(id_col), F.col("_crc"))
    placed = sized.join(F.broadcast(blocks), ["_old", "_class"]).withColumn("_block", F.pmod(spread, F.col("_blocks")).cast("int")).drop("_blocks")
    key = ["_old", "_class", "_block"]
    totals = placed.groupBy(*key).agg(F.sum("_size").alias("bytes"))
    line = W.partitionBy("_old").orderBy(F.desc("_class"), "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = staged(totals.select(*key, F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("_start")), "starts")

    cuts = []  # byte ranges of each old shard: what stays comes first
    for i in range(n_old):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            cuts.append((i, j, at, at + flow[i, j]))
            at += flow[i, j]
    ranges = F.create_map(*[x for i in range(n_old) for x in (
        F.lit(i), F.array(*[F.struct(F.lit(j).alias("j"), F.lit(b).cast("long").alias("end")) for a, j, _, b in cuts if a == i])
        if any(c[0] == i for c in cuts) else F.array().cast("array<struct<j:int,end:bigint>>"))])
    inside = W.partitionBy(*key).orderBy(F.desc("_size"), id_col, "_crc")
    at = F.col("_start") + F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    moved = placed.join(starts, key).withColumn("_at", at).withColumn(
        "_shard", F.element_at(F.filter(F.element_at(ranges, F.col("_old")), lambda r: r["end"] > F.col("_at")), 1)["j"]
    ).withColumn("_tie", F.row_number().over(inside)).drop("_start")
    touched = F.col("_old").isin(sorted(affected(flow)))
    path = new_path(spark, "llm-shards")
    moved.where(touched).write.partitionBy("_shard").parquet(path)
    files = spark.read.schema(moved.schema).parquet(path)
    if set(range(n_old)) - affected(flow):
        files = files.unionByName(moved.where(~touched))
    # gapless slots: rows of the shard in the blocks before, plus the place inside the block
    runs = files.groupBy("_shard", *key).agg(F.count("*").alias("rows"), F.min("_tie").alias("first"))
    order = W.partitionBy("_shard").orderBy("_old", F.desc("_class"), "_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = staged(runs.select("_shard", *key, (F.coalesce(F.sum("rows").over(order), F.lit(0)) - F.col("first")).alias("_offset")), "offsets")
    out = files.join(offsets, ["_shard", *key]).withColumn("_slot", F.col("_offset") + F.col("_tie"))
    return out.drop("_class", "_block", "_at", "_tie", "_offset"), flow


def affected(flow: dict[tuple[int, int], int]) -> set[int]:
    """Shards that lose or gain bytes: only their files differ after the move."""
    return {x for (i, j) in flow if i != j for x in (i, j)}


@query("op1_reshard_min_cost_flow")
def op1_reshard_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards that keep every source together (so one is very large) to 24 of equal size."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8")), F.lit(16))
    rows, _ = reshard(docs, old, 16, 24)
    return rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_old").alias("old_shard"),
    )
