"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors become whole numbers ``x = floor(256 c)``; every different ``x`` counts once.  Tasks add up counts, sums and centred products
in numpy, Spark adds the tasks' parts by place, and only ``d`` sums and ``d * d`` products (``d`` the width) reach the driver.
There the scatter is factored with pivots, ``P V P' = L L'``, and the columns of ``L`` are rotated against each other until they are
orthogonal: ``L J = U D``.  Their norms squared are eigenvalues, the normalised columns are components.  No eigenvalue is squared
away on the way, so small ones keep their digits.

Rows whose vector is null or holds null, NaN or infinite entries are dropped.  All vectors must have one width: the most common one of
the table (the larger one in a tie) counts, rows of other widths, the empty one included, are dropped as well.  Null ids, repeated
rows and ids stay.  Entries whose ``floor(256 c)`` leaves 64 bits take the nearest long; ``deviation`` is null where it leaves
64 bits.  Components of eigenvalue zero (rank below four, or a single different vector) have no rows.  Equal eigenvalues: some
orthogonal choice, the same for all rows.  Extra columns don't matter.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, staged, table

SCALE, COMPONENTS = 256, 4
_LOW = (1 << 32) - 1
SCHEMA = "id {kind}, component int, n long, deviation long, whitened double, explained double"


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``L`` (d x rank, rows in pivot order) and the order, for a positive semidefinite ``v``; stops at rounding noise."""
    d = len(v)
    order, left = np.arange(d), v.diagonal().copy()
    floor = d * np.finfo(float).eps * max(float(left.max(initial=0.0)), 0.0)
    factor = np.zeros((d, d))
    for k in range(d):
        p = k + int(np.argmax(left[order[k:]]))
        if not left[order[p]] > floor:
            return factor[:, :k], order
        order[[k, p]] = order[[p, k]]
        factor[[k, p], :k] = factor[[p, k], :k]
        pivot = np.sqrt(left[order[k]])
        factor[k, k] = pivot
        below = order[k + 1 :]
        factor[k + 1 :, k] = (v[below, order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / pivot
        left[below] -= factor[k + 1 :, k] ** 2
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate the columns against each other until every two are orthogonal to rounding."""
    a, r = factor.copy(), factor.shape[1]
    for _ in range(sweeps):
        turned = False
        for i in range(r - 1):
            for j in range(i + 1, r):
                x, y = a[:, i], a[:, j]
                p, q, s = x @ x, y @ y, x @ y
                if abs(s) <= 1e-15 * np.sqrt(p * q):
                    continue
                turned = True
                zeta = (q - p) / (2 * s)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            return a
    return a


def principal(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``v`` and their unit eigenvectors (columns, largest entry positive)."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    values = (turned**2).sum(axis=0)
    top = np.argsort(-values, kind="stable")[:count]
    vectors = np.zeros((len(v), len(top)))
    vectors[order] = turned[:, top] / np.sqrt(values[top])
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(top))]) if len(v) else np.ones(0)
    return values[top], vectors * signs


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _added(parts: DataFrame) -> dict[int, tuple[int, float]]:
    """Sums by place, ``at, whole, real``; at most d * d rows."""
    total = parts.groupBy("at").agg(F.sum(F.col("whole").cast("decimal(38,0)")).alias("whole"), F.sum("real").alias("real"))
    return {r["at"]: (int(r["whole"]), r["real"]) for r in total.collect()}


def _rows(at: np.ndarray, whole: np.ndarray, real: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(whole, pa.int64()), pa.array(real, pa.float64())], names=["at", "whole", "real"])


def column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """``n`` and the exact sum of each dimension of ``fit`` (``x``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:  # halves of 32 bits can't leave 64 bits in one task
            x = _matrix(batch.column(0), width)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & _LOW).sum(axis=0)
        yield _rows(np.arange(2 * width + 1), np.concatenate([high, low, [n]]), np.zeros(2 * width + 1))

    sums = _added(fit.mapInArrow(run, "at int, whole long, real double"))
    return sums[2 * width][0], [(sums[k][0] << 32) + sums[width + k][0] for k in range(width)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``: the whole part is taken off exactly, so large values with a small spread keep their digits."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def covariance(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((width, width))
        for batch in batches:
            c = centred(_matrix(batch.column(0), width), n, sums)
            scatter += c.T @ c
        yield _rows(np.arange(width * width), np.zeros(width * width, np.int64), scatter.ravel())

    parts = _added(fit.mapInArrow(run, "at int, whole long, real double"))
    v = np.array([parts[k][1] for k in range(width * width)]).reshape(width, width) / n
    return (v + v.T) / 2


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of ``(n x - S)^2`` of each row, exact; null where it leaves 64 bits."""
    rough = (((x.astype(float) - np.array([s / n for s in sums])) * n) ** 2).sum(axis=1)
    if (rough < 2.0**62).all() and n < 1 << 62:  # then no term leaves 64 bits: every n x - S is below 2^31
        s = np.array([v % (1 << 64) for v in sums], np.uint64).view(np.int64)
        return pa.array(((x * n - s) ** 2).sum(axis=1), pa.int64())
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each kept row and component."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("c")).where(
        F.col("c").isNotNull() & F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    )
    kind = vectors.schema["id"].dataType.simpleString()
    whole = vectors.select("id", F.transform("c", lambda c: F.floor(c.cast("double") * F.lit(float(SCALE)))).alias("x"))
    widths = whole.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("w")).limit(1).collect()
    width = widths[0]["w"] if widths else 0
    none = spark.createDataFrame([], SCHEMA.format(kind=kind) + ", identity_error double")
    if not width:
        return none
    whole = whole.where(F.size("x") == width)
    fit = staged(whole.select("x").distinct(), "fit")
    n, sums = column_sums(fit, width)
    v = covariance(fit, width, n, sums)
    values, axes = principal(v, count)
    k, trace = len(values), float(v.trace())
    if not k:
        return none
    scaled = axes / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = centred(_matrix(batch.column(0), width), n, sums) @ scaled
            yield pa.RecordBatch.from_arrays([pa.array(z[:, j]) for j in range(k)], names=[f"z{j}" for j in range(k)])

    z = staged(fit.mapInArrow(project, ", ".join(f"z{j} double" for j in range(k))), "projected")
    mean = z.agg(*[F.avg(c).alias(c) for c in z.columns]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = z.agg(*[F.avg((F.col(f"z{i}") - mean[i]) * (F.col(f"z{j}") - mean[j])) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(products, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            rows_of = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows_of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                 deviations(x, n, sums).take(rows_of), pa.array((centred(x, n, sums) @ scaled).ravel()), pa.array(np.tile(values / trace, m))],
                names=["id", "component", "n", "deviation", "whitened", "explained"])

    return whole.mapInArrow(run, SCHEMA.format(kind=kind)).withColumn("identity_error", F.lit(float(error)))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
