"""Maps of a fixed number of bits that tell tasks which 64-bit keys may matter: they only save work, whatever the table's size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 16 MB.
MAP_BITS = 27


def bit_map(keys: DataFrame, column: str) -> np.ndarray:
    """A map in which the bit of every key is set; at most its own 16 MB, twice, reach the driver, however many keys there are."""
    at = keys.select(F.shiftrightunsigned(F.col(column), 64 - MAP_BITS).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def maybe(df: DataFrame, column: str, keys: DataFrame, key: str) -> Column:
    """Whether the 64-bit ``column`` (no nulls) of a row may be among ``keys``; false for most values that are not."""
    shared = df.sparkSession.sparkContext.broadcast(bit_map(keys, key))

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        return pa.array(in_map(shared.value, values.to_numpy(zero_copy_only=False).view(np.uint64)))

    return test(column)


def maybe_any(column: str, keys: DataFrame, key: str) -> Column:
    """Those entries of the array ``column`` (64 bits, no nulls in it) that may be among ``keys``; null where it is null."""
    shared = keys.sparkSession.sparkContext.broadcast(bit_map(keys, key))

    @F.arrow_udf("array<long>")
    def test(values: pa.Array) -> pa.Array:
        flat = values.flatten()
        found = in_map(shared.value, flat.to_numpy(zero_copy_only=False).view(np.uint64))
        sizes = np.where(values.is_null().to_numpy(zero_copy_only=False), 0, values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        before = np.concatenate([[0], np.cumsum(found)])
        offsets = before[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(found)), mask=values.is_null())

    return test(column)


def maybe_in(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` (64 bits, no nulls) may be among ``keys``: what can't match isn't shuffled by the join that follows."""
    return df.where(maybe(df, column, keys, key))
