"""Evaluate an expensive column once although a later filter uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = "_fence"


def compute(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a fence.

    Catalyst pushes a filter below the projection that computes its input, which copies the expression
    into the filter: text would be cleaned once to test it and again to keep it.  Filters do not pass a
    projection that holds a random value, so :func:`keep` after ``compute`` runs on finished columns.
    """
    return df.withColumns({**columns, _FENCE: F.rand(0)})


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns made by :func:`compute`."""
    return df.where(condition & (F.col(_FENCE) >= 0)).drop(_FENCE)
