"""Queries over the driver tables: one per operator, each with its SQL twin where SQL can say it."""

from .base import ORACLES, QUERIES
from . import corpus, evaluation, monitoring, retrieval, scoring, splits, streams, texts  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
