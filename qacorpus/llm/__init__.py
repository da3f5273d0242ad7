"""Operators for large training corpora, one module each, with their queries and SQL twins."""

from .base import ORACLES, QUERIES
from . import collocations, decontaminate, exact_dedup, html_blocks, language_id, line_dedup, merge_dropout, minhash_dedup, pii_crf, resharding, signature_join, warc, whitening  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
