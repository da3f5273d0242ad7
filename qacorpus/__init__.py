"""qacorpus: curate, split, evaluate, search and monitor Q&A corpora with PySpark."""

from .lexicon import MEDICAL, Profile

__all__ = ["MEDICAL", "Profile"]
