"""All registered queries."""

from . import corpus_queries, retrieval_queries  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
