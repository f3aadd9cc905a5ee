"""Registered queries over the test tables, each with its SQL where there is one."""

from . import corpus_queries, evaluation_queries, feature_queries, loader_queries  # noqa: F401
from . import modality_queries, sequence_queries, stream_queries, token_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
