"""Every registered query of the keyed index, with its oracle SQL."""

from __future__ import annotations

from . import browse_queries, evaluate_queries, fact_queries, recall_queries, source_queries, text_queries, upsert_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
