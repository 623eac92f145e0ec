"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import catalog_queries, chunk_queries, evidence_queries, function_queries, identity_queries, quality_queries, review_queries, rule_queries, text_queries, timeline_queries  # noqa: F401  (they register their queries)
from .base import ORACLE_SQL, QUERIES

FLAGSHIP = "locate_quotes"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
