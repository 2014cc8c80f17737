"""All queries of the core, and their SQL."""

from __future__ import annotations

from quotelens.plans import document_queries, match_queries, orphan_queries, source_queries

_MODULES = (match_queries, document_queries, orphan_queries, source_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = "validate_cascade"
