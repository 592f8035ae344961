"""Registered queries and their SQL."""

from __future__ import annotations

from bidgraph.plans import document_queries, model_queries, network_queries, portfolio_queries, risk_queries, stream_queries, view_queries
from bidgraph.plans import analysis_queries, case_queries, ingest_queries, lookup_queries, record_queries, store_queries  # they use parts of the others' SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (risk_queries, portfolio_queries, network_queries, model_queries, document_queries, view_queries, stream_queries, case_queries, analysis_queries, ingest_queries, store_queries, lookup_queries, record_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
