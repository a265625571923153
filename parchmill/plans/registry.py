"""Queries by name and the SQL that each must agree with."""

from __future__ import annotations

from parchmill.plans import clause_queries, corpus_queries, document_queries, intake_queries, stream_queries, text_queries

PARTS = (text_queries, corpus_queries, clause_queries, intake_queries, document_queries, stream_queries)

QUERIES: dict = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in PARTS for k, s in p.SQL.items()}
