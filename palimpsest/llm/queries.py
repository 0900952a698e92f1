"""All registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from palimpsest.llm import chat_query, extract_query, language_query, licenses_query, mixing_query, neighbours_query, pieces_query, quality_query, separators_query, simhash_query

MODULES = (separators_query, chat_query, licenses_query, extract_query, neighbours_query, language_query, quality_query, simhash_query, pieces_query, mixing_query)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
