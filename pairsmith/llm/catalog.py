"""Queries of this subpackage: thin wrappers that derive the agreed columns from each operator's output."""

from __future__ import annotations

from pairsmith.llm import chat_windows, decontaminate, html_text, language_id, near_duplicates, personal_data, piece_codec, sharding, token_count, vector_search

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (language_id, html_text, token_count, piece_codec, decontaminate, sharding, chat_windows, vector_search, personal_data, near_duplicates):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
