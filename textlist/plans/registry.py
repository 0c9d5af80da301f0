"""All queries of the library and their SQL."""

from __future__ import annotations

from . import line_queries, rule_queries, table_queries

BOOKS = [line_queries.book, rule_queries.book, table_queries.book]
QUERIES = {name: query for book in BOOKS for name, query in book.queries.items()}
ORACLES = {name: sql for book in BOOKS for name, sql in book.oracles.items()}
