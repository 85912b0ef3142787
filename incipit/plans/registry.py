"""Registered queries of the library and their oracle SQL."""

from incipit.plans import book_queries, layout_queries, queries, text_queries

QUERIES = queries.QUERIES | text_queries.QUERIES | book_queries.QUERIES | layout_queries.QUERIES
ORACLES = queries.ORACLES | text_queries.ORACLES | book_queries.ORACLES | layout_queries.ORACLES

__all__ = ["ORACLES", "QUERIES"]
