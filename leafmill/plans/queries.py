"""Queries over the given tables, one or more for each operator, and the SQL that returns the same rows."""

from __future__ import annotations

from leafmill.plans import constraint_queries, graph_queries, pass_queries, planning_queries, source_queries, structure_queries, text_queries

_ALL = text_queries.QUERIES | structure_queries.QUERIES | graph_queries.QUERIES | source_queries.QUERIES | planning_queries.QUERIES | pass_queries.QUERIES | constraint_queries.QUERIES

QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
