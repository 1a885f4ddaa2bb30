"""Queries over the test tables: one for each operator, with the SQL that DuckDB compares it with."""

from __future__ import annotations

from plumbline.queries import columns, tables, tools
from plumbline.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "columns", "tables", "tools"]
