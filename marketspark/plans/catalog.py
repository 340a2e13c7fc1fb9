"""The named queries and their DuckDB SQL, gathered from the modules of this folder."""

from __future__ import annotations

from marketspark.plans import extraction, intelligence, market, matching, pages, relational, rows, rules, search, stream, structured, text, timeseries
from marketspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "extraction", "intelligence", "market", "matching", "pages", "relational", "rows", "rules", "search", "stream", "structured", "text", "timeseries"]
