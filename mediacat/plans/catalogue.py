"""All registered queries."""

from __future__ import annotations

from mediacat.plans import queries_browse, queries_duplicates, queries_search, queries_streaming, queries_tables  # noqa: F401
from mediacat.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
