"""Queries of the engine's own operators and their DuckDB oracles."""

from __future__ import annotations

from codequarry.catalog import evidence, facts, index, maintenance  # noqa: F401  (they register queries)
from codequarry.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
