"""Queries of the engine, by name, with their DuckDB equivalents."""

from __future__ import annotations

from quire.plans import relational, vault_queries

QUERIES: dict = vault_queries.QUERIES | relational.QUERIES
ORACLES: dict[str, str] = vault_queries.ORACLES | relational.ORACLES
