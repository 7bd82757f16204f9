"""Registry of the engine's named queries and their SQL oracles."""

from __future__ import annotations

from strandloom.plans import extract_queries, phasing_queries, read_queries

QUERIES = {**phasing_queries.QUERIES, **read_queries.QUERIES, **extract_queries.QUERIES}
ORACLE_SQL = {**phasing_queries.ORACLE_SQL, **read_queries.ORACLE_SQL, **extract_queries.ORACLE_SQL}
