"""Queries of the text operators over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from gridloom.llm import queries_a, queries_b, queries_c

QUERIES = {**queries_a.QUERIES, **queries_b.QUERIES, **queries_c.QUERIES}
ORACLES = {**queries_a.ORACLES, **queries_b.ORACLES, **queries_c.ORACLES}
