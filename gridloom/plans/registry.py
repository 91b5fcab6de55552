"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from gridloom.plans import factor_queries, field_queries, mesh_queries, model_queries, scatter_queries

QUERIES = {**mesh_queries.QUERIES, **field_queries.QUERIES, **model_queries.QUERIES, **factor_queries.QUERIES, **scatter_queries.QUERIES}
ORACLES = {**mesh_queries.ORACLES, **field_queries.ORACLES, **model_queries.ORACLES, **factor_queries.ORACLES, **scatter_queries.ORACLES}
FLAGSHIP = "nearest_active_point"
