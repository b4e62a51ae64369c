"""Every registered query of the library and its DuckDB twin."""

from __future__ import annotations

from linkloom.plans import family_queries, graph_queries, link_queries, model_queries, page_queries, score_queries, table_queries  # noqa: F401
from linkloom.plans.registry import ORACLES, QUERIES  # noqa: F401
