"""All registered queries of the engine itself."""

from __future__ import annotations

from . import catalog_plans, graph_plans, ingest_plans, retrieval_plans, store_plans, stream_plans, table_plans, text_plans  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
