"""All registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from . import dedup_queries, dialogue_queries, fold_queries, gate_queries, graph_queries, index_queries, layout_queries, linking_queries, note_queries, ranking_queries, series_queries, stream_queries, telemetry_queries, text_queries, vault_queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "dedup_queries", "dialogue_queries", "fold_queries", "gate_queries", "graph_queries", "index_queries", "layout_queries", "linking_queries", "note_queries", "ranking_queries", "series_queries", "stream_queries", "telemetry_queries", "text_queries", "vault_queries"]
