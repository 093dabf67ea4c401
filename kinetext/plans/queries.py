"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from . import event_queries, pose_queries, source_queries, text_queries

QUERIES = event_queries.R.queries | text_queries.R.queries | pose_queries.R.queries | source_queries.R.queries
ORACLE_SQL = event_queries.R.sql | text_queries.R.sql | pose_queries.R.sql | source_queries.R.sql
