"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from obspark.plans import lifecycle_queries, operations_queries, record_queries, search_queries, session_queries, store_queries, text_queries, timeline_queries

QUERIES = {**search_queries.QUERIES, **operations_queries.QUERIES, **record_queries.QUERIES, **timeline_queries.QUERIES, **lifecycle_queries.QUERIES, **text_queries.QUERIES, **session_queries.QUERIES, **store_queries.QUERIES}
ORACLE_SQL = {**search_queries.ORACLE_SQL, **operations_queries.ORACLE_SQL, **record_queries.ORACLE_SQL, **timeline_queries.ORACLE_SQL, **lifecycle_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **session_queries.ORACLE_SQL, **store_queries.ORACLE_SQL}
