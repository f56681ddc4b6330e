"""All queries of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quern.plans import copies_queries, memory_queries, network_queries

_MODULES = (memory_queries, network_queries, copies_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
