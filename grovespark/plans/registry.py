"""All core queries with their SQL twins."""

from __future__ import annotations

from grovespark.plans import graph, linking, overlay, problems, relational, retrieval, streams

_MODULES = (problems, relational, graph, linking, overlay, retrieval, streams)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
