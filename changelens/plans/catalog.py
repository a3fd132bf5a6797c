"""All registered queries and oracles, by family."""

from __future__ import annotations

from changelens.plans import dashboard, dependency, ingest, lifecycle, mining, scanning, search_queries, stream_queries

_FAMILIES = (mining, scanning, dependency, lifecycle, dashboard, search_queries, ingest, stream_queries)
QUERIES = {name: fn for family in _FAMILIES for name, fn in family.QUERIES.items()}
ORACLES = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}


flagship = scanning.flagship
