"""The registered queries over the binding views, with the SQL that gives the same rows."""

from __future__ import annotations

from revlume.plans import analytics, etl, flows, gates, graphs, listings, records, release, vectors

QUERIES = {}
ORACLE_SQL = {}
for _plan in (analytics, listings, graphs, etl, vectors, records, gates, flows, release):
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
