"""All named queries, and for each its SQL twin where one can be written."""

from __future__ import annotations

from graphloom.plans import graph_plans, linkage_plans, matching_plans, quality_plans, source_plans

_MODULES = (quality_plans, source_plans, linkage_plans, graph_plans, matching_plans)

QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
