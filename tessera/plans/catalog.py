"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from tessera.plans import graphs, knowledge, retrieval
from tessera.plans.registry import Query

REGISTRIES = (knowledge.R, graphs.R, retrieval.R)


def queries() -> dict[str, Query]:
    return {name: query for registry in REGISTRIES for name, query in registry.functions.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for registry in REGISTRIES for name, sql in registry.oracle_sql().items()}
